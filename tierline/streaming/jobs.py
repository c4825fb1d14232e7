"""Structured Streaming versions of ingest, windowed features and upserts.

Sources are file streams (a Kafka topic plugs in the same way through
``readStream.format("kafka")`` when its connector is on the classpath; it is
not bundled here).  All queries keep state and progress in a checkpoint
below the shared ``spark.checkpoint.dir``, so a restarted or re-scheduled
query resumes where it stopped; sinks are the file sink (exactly-once via
its commit log) or ``foreachBatch`` with an idempotent merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from tierline.functions import instant_wallclock, wallclock_instant
from tierline.operators.sinks import create_table_version, replace_partitions, touched_rows

#: Hash bucket of the keys in tables kept by :func:`upsert_latest_stream`.
BUCKET_COLUMN = "_bucket"


def file_stream(spark: SparkSession, directory: str, schema: StructType, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream new files of ``directory`` (optionally only names matching
    ``glob``).  A schema is required: streams never infer one."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(directory)


def run_until_caught_up(writer: DataStreamWriter, timeout_s: float | None = None) -> StreamingQuery:
    """Process everything available now (in as many micro-batches as the
    source limits allow), then stop: the batch-style way to run a stream.
    A stream that is not done after ``timeout_s`` is stopped, and this raises."""
    q = writer.trigger(availableNow=True).start()
    done = q.awaitTermination(timeout_s)
    if q.exception():
        raise q.exception()
    if timeout_s is not None and not done:
        q.stop()
        raise TimeoutError(f"the stream had not caught up after {timeout_s} s")
    return q


def with_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP (the Parquet inputs are TIMESTAMP_NTZ): the
    wall-clock value is read as UTC, so windows align to wall-clock hours
    whatever the session time zone is."""
    return df.withColumn(ts, wallclock_instant(ts))


def stream_to_bronze(stream: DataFrame, out_path: str, checkpoint: str, run_id: str,
                     ingested_at: str) -> DataStreamWriter:
    """Append-only raw copy with ingest stamps; file sink = exactly once."""
    stamped = stream.select("*", F.lit(run_id).alias("_ingest_run_id"),
                            F.lit(ingested_at).cast("timestamp_ntz").alias("_ingested_at"))
    return (stamped.writeStream.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).outputMode("append"))


def windowed_aggregates(stream: DataFrame, ts: str, keys: Sequence[str | Column],
                        aggs: Sequence[Column], window: str, slide: str | None = None,
                        delay: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) event-time windows with a watermark.

    In append mode a window is emitted once the watermark (max event time
    seen - ``delay``) passes its end; rows older than the watermark are
    dropped as late.  State per open window is bounded by the delay."""
    s = with_event_time(stream, ts).withWatermark(ts, delay)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = s.groupBy(w.alias("window"), *keys).agg(*aggs)
    return out.select(instant_wallclock("window.start").alias("window_start"),
                      instant_wallclock("window.end").alias("window_end"),
                      *[c for c in out.columns if c != "window"])


def sliding_from_panes(stream: DataFrame, ts: str, keys: Sequence[str], pane_aggs: Sequence[Column],
                       window_aggs: Sequence[Column], window: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """Sliding windows in two steps: tumbling panes as wide as the slide, then
    windows over panes.

    An event is aggregated once, into its pane; only panes are copied into the
    ``window / slide`` windows they belong to.  ``window_aggs`` combine the pane
    columns (a count becomes a sum of counts).  The slide must divide the window."""
    s = with_event_time(stream, ts).withWatermark(ts, delay)
    panes = s.groupBy(F.window(ts, slide).alias("pane"), *keys).agg(*pane_aggs)
    out = panes.groupBy(F.window("pane", window, slide).alias("window"), *keys).agg(*window_aggs)
    return out.select(instant_wallclock("window.start").alias("window_start"),
                      instant_wallclock("window.end").alias("window_end"),
                      *[c for c in out.columns if c != "window"])


def dedup_within_watermark(stream: DataFrame, ts: str, keys: Sequence[str],
                           delay: str = "1 hour") -> DataFrame:
    """Drop re-delivered rows: the first row per key wins while the key is
    within the watermark delay; state is evicted afterwards."""
    s = with_event_time(stream, ts).withWatermark(ts, delay)
    out = s.dropDuplicatesWithinWatermark(list(keys))
    return out.withColumn(ts, instant_wallclock(ts))


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """Newest row per key (ties: greatest values) as a partial aggregate."""
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(ts), *[F.col(v) for v in values])).alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in [ts, *values]])


def upsert_latest_stream(stream: DataFrame, table: str, root: str, keys: Sequence[str], ts: str,
                         values: Sequence[str], checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Keep ``table`` = newest row per key across all micro-batches.

    The table is partitioned by a hash bucket of its keys (column
    ``BUCKET_COLUMN``).  Each batch is reduced to its newest row per key and
    combined, by the same max rule, with the buckets it touches; only these are
    read, rewritten and re-pointed, and their superseded files are removed after
    the swap.  Replaying a batch after a failure gives the same table."""
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge_batch(batch: DataFrame, epoch_id: int) -> None:
        latest = latest_per_key(batch, keys, ts, values).withColumn(BUCKET_COLUMN, bucket)
        if not spark.catalog.tableExists(table):
            create_table_version(spark, latest, table, root, [BUCKET_COLUMN])
            return
        old = touched_rows(spark.table(table), latest, [BUCKET_COLUMN])
        merged = latest_per_key(old.unionByName(latest), [*keys, BUCKET_COLUMN], ts, values)
        replace_partitions(spark, merged, table, [BUCKET_COLUMN], remove_old=True)

    return (stream.writeStream.foreachBatch(merge_batch)
            .option("checkpointLocation", checkpoint).outputMode("append"))
