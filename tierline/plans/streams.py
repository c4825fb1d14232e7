"""Streaming queries over the events table as a file stream.

Each query streams ``events.parquet`` of the sf dir, runs until caught up
(availableNow), and returns what its sink holds.  Append-mode windows are
emitted only once the watermark (max event time - 1 hour) passes their end,
so the oracles keep windows ending at or before that point.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.operators.windows import exact_sum
from tierline.plans.common import PROCESSED_AT, RUN_ID, t
from tierline.session import scratch_path
from tierline.streaming.keyed import current_rows, newest_per_key, rolling_per_event, run_keyed
from tierline.streaming.jobs import (
    BUCKET_COLUMN, dedup_within_watermark, file_stream, run_until_caught_up, sliding_from_panes, stream_to_bronze,
    upsert_latest_stream, windowed_aggregates,
)


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = t(spark, sf, "events").schema
    return file_stream(spark, sf, schema, glob="events.parquet")


def _file_sink(df: DataFrame, name: str):
    out, ck = scratch_path(spark=df.sparkSession, name=name), scratch_path(df.sparkSession, name + "_ck")
    w = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append"))
    return w, out


def stream_bronze(spark: SparkSession, sf: str) -> DataFrame:
    out, ck = scratch_path(spark, "stream_bronze"), scratch_path(spark, "stream_bronze_ck")
    run_until_caught_up(stream_to_bronze(_events_stream(spark, sf), out, ck, RUN_ID, PROCESSED_AT))
    return spark.read.parquet(out)


STREAM_BRONZE_SQL = f"""
SELECT *, '{RUN_ID}' AS _ingest_run_id, TIMESTAMP '{PROCESSED_AT}' AS _ingested_at FROM events
"""


def _agg_cols():
    return [F.count(F.lit(1)).alias("n_events"),
            F.sum(exact_sum("value")).cast("double").alias("total_value"),
            F.max("value").alias("max_value")]


def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    agg = windowed_aggregates(_events_stream(spark, sf), "ts", ["event_type"], _agg_cols(),
                              "1 hour", delay="1 hour")
    w, out = _file_sink(agg, "stream_hourly")
    run_until_caught_up(w)
    return spark.read.parquet(out)


STREAM_HOURLY_SQL = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type,
       COUNT(*) AS n_events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
       MAX(value) AS max_value
FROM events GROUP BY 1, 2, 3
HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR
"""


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """24-hour windows sliding by one hour, from hourly panes (an event is
    aggregated once, not 24 times)."""
    money = F.sum("_sum").alias("_total")
    agg = sliding_from_panes(
        _events_stream(spark, sf), "ts", ["event_type"],
        [F.count(F.lit(1)).alias("_n"), F.sum(exact_sum("value")).alias("_sum"), F.max("value").alias("_max")],
        [F.sum("_n").alias("n_events"), money, F.max("_max").alias("max_value")], "24 hours", "1 hour", delay="1 hour")
    agg = agg.withColumn("total_value", F.col("_total").cast("double")).drop("_total")
    w, out = _file_sink(agg, "stream_sliding")
    run_until_caught_up(w)
    return spark.read.parquet(out)


STREAM_SLIDING_SQL = """
WITH x AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS BIGINT)) AS window_start, *
           FROM events, range(0, 24) r(k))
SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, event_type,
       COUNT(*) AS n_events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
       MAX(value) AS max_value
FROM x GROUP BY 1, 2, 3
HAVING window_start + INTERVAL 24 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR
"""


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """At-least-once delivery simulated by reading the topic twice; the
    watermark-bounded dedup on event_id restores exactly one row each."""
    twice = _events_stream(spark, sf).unionByName(_events_stream(spark, sf))
    d = dedup_within_watermark(twice, "ts", ["event_id"], "1 hour")
    w, out = _file_sink(d, "stream_dedup")
    run_until_caught_up(w)
    return spark.read.parquet(out)


STREAM_DEDUP_SQL = "SELECT * FROM events"


def stream_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    table = f"online.stream_latest_{uuid.uuid4().hex[:10]}"
    s = _events_stream(spark, sf).select("user_id", "ts", "event_type", "value")
    w = upsert_latest_stream(s, table, scratch_path(spark, "stream_upsert"), ["user_id"], "ts",
                             ["event_type", "value"], scratch_path(spark, "stream_upsert_ck"))
    run_until_caught_up(w)
    return spark.table(table).drop(BUCKET_COLUMN)


STREAM_UPSERT_SQL = """
SELECT user_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) AS rn
  FROM events) WHERE rn = 1
"""


def stream_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    """Newest event per user from keyed state: the log of changes, read back."""
    s = _events_stream(spark, sf)
    changes = newest_per_key(s, ["user_id"], "ts", "event_id", ["event_type", "value", "props"])
    w, out = _file_sink(changes, "stream_latest_state")
    run_keyed(w, s)
    return current_rows(spark.read.parquet(out), ["user_id"])


STREAM_LATEST_STATE_SQL = """
SELECT user_id, ts, event_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
"""

# Frames of the streamed features, in microseconds.
STREAM_FRAMES = {"5m": 5 * 60_000_000, "24h": 24 * 3_600_000_000}


def stream_event_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """5-minute and 24-hour counts and sums at every event, from keyed state."""
    s = _events_stream(spark, sf)
    rolled = rolling_per_event(s, ["user_id"], "ts", "event_id", "value", STREAM_FRAMES, delay="1 hour")
    w, out = _file_sink(rolled, "stream_event_rolling")
    run_keyed(w, s)
    r = spark.read.parquet(out)
    return r.select("event_id", "user_id", "ts", "count_5m", F.col("sum_5m").cast("double").alias("sum_5m"),
                    "count_24h", F.col("sum_24h").cast("double").alias("sum_24h"))


STREAM_EVENT_ROLLING_SQL = """
SELECT * FROM (
  SELECT event_id, user_id, ts,
         COUNT(*) OVER m AS count_5m, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER m AS DOUBLE) AS sum_5m,
         COUNT(*) OVER d AS count_24h, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER d AS DOUBLE) AS sum_24h
  FROM events
  WINDOW m AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW),
         d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW))
WHERE ts < (SELECT date_trunc('milliseconds', MAX(ts)) FROM events) - INTERVAL 1 HOUR
"""


QUERIES = {
    "stream_bronze": stream_bronze,
    "stream_hourly": stream_hourly,
    "stream_sliding": stream_sliding,
    "stream_dedup": stream_dedup,
    "stream_upsert_latest": stream_upsert_latest,
    "stream_latest_state": stream_latest_state,
    "stream_event_rolling": stream_event_rolling,
}

ORACLES = {
    "stream_bronze": STREAM_BRONZE_SQL,
    "stream_hourly": STREAM_HOURLY_SQL,
    "stream_sliding": STREAM_SLIDING_SQL,
    "stream_dedup": STREAM_DEDUP_SQL,
    "stream_upsert_latest": STREAM_UPSERT_SQL,
    "stream_latest_state": STREAM_LATEST_STATE_SQL,
    "stream_event_rolling": STREAM_EVENT_ROLLING_SQL,
}
