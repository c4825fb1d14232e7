"""Streams with state per key: ``transformWithState`` processors.

State lives in Spark's RocksDB state store, is checkpointed with the query and
moves with its partition when an executor is lost.  Two processors:

* :func:`newest_per_key` keeps one row per key and emits it whenever a newer one
  arrives.  A micro-batch reads and writes the state of its own keys only; the
  sink is an append-only log of changes, no table is scanned or rewritten.
* :func:`rolling_per_event` emits, for each event, counts and sums over
  ``[t - L, t]`` once the watermark has passed t, so that rows out of order
  within the delay are counted.  State is cut into (hash slot of the keys, time
  bucket) pieces and freed by timers: a piece lives no longer than its bucket, its
  longest frame and the delay.  A state call and a timer cost far more than a row, so
  a piece holds many keys, and their number grows with slots and buckets, not with
  the keys.  A hot key is spread over the buckets that are open at a time; the
  rows of one slot and bucket are one piece, so slots and the bucket's length bound it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

from tierline.functions import epoch_us
from tierline.operators.sinks import _conf
from tierline.streaming.jobs import run_until_caught_up, with_event_time

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Wall-clock values inside the JSON payload keep their microseconds.
_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def run_keyed(writer: DataStreamWriter, stream: DataFrame, timeout_s: float | None = None) -> StreamingQuery:
    """:func:`run_until_caught_up` with the state store that keyed state needs; the
    session's own setting is put back."""
    with _conf(stream.sparkSession, "spark.sql.streaming.stateStore.providerClass", _PROVIDER):
        return run_until_caught_up(writer, timeout_s)


# --- newest row per key -----------------------------------------------------------

class _Newest(StatefulProcessor):
    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle) -> None:
        schema = StructType([StructField("t", LongType()), StructField("tie", LongType()),
                             StructField("version", LongType())])
        self.state = handle.getValueState("newest", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        best = None
        for pdf in rows:
            at = pdf.sort_values(["tl_t", "tl_tie"], kind="stable").iloc[-1]
            if best is None or (at["tl_t"], at["tl_tie"]) > (best["tl_t"], best["tl_tie"]):
                best = at
        if best is None or (old is not None and (best["tl_t"], best["tl_tie"]) <= (old[0], old[1])):
            return
        version = 1 if old is None else old[2] + 1
        self.state.update((int(best["tl_t"]), int(best["tl_tie"]), version))
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "tl_t": [best["tl_t"]], "tl_tie": [best["tl_tie"]],
                            "tl_payload": [best["tl_payload"]], "version": [version]})

    def close(self) -> None:
        pass


def newest_per_key(stream: DataFrame, keys: Sequence[str], ts: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Changes of the newest row per key: keys, ts, tie, values and ``version`` (1, 2, ...
    per key).  Newest is the greatest (``ts``, ``tie``); ``tie`` is a whole number.

    An older row that arrives late changes nothing, a replayed one neither.  The state
    holds only times and the version; values cross to Python as one JSON string, so their types and
    NULLs stay exact.  Rows without a key, ``ts`` or ``tie`` are left out.  State grows with the
    number of keys: a time to live needs processing time, in which a stream that runs until
    caught up never ends, so there is none."""
    schema = stream.select(*values).schema
    rows = stream.select(*keys, epoch_us(ts).alias("tl_t"), F.col(tie).cast("long").alias("tl_tie"),
                         F.to_json(F.struct(*values), {**_JSON, "ignoreNullFields": "false"}).alias("tl_payload"))
    for c in [*keys, "tl_t", "tl_tie"]:
        rows = rows.filter(F.col(c).isNotNull())
    out = StructType([*[rows.schema[k] for k in keys], StructField("tl_t", LongType()), StructField("tl_tie", LongType()),
                      StructField("tl_payload", StringType()), StructField("version", LongType())])
    changes = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Newest(list(keys)), outputStructType=out, outputMode="Append", timeMode="None")
    back = F.from_json("tl_payload", schema, _JSON)
    return changes.select(*keys, _wallclock("tl_t").alias(ts), F.col("tl_tie").alias(tie), back.alias("_p"), "version") \
        .select(*keys, ts, *([] if tie in values else [tie]), *[F.col(f"_p.{v}").alias(v) for v in values], "version")


def current_rows(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version per key of a log of changes (a partial aggregate)."""
    rest = [c for c in changes.columns if c not in keys and c != "version"]
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def _wallclock(us: str) -> Column:
    return F.timestamp_add("MICROSECOND", F.col(us), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


# --- rolling counts per event --------------------------------------------------------

# Columns that cross to Python have no leading underscore: the state serializer renames such.
_PIECE = "t array<bigint>, id array<bigint>, cents array<bigint>, has array<bigint>, own array<boolean>, key array<{}>"


class _Rolling(StatefulProcessor):
    """One (slot, bucket): rows of the bucket are its own; copies of rows before it are
    there for the frames that reach back."""

    def __init__(self, key_type: str, frames: dict[str, int], width: int):
        self.piece, self.frames, self.width = _PIECE.format(key_type), frames, width
        self.reach = max(frames.values())

    def init(self, handle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", self.piece)
        self.mark = handle.getValueState("emitted_before", StructType([StructField("t", LongType())]))

    def _end(self, key) -> int:
        return (int(key[-1]) + 1) * self.width

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if pdf.empty:
                continue
            self.pieces.appendValue(tuple(pdf[c].tolist() for c in ("tl_t", "tl_id", "tl_cents", "tl_has", "tl_own", "tl_key")))
            own = pdf.loc[pdf["tl_own"], "tl_t"]
            if len(own):
                first = int(own.min()) if first is None else min(first, int(own.min()))
        self.handle.registerTimer((self._end(key) if first is None else first) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.pieces.exists():
            return
        t, ids, cents, has, own, name = (np.concatenate([np.asarray(p[i]) for p in pieces])
                                         for pieces in [list(self.pieces.get())] for i in range(6))
        names, of = np.unique(name, return_inverse=True)
        order = np.lexsort((ids, t, of))
        t, ids, cents, has, own, of = (c[order] for c in (t, ids, cents, has, own.astype(bool), of))
        before = timerValues.getCurrentWatermarkInMs() * 1000
        mark = self.mark.get()[0] if self.mark.exists() else np.iinfo(np.int64).min
        due = np.flatnonzero(own & (t >= mark) & (t < before))
        if len(due):
            sums = np.concatenate([[0], np.cumsum(cents)])
            known = np.concatenate([[0], np.cumsum(has)])
            # places in the order by (key, time): times as ranks, so that both fit one whole number
            starts = [t[due] - length for length in self.frames.values()]
            ranks = np.unique(np.concatenate([t, *starts]))

            def place(keys, times):
                return keys * np.int64(len(ranks)) + np.searchsorted(ranks, times)

            at = place(of, t)
            hi = np.searchsorted(at, at[due], side="right")
            out = {"tl_key": names[of[due]], "tl_t": t[due], "tl_id": ids[due]}
            for name, start in zip(self.frames, starts):
                lo = np.searchsorted(at, place(of[due], start), side="left")
                out[f"_n_{name}"] = hi - lo
                out[f"_s_{name}"] = sums[hi] - sums[lo]
                out[f"_k_{name}"] = known[hi] - known[lo]
            yield pd.DataFrame(out)
        end = self._end(key)
        if before >= end:
            self.pieces.clear()
            self.mark.clear()
            return
        keep = t >= max(before, mark) - self.reach
        if keep.any():
            self.pieces.put([tuple(c[keep].tolist() for c in (t, ids, cents, has, own, names[of]))])
        else:
            self.pieces.clear()
        self.mark.update((int(max(before, mark)),))
        left = t[own & (t >= before)]
        self.handle.registerTimer(int(left.min() if len(left) else end) // 1000)

    def close(self) -> None:
        pass


def rolling_per_event(stream: DataFrame, keys: Sequence[str], ts: str, event_id: str, value: str,
                      frames: Mapping[str, int], delay: str = "1 hour", bucket_us: int | None = None,
                      slots: int = 1024) -> DataFrame:
    """Per event: keys, event_id, ts and for each (name, length in microseconds) of ``frames``
    ``count_<name>`` and ``sum_<name>`` (exact decimal(18,2), NULL without any value) over the
    key's events in [t - length, t], as the batch ``rolling_frames`` has them.

    An event is emitted once the watermark (greatest time seen - ``delay``, in milliseconds)
    is beyond it; a row that arrives behind the watermark is dropped as late.  An event near the
    end of its bucket (``bucket_us``, a week or the longest frame) is copied once into the next
    one.  ``event_id`` is a whole number; repeated rows count as often as they come.  Rows
    without a key, time or id are left out.  Keys share ``slots`` hash slots: a piece of state holds a
    slot's rows of one bucket, so a stream with more than some 50 million rows a bucket needs more."""
    reach = max(frames.values())
    width = max(bucket_us or 7 * 86_400_000_000, reach)
    timed = with_event_time(stream.filter(F.col(ts).isNotNull()), ts).withWatermark(ts, delay)
    cents = (F.col(value).cast("decimal(18,2)") * 100).cast("long")
    rows = timed.select(*keys, ts, F.unix_micros(ts).alias("tl_t"), F.col(event_id).cast("long").alias("tl_id"),
                        F.coalesce(cents, F.lit(0)).alias("tl_cents"), cents.isNotNull().cast("long").alias("tl_has"))
    for c in [*keys, "tl_id"]:
        rows = rows.filter(F.col(c).isNotNull())
    home = F.floor(F.col("tl_t") / F.lit(width)).cast("long")
    last = F.floor((F.col("tl_t") + reach) / F.lit(width)).cast("long")
    # one whole-number key crosses as it is, others as one JSON string
    plain = len(keys) == 1 and isinstance(rows.schema[keys[0]].dataType, IntegralType)
    key_type = "bigint" if plain else "string"
    packed = F.col(keys[0]).cast("long") if plain else F.to_json(F.struct(*keys), _JSON)
    rows = rows.withColumn("tl_slot", F.pmod(F.xxhash64(*keys), F.lit(slots))).withColumn("tl_key", packed).drop(
        *[k for k in keys if k != ts])
    spread = rows.withColumn("_home", home).withColumn("_b", F.explode(F.sequence("_home", last))) \
        .withColumn("tl_own", F.col("_b") == F.col("_home")).drop("_home")
    key_schema = stream.select(*keys).schema
    out = StructType([StructField("tl_key", LongType() if plain else StringType()), StructField("tl_t", LongType()),
                      StructField("tl_id", LongType()), *[StructField(f"_{p}_{n}", LongType()) for n in frames for p in "nsk"]])
    told = spread.groupBy("tl_slot", "_b").transformWithStateInPandas(
        statefulProcessor=_Rolling(key_type, dict(frames), width), outputStructType=out, outputMode="Append",
        timeMode="EventTime")
    cols = []
    for n in frames:
        money = F.when(F.col(f"_k_{n}") > 0, (F.col(f"_s_{n}").cast("decimal(20,0)") / 100).cast("decimal(18,2)"))
        cols += [F.col(f"_n_{n}").alias(f"count_{n}"), money.alias(f"sum_{n}")]
    if plain:
        back = [F.col("tl_key").cast(key_schema[0].dataType).alias(keys[0])]
    else:
        told = told.withColumn("_key", F.from_json("tl_key", key_schema, _JSON))
        back = [F.col(f"_key.{k}").alias(k) for k in keys]
    return told.select(*back, F.col("tl_id").alias(event_id), _wallclock("tl_t").alias(ts), *cols)
