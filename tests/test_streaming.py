"""Streams over several micro-batches: late rows, restart from checkpoint."""

import datetime as dt
import decimal
import time

from pyspark.sql import functions as F

from tierline.session import scratch_path
from tierline.streaming.keyed import current_rows, newest_per_key, rolling_per_event, run_keyed
from tierline.streaming.jobs import (
    dedup_within_watermark, file_stream, run_until_caught_up, upsert_latest_stream,
    windowed_aggregates,
)

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double"
B = dt.datetime(2024, 1, 1)


def _drop(spark, d, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(d)
    time.sleep(1.1)   # distinct file modification times -> ordered micro-batches


def _hourly(spark, src, out, ck):
    s = file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1)
    agg = windowed_aggregates(s, "ts", [], [F.count(F.lit(1)).alias("n")], "1 hour", delay="1 hour")
    w = (agg.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append"))
    return run_until_caught_up(w)


def test_late_rows_dropped_and_restart_resumes(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("s_src", "s_out", "s_ck"))
    _drop(spark, src, [(1, B + dt.timedelta(minutes=10), 1, 1.0), (2, B + dt.timedelta(hours=1, minutes=5), 1, 1.0)])
    _drop(spark, src, [(3, B + dt.timedelta(hours=4), 1, 1.0), (4, B + dt.timedelta(hours=4, minutes=1), 1, 1.0)])
    _hourly(spark, src, out, ck)
    first = {r["window_start"]: r["n"] for r in spark.read.parquet(out).collect()}
    # watermark = 04:01 - 1h = 03:01 -> windows ending by then are final
    assert first == {B: 1, B + dt.timedelta(hours=1): 1}
    # restart with the same checkpoint: only the new file is read; the row at
    # 00:30 is behind the watermark and dropped, 06:00 advances the watermark
    _drop(spark, src, [(5, B + dt.timedelta(minutes=30), 1, 1.0), (6, B + dt.timedelta(hours=6), 1, 1.0)])
    _hourly(spark, src, out, ck)
    final = {r["window_start"]: r["n"] for r in spark.read.parquet(out).collect()}
    assert final == {B: 1, B + dt.timedelta(hours=1): 1, B + dt.timedelta(hours=4): 2}


def test_dedup_across_batches(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("d_src", "d_out", "d_ck"))
    r1 = (1, B + dt.timedelta(minutes=1), 1, 1.0)
    _drop(spark, src, [r1, (2, B + dt.timedelta(minutes=2), 1, 2.0)])
    _drop(spark, src, [r1, (3, B + dt.timedelta(minutes=3), 1, 3.0)])   # re-delivered row 1
    s = file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1)
    d = dedup_within_watermark(s, "ts", ["event_id"], "1 hour")
    run_until_caught_up(d.writeStream.format("parquet").option("path", out)
                        .option("checkpointLocation", ck))
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_upsert_latest_over_batches(spark):
    src, ck = scratch_path(spark, "u_src"), scratch_path(spark, "u_ck")
    _drop(spark, src, [(1, B + dt.timedelta(hours=2), 7, 1.0), (2, B + dt.timedelta(hours=1), 8, 2.0)])
    _drop(spark, src, [(3, B + dt.timedelta(hours=1), 7, 9.0),   # older than stored -> ignored
                       (4, B + dt.timedelta(hours=5), 8, 4.0)])
    s = file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1)
    table = "online.t_stream_latest"
    w = upsert_latest_stream(s.select("user_id", "ts", "value"), table, scratch_path(spark, "u_root"),
                             ["user_id"], "ts", ["value"], ck)
    run_until_caught_up(w)
    got = {r["user_id"]: r["value"] for r in spark.table(table).collect()}
    assert got == {7: 1.0, 8: 4.0}
    # superseded bucket files are gone: what is on disk is what the table holds
    root = next(iter(spark.table(table).inputFiles())).split("/v-")[0]
    assert spark.read.option("recursiveFileLookup", "true").parquet(root).count() == 2


def test_a_stream_that_is_not_done_in_time_raises(spark):
    import pytest
    src, ck = scratch_path(spark, "w_src"), scratch_path(spark, "w_ck")
    _drop(spark, src, [(1, B, 1, 1.0)])
    s = file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)

    def slow(batch, epoch):
        time.sleep(20)
    with pytest.raises(TimeoutError):
        run_until_caught_up(s.writeStream.foreachBatch(slow).option("checkpointLocation", ck), timeout_s=3)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, kind string, value double"


def _files(spark, src, *batches):
    for data in batches:
        spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)


def _source(spark, src):
    return file_stream(spark, src, spark.createDataFrame([], EVENTS).schema, max_files_per_trigger=1)


def _sink(df, out, ck):
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append")


def test_newest_per_key_state_over_restarts(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("k_src", "k_out", "k_ck"))
    h = lambda n, us=0: B + dt.timedelta(hours=n, microseconds=us)

    def run():
        s = _source(spark, src)
        run_keyed(_sink(newest_per_key(s, ["user_id"], "ts", "event_id", ["kind", "value"]), out, ck), s)
        return {r["user_id"]: tuple(r[1:]) for r in current_rows(spark.read.parquet(out), ["user_id"]).collect()}

    _files(spark, src, [(1, h(2), 7, "a", 1.5), (2, h(1), 8, None, None), (3, h(3), None, "x", 1.0), (4, None, 8, "x", 1.0)],
           [(5, h(1), 7, "late", 9.0), (6, h(5, 1), 8, "b", float("nan")), (7, h(5, 1), 8, "tie", 2.0)])
    first = run()
    assert first == {7: (h(2), 1, "a", 1.5), 8: (h(5, 1), 7, "tie", 2.0)}
    # the restarted query finds its state: a replayed row and a late one add nothing to the log
    n = spark.read.parquet(out).count()
    _files(spark, src, [(1, h(2), 7, "a", 1.5), (8, h(0), 8, "late", 1.0), (9, h(9), 9, "new", None)])
    assert run() == {**first, 9: (h(9), 9, "new", None)}
    log = spark.read.parquet(out)
    assert log.count() == n + 1
    assert max(r["version"] for r in log.filter("user_id = 8").collect()) == 2


def test_newest_of_one_key_with_many_rows_keeps_one_state(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("kh_src", "kh_out", "kh_ck"))
    _files(spark, src, [(i, B + dt.timedelta(seconds=i * 7919 % 5000), 1, "k", float(i)) for i in range(5000)])
    s = _source(spark, src)
    run_keyed(_sink(newest_per_key(s, ["user_id"], "ts", "event_id", ["value"]), out, ck), s)
    got = spark.read.parquet(out).collect()
    assert len(got) == 1 and got[0]["ts"] == B + dt.timedelta(seconds=4999)


def test_rolling_per_event_out_of_order_restart_and_late_rows(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("r_src", "r_out", "r_ck"))
    day = 86_400_000_000
    frames = {"1h": 3_600_000_000, "1d": day}
    m = lambda n: B + dt.timedelta(minutes=n)
    one = [(i, m(i * 37 % 2000), i % 3, "k", None if i % 5 == 0 else i / 4) for i in range(120)]
    two = [(200 + i, m(1990 + i * 91 % 3000), i % 3, "k", -i / 2) for i in range(100)]
    # repeated row, equal times, missing key and time
    two += [two[0], (300, two[1][1], two[1][2], "k", 5.0), (301, m(2000), None, "k", 1.0), (302, None, 1, "k", 1.0)]
    late = [(900, m(5), 1, "k", 1.0)]                        # far behind the watermark
    three = [(400 + i, m(5000 + i * 53 % 1500), i % 3, "k", None) for i in range(60)]

    def run():
        s = _source(spark, src)
        r = rolling_per_event(s, ["user_id"], "ts", "event_id", "value", frames, delay="1 hour", bucket_us=2 * day)
        run_keyed(_sink(r, out, ck), s)

    _files(spark, src, one, two)
    run()
    _files(spark, src, late + three)
    run()
    known = [r for r in one + two + three if r[1] is not None and r[2] is not None]
    final = max(r[1] for r in known) - dt.timedelta(hours=1)
    expect = []
    for e in (r for r in known if r[1] < final):
        row = [e[2], e[0], e[1]]
        for us in frames.values():
            inside = [r for r in known if r[2] == e[2] and e[1] - dt.timedelta(microseconds=us) <= r[1] <= e[1]]
            values = [r[4] for r in inside if r[4] is not None]
            row += [len(inside), sum(values) if values else None]
        expect.append(tuple(row))
    got = [tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == sorted(expect, key=repr)


def test_keyed_streams_scan_no_table(spark):
    src = scratch_path(spark, "p_src")
    _files(spark, src, [(1, B, 1, "k", 1.0)])
    s = _source(spark, src)
    plan = newest_per_key(s, ["user_id"], "ts", "event_id", ["value"])._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "Join" not in plan


def test_rolling_per_event_keys_share_pieces_of_state(spark):
    # 40 keys of two columns in 2 slots: at most 2 pieces of state a bucket, frames still per key
    src, out, ck = (scratch_path(spark, n) for n in ("q_src", "q_out", "q_ck"))
    data = [(i, B + dt.timedelta(minutes=i * 17 % 900), i % 20, f'k"{i % 2}', i / 4) for i in range(300)]
    data += [(1000, B + dt.timedelta(days=1), 0, 'k"0', None)]
    _files(spark, src, data)
    s = _source(spark, src)
    names = s.columns
    r = rolling_per_event(s, [names[2], names[3]], "ts", "event_id", "value", {"1h": 3_600_000_000}, slots=2)
    run_keyed(_sink(r, out, ck), s)
    state = spark.read.format("statestore").option("path", ck).option("stateVarName", "pieces").load()
    assert state.select("key").distinct().count() <= 2
    assert r.columns == [names[2], names[3], "event_id", "ts", "count_1h", "sum_1h"]
    expect = []
    for i, ts, u, k, v in data[:-1]:
        near = [x[4] for x in data if x[2:4] == (u, k) and ts - dt.timedelta(hours=1) <= x[1] <= ts]
        expect.append((u, k, i, ts, len(near), decimal.Decimal(str(sum(near)))))
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(expect)
