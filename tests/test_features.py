"""Point-in-time join, latest values and view validation on literal frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tierline.operators.features import (
    define_feature_view, get_historical_features, latest_features, point_in_time_join,
    resolve_refs,
)

D = dt.datetime


def _customer_view(spark, ttl=86400):
    # literal customer features (event_timestamp = created), ttl 1 day
    rows = [(1, 150.5, 50.17, 5, D(2025, 10, 1)), (2, 320.0, 64.0, 12, D(2025, 10, 2)),
            (3, 89.99, 29.99, 30, D(2025, 10, 3)), (4, 450.25, 75.04, 2, D(2025, 10, 4)),
            (5, 210.0, 52.5, 8, D(2025, 10, 5))]
    df = spark.createDataFrame(rows, "customer_id long, total_purchases double, "
                                     "avg_purchase_value double, last_purchase_days_ago int, "
                                     "event_timestamp timestamp_ntz")
    return define_feature_view("customer_features", df, ["customer_id"],
                               [("total_purchases", "float64"), ("avg_purchase_value", "float64"),
                                ("last_purchase_days_ago", "int32")], ttl_seconds=ttl)


def _entities(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, event_timestamp timestamp_ntz, label int")


def test_all_older_than_ttl_are_null(spark):
    ent = _entities(spark, [(1, D(2025, 10, 5), 0), (2, D(2025, 10, 5), 1), (3, D(2025, 10, 5), 0)])
    out = point_in_time_join(ent, _customer_view(spark), "event_timestamp").collect()
    assert len(out) == 3
    assert all(r["total_purchases"] is None for r in out)


def test_exact_ttl_edge_is_inclusive(spark):
    ent = _entities(spark, [(1, D(2025, 10, 2), 0)])
    out = point_in_time_join(ent, _customer_view(spark), "event_timestamp").first()
    assert out["total_purchases"] == 150.5


def test_one_microsecond_past_ttl_is_null(spark):
    ent = _entities(spark, [(1, D(2025, 10, 2, 0, 0, 0, 1), 0)])
    out = point_in_time_join(ent, _customer_view(spark), "event_timestamp").first()
    assert out["total_purchases"] is None


def test_future_row_only_no_match_null_key_and_duplicates(spark):
    ent = _entities(spark, [(5, D(2025, 10, 4), 0),      # only a future row
                            (9, D(2025, 10, 4), 0),      # unknown key
                            (None, D(2025, 10, 4), 0),   # null key
                            (4, D(2025, 10, 4, 12), 1),  # duplicated entity row
                            (4, D(2025, 10, 4, 12), 1)])
    out = point_in_time_join(ent, _customer_view(spark), "event_timestamp").collect()
    assert len(out) == 5
    by = {}
    for r in out:
        by.setdefault(r["customer_id"], []).append(r["total_purchases"])
    assert by[5] == [None] and by[9] == [None] and by[None] == [None]
    assert by[4] == [450.25, 450.25]


def test_created_timestamp_breaks_ties(spark):
    rows = [(1, 1.0, D(2025, 1, 1, 10), D(2025, 1, 1, 10, 5)),
            (1, 2.0, D(2025, 1, 1, 10), D(2025, 1, 1, 10, 9)),
            (1, 3.0, D(2025, 1, 1, 10), D(2025, 1, 1, 10, 7))]
    df = spark.createDataFrame(rows, "k long, x double, ts timestamp_ntz, created timestamp_ntz")
    v = define_feature_view("v", df, ["k"], [("x", "float64")], "ts", "created", 3600)
    ent = spark.createDataFrame([(1, D(2025, 1, 1, 10, 30))], "k long, at timestamp_ntz")
    assert point_in_time_join(ent, v, "at").first()["x"] == 2.0


def test_full_feature_names_and_clash(spark):
    ent = _entities(spark, [(1, D(2025, 10, 1, 12), 0)])
    view = _customer_view(spark)
    out = get_historical_features(ent, [(view, ["total_purchases"])], "event_timestamp",
                                  full_feature_names=True)
    assert "customer_features__total_purchases" in out.columns
    clash = ent.withColumn("total_purchases", F.lit(0.0))
    with pytest.raises(ValueError):
        point_in_time_join(clash, view, "event_timestamp")
    with pytest.raises(KeyError):
        resolve_refs({"customer_features": view}, ["nope:x"])


def test_view_validation(spark):
    df = spark.createDataFrame([(1, D(2025, 1, 1))], "k long, ts timestamp_ntz")
    with pytest.raises(ValueError):
        define_feature_view("bad name", df, ["k"], [], "ts")
    with pytest.raises(ValueError):
        define_feature_view("v", df, ["k"], [("missing", "int64")], "ts")
    with pytest.raises(ValueError):
        define_feature_view("v", df, ["k"], [], "ts", ttl_seconds=0)


def _brute(ent, feats, ttl_us):
    out = []
    for k, t in ent:
        best = None
        for fk, ft, fc, x in feats:
            if fk is None or fk != k or ft > t:
                continue
            if ttl_us is not None and ft < t - dt.timedelta(microseconds=ttl_us):
                continue
            cand = (ft, fc, x)
            if best is None or cand > best:
                best = cand
        out.append((k, t, best[2] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ttl_s", [None, 3 * 3600, 2 * 86400, 90 * 60])
def test_bucketed_join_equals_brute_force(spark, ttl_s):
    rnd = random.Random(7)
    base = D(2025, 1, 1)
    feats = [(rnd.choice([1, 2, 3, None]), base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 6)),
              base + dt.timedelta(minutes=rnd.randrange(0, 100)), float(i)) for i in range(400)]
    ent = [(rnd.choice([1, 2, 3, 4]), base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 7)))
           for _ in range(300)]
    fdf = spark.createDataFrame(feats, "k long, ts timestamp_ntz, created timestamp_ntz, x double")
    edf = spark.createDataFrame(ent, "k long, at timestamp_ntz")
    v = define_feature_view("v", fdf, ["k"], [("x", "float64")], "ts", "created", ttl_s)
    # 2-hour buckets force the carry / edge-copy paths across many buckets
    got = point_in_time_join(edf, v, "at", bucket_us=2 * 3600 * 1_000_000, copy_factor=1)
    got_rows = sorted(((r["k"], r["at"], r["x"]) for r in got.collect()), key=repr)
    ttl_us = ttl_s * 1_000_000 if ttl_s is not None else None
    assert got_rows == _brute(ent, feats, ttl_us)


def test_latest_features_ttl(spark):
    rows = [(1, 1.0, D(2025, 1, 1)), (1, 2.0, D(2025, 1, 5)), (2, 3.0, D(2025, 1, 2)),
            (3, 4.0, D(2025, 1, 9))]
    df = spark.createDataFrame(rows, "k long, x double, ts timestamp_ntz")
    v = define_feature_view("v", df, ["k"], [("x", "float64")], "ts", ttl_seconds=2 * 86400)
    got = {r["k"]: r["x"] for r in latest_features(v, "2025-01-06 00:00:00").collect()}
    assert got == {1: 2.0, 2: None}   # key 3 only has a future row


def _service_frames(spark):
    ent = spark.createDataFrame(
        [(1, "2024-01-05 12:00:00", "a"), (1, "2024-01-05 12:00:00", "a"), (2, "2024-01-01 00:00:00", "b"),
         (None, "2024-01-05 00:00:00", "c"), (1, None, "d"), (3, "2024-02-01 00:00:00", "e")],
        "k long, at string, tag string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    day = lambda n, v: (n, f"2024-01-0{v} 00:00:00", float(10 * n + v))
    src = spark.createDataFrame([day(1, 1), day(1, 4), day(1, 6), day(2, 2), day(3, 3), (None, "2024-01-01 00:00:00", 0.5)],
                                "k long, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    views = [define_feature_view(n, src.withColumnRenamed("x", n + "_x"), ["k"], [(n + "_x", "float64")], "ts", None, ttl)
             for n, ttl in (("short", 86_400), ("long", 10 * 86_400), ("open", None))]
    return ent, views


def test_service_of_views_with_equal_keys_equals_single_joins(spark):
    ent, views = _service_frames(spark)
    got = get_historical_features(ent, [(v, None) for v in views], "at")
    want = ent
    for v in views:
        want = point_in_time_join(want, v, "at")
    assert got.columns == want.columns == ["k", "at", "tag", "short_x", "long_x", "open_x"]
    assert rows(got, ["k", "tag", "short_x", "long_x", "open_x"]) == sorted([
        (1, "a", None, 14.0, 14.0), (1, "a", None, 14.0, 14.0), (2, "b", None, None, None),
        (None, "c", None, None, None), (1, "d", None, None, None), (3, "e", None, None, 33.0)], key=repr)
    assert rows(got) == rows(want)


def test_service_shuffles_entity_rows_once(spark):
    ent, views = _service_frames(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = get_historical_features(ent, [(v, None) for v in views[:2]], "at")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    assert "isnotnull(k#" in plan and "Union" in plan          # rows without a key go round the window
