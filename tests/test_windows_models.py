"""Bucketed rolling windows, distributed ranks, kNN, splits, regressions."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tierline.functions import epoch_us
from tierline.operators.gold import price_elasticity
from tierline.operators.models import (
    _nearest, auc, feature_importances, fit_model, knn_exact, outlier_scores, per_group_least_squares, predict,
    regression_metrics, save_model, scaled_vectors, score_saved_model, stratified_split, train_test_split,
)
from tierline.operators.ranking import exact_quantile, hash_bucket, kth_smallest, range_bucket, running_total
from tierline.operators.windows import rolling, rolling_distinct_count, rolling_frames


def _events(spark, n=600, hot_share=0.4, seed=3):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    data = []
    for i in range(n):
        k = 0 if rnd.random() < hot_share else rnd.randrange(1, 6)
        data.append((i, k, base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 10)),
                     float(rnd.randrange(0, 100))))
    # exact ties in time
    data.append((n, 0, data[0][2], 7.0))
    return spark.createDataFrame(data, "id long, k long, ts timestamp_ntz, v double")


@pytest.mark.parametrize("bucket_h", [24, 48, 100])
def test_bucketed_rolling_equals_plain_window(spark, bucket_h):
    df = _events(spark)
    L = 24 * 3600 * 1_000_000

    def cols(frame):
        w = frame(L)
        return [F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("s"),
                F.size(F.collect_set("v").over(w)).alias("d")]
    got = rolling(df, ["k"], "ts", cols, L, bucket_us=bucket_h * 3600 * 1_000_000)
    w = Window.partitionBy("k").orderBy(epoch_us("ts")).rangeBetween(-L, 0)
    ref = df.select("*", F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("s"),
                    F.size(F.collect_set("v").over(w)).alias("d"))
    key = lambda r: r["id"]
    a = sorted(((r["id"], r["n"], r["s"], r["d"]) for r in got.collect()))
    b = sorted(((r["id"], r["n"], r["s"], r["d"]) for r in ref.collect()))
    assert a == b and key


def test_running_total_and_quantile(spark):
    rnd = random.Random(1)
    vals = [(i, float(rnd.randrange(0, 50)), rnd.choice("ab")) for i in range(1000)]
    df = spark.createDataFrame(vals, "id long, x double, g string")
    got = running_total(df, ["x", "id"], range_bucket(df, "x", 7), group_cols=["g"], out="r")
    for g in "ab":
        sub = sorted((x, i) for i, x, gg in vals if gg == g)
        exp = {i: n + 1 for n, (_, i) in enumerate(sub)}
        assert {r["id"]: r["r"] for r in got.filter(F.col("g") == g).collect()} == exp
    q = exact_quantile(df, "x", 0.95)
    assert q == pytest.approx(float(np.quantile([v[1] for v in vals], 0.95)))


def test_kth_smallest_refinement(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.lognormal(0, 3, 3000), np.full(500, 7.25), [1e12, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    srt = np.sort(x)
    for k in (1, 2, 700, 1500, 2999, 3501, len(x)):
        assert kth_smallest(df, "x", k, bins=16) == srt[k - 1]
    for q in (0.0, 0.5, 0.95, 1.0):
        assert exact_quantile(df, "x", q) == pytest.approx(float(np.quantile(x, q)), rel=1e-12)


def test_stratified_split_exact_shares(spark):
    df = spark.createDataFrame([(i, "pos" if i % 7 == 0 else "neg") for i in range(2000)],
                               "id long, y string")
    out = stratified_split(df, "id", "y", 0.2, 42)
    c = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    n_pos, n_neg = 286, 1714
    assert c[("pos", "test")] == (n_pos * 200 + 500) // 1000
    assert c[("neg", "test")] == (n_neg * 200 + 500) // 1000
    again = stratified_split(df, "id", "y", 0.2, 42)
    assert out.exceptAll(again).count() == 0


def test_hash_split_is_deterministic(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = train_test_split(df, ["k"]).filter("split = 'test'").count()
    b = train_test_split(df.repartition(13), ["k"]).filter("split = 'test'").count()
    assert a == b and 800 < a < 1200


def test_knn_multi_block_equals_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(150, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(150)], "id long, v array<float>")
    got = knn_exact(df, "id", "v", k=5, block_rows=40)   # 4 x 4 cells
    got_map = {}
    for r in got.collect():
        got_map.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"]))
    Xd = X.astype(np.float64)
    for q in range(150):
        d = np.sqrt(((Xd - Xd[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        exp = list(np.lexsort((np.arange(150), d))[:5])
        assert [n for _, n in sorted(got_map[q])] == exp


def test_per_group_least_squares_two_features(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, (b0, b1, b2) in {"a": (1.0, 2.0, -1.0), "b": (5.0, 0.5, 3.0)}.items():
        for _ in range(300):
            x1, x2 = rng.normal(), rng.normal()
            rows.append((g, float(x1), float(x2), b0 + b1 * x1 + b2 * x2))
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, y double")
    got = {r["g"]: r for r in per_group_least_squares(df, "g", ["x1", "x2"], "y").collect()}
    assert got["a"]["coef_x1"] == pytest.approx(2.0) and got["a"]["coef_x2"] == pytest.approx(-1.0)
    assert got["b"]["intercept"] == pytest.approx(5.0) and got["b"]["n"] == 300


def test_auc_with_ties(spark):
    data = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.7), (0, 0.7)]
    df = spark.createDataFrame(data, "y int, s double")
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc(df, "y", "s").first()["auc"] == pytest.approx(exp)


@pytest.mark.parametrize("pieces", [1, 4, 24])
def test_rolling_frames_of_one_length_equal_plain_window(spark, pieces):
    df = _events(spark, n=800).withColumn("one", F.lit(1))
    L = 48 * 3600 * 1_000_000
    got = rolling_frames(df, ["k"], "ts", [("count", "one", "n", L), ("sum", "v", "s", L),
                                            ("max", "v", "mx", L), ("min", "v", "mn", L)], {L: pieces})
    w = Window.partitionBy("k").orderBy(epoch_us("ts")).rangeBetween(-L, 0)
    ref = df.select("id", F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("s"),
                    F.max("v").over(w).alias("mx"), F.min("v").over(w).alias("mn"))
    a = sorted((r["id"], r["n"], r["s"], r["mx"], r["mn"]) for r in got.collect())
    b = sorted((r["id"], r["n"], r["s"], r["mx"], r["mn"]) for r in ref.collect())
    assert a == b


def test_rolling_frames_several_lengths_equal_plain_windows(spark):
    # 30 min / 5 h / 2 d frames in one call, a hot key, exact time ties and NULL inputs
    df = _events(spark, n=900).withColumn("v", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("v")))
    M = 60 * 1_000_000
    lengths = {"a": 30 * M, "b": 300 * M, "c": 48 * 60 * M}
    aggs = []
    for tag, L in lengths.items():
        aggs += [("count", None, f"n_{tag}", L), ("count", "v", f"nv_{tag}", L),
                 ("sum", "v", f"s_{tag}", L), ("max", "v", f"mx_{tag}", L), ("min", "v", f"mn_{tag}", L)]
    got = rolling_frames(df, ["k"], "ts", aggs)
    ref_cols = []
    for tag, L in lengths.items():
        w = Window.partitionBy("k").orderBy(epoch_us("ts")).rangeBetween(-L, 0)
        ref_cols += [F.count(F.lit(1)).over(w).alias(f"n_{tag}"), F.count("v").over(w).alias(f"nv_{tag}"),
                     F.sum("v").over(w).alias(f"s_{tag}"), F.max("v").over(w).alias(f"mx_{tag}"),
                     F.min("v").over(w).alias(f"mn_{tag}")]
    ref = df.select("id", *ref_cols)
    names = ["id"] + [c for _, _, c, _ in aggs]
    a = sorted(tuple(r[c] for c in names) for r in got.select(*names).collect())
    b = sorted(tuple(r[c] for c in names) for r in ref.select(*names).collect())
    assert len(a) == df.count()
    assert a == b


def test_running_total_is_exact_with_payload_and_reruns_agree(spark):
    n = 150_000
    df = spark.range(n).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(1 << 32)).alias("h"), (F.col("id") % 3).alias("g"),
        F.concat(F.lit("payload "), F.col("id").cast("string")).alias("p"))
    got = running_total(df, ["h", "id"], hash_bucket(F.col("h"), 64), group_cols=["g"], out="r", total="n")
    ref = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    j = got.join(ref.select("id", "want"), "id")
    assert j.count() == n and j.filter("r <> want OR n <> 50000").count() == 0
    again = running_total(df.repartition(13), ["h", "id"], hash_bucket(F.col("h"), 64), group_cols=["g"], out="r")
    assert got.select("id", "r").exceptAll(again.select("id", "r")).count() == 0


def test_stratified_split_keeps_rows_without_label(spark):
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3], "x" * i) for i in range(90)],
                               "id long, y string, payload string")
    out = stratified_split(df, "id", "y", 0.2)
    c = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert out.count() == 90 and all(c[(y, "test")] == 6 for y in (None, "a", "b"))


def test_auc_of_many_distinct_scores(spark):
    df = spark.range(40_000).select(
        (F.pmod(F.xxhash64("id"), F.lit(1000)) < 400).cast("int").alias("y"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) / 1e6).alias("s0"))
    df = df.select("y", (F.col("s0") + F.col("y") * 0.2).alias("s"))
    rows = df.collect()
    y = np.array([r["y"] for r in rows])
    rank = np.array([r["s"] for r in rows]).argsort().argsort() + 1
    p, n = y.sum(), len(y) - y.sum()
    want = (rank[y == 1].sum() - p * (p + 1) / 2) / (p * n)
    assert auc(df, "y", "s").first()["auc"] == pytest.approx(want, abs=2e-4)
    assert auc(df, "y", "s").first() == auc(df.repartition(9), "y", "s").first()


def test_kth_smallest_with_nan_and_infinities(spark):
    v = [float("nan"), float("-inf"), 3.0, 1.0, float("inf"), 2.0, -1.7e308, 1.7e308]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "x double")
    want = [float("-inf"), -1.7e308, 1.0, 2.0, 3.0, 1.7e308, float("inf")]
    assert [kth_smallest(df, "x", k) for k in range(1, 8)] == want
    assert np.isnan(kth_smallest(df, "x", 8))
    with pytest.raises(ValueError):
        kth_smallest(df, "x", 9)


def test_outlier_scores_of_constant_and_nan_columns(spark):
    df = spark.createDataFrame([(i, 5.0, float("nan") if i == 3 else float(i)) for i in range(20)],
                               "id long, c double, x double")
    got = {r["id"]: r for r in outlier_scores(df, "id", ["c", "x"], 0.1).collect()}
    assert len(got) == 20 and got[3]["outlier_score"] == 0.0 and got[19]["is_outlier"]


def test_regression_metrics_of_small_and_huge_targets(spark):
    rows = [(0.1 * i, 0.1 * i + (0.01 if i % 2 else -0.01)) for i in range(10)]
    for scale in (1.0, 1e17):
        df = spark.createDataFrame([(a * scale, b * scale) for a, b in rows], "y double, p double")
        m = regression_metrics(df, "y", "p").first()
        assert m["mse"] == pytest.approx(1e-4 * scale * scale) and m["r2"] == pytest.approx(1 - 1e-4 / 0.0825)
    assert regression_metrics(df.filter("false"), "y", "p").first()["mse"] is None


@pytest.mark.parametrize("classes", [1, 3])
def test_probabilities_follow_the_number_of_classes(spark, classes):
    df = spark.createDataFrame([(i, float(i % 7), float(i % classes)) for i in range(120)], "id long, x double, y double")
    m = fit_model(df, ["x"], "y", numTrees=3, maxDepth=3)
    out = predict(m, df, ["x"], ["id"])
    named = [c for c in out.columns if c.startswith("class_")]
    assert len(named) == m.stages[-1].numClasses >= classes
    assert out.filter(F.abs(sum(F.col(c) for c in named) - 1) > 1e-9).count() == 0


def test_forest_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(float(i % 11), float(i % 5), float((i * 7) % 3 == 0)) for i in range(400)],
                               "a double, b double, y double")
    one = fit_model(df.coalesce(1), ["a", "b"], "y", numTrees=5, maxDepth=4)
    many = fit_model(df.repartition(9), ["a", "b"], "y", numTrees=5, maxDepth=4)
    assert feature_importances(one, ["a", "b"]) == feature_importances(many, ["a", "b"])
    assert one.stages[-1].toDebugString.split("\n")[1:] == many.stages[-1].toDebugString.split("\n")[1:]


def test_saved_model_scores_every_non_entity_column(spark):
    from tierline.session import scratch_path
    df = spark.createDataFrame([(i, "e", float(i % 4), float(i % 3), float(i % 4 > 1)) for i in range(80)],
                               "id long, tag string, a double, b double, y double")
    path = save_model(fit_model(df, ["a", "b"], "y", numTrees=3), scratch_path(spark, "m"))
    out = score_saved_model(spark, path, df.select("b", "id", "a", "tag"), ["id", "tag"], prediction_col="p")
    assert out.filter("p <> (CASE WHEN a > 1 THEN 1.0 ELSE 0.0 END)").count() == 0
    with pytest.raises(ValueError):
        score_saved_model(spark, path, df.select("id", "a"), ["id"])


def test_knn_of_a_query_set_on_scaled_features(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3)) * [1.0, 100.0, 0.0]
    items = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(120)], "id long, v array<double>")
    scaled, asked = scaled_vectors(items, "v", items.filter("id < 5"))
    got = {}
    for r in knn_exact(scaled, "id", "v", k=4, block_rows=50, queries=asked).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    dev = x.std(axis=0)
    z = np.where(dev > 0, (x - x.mean(axis=0)) / np.where(dev > 0, dev, 1), 0)
    assert set(got) == set(range(5))
    for q in range(5):
        d = np.sqrt(((z - z[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(120), d))[:4]
        assert [n for _, n, _ in sorted(got[q])] == list(best)
        assert [v for _, _, v in sorted(got[q])] == pytest.approx(list(d[best]), abs=1e-6)


def test_rolling_frames_without_a_time_are_their_peers(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 0, None, 2.0), (2, 0, None, 3.0), (3, 0, base, 4.0), (4, 1, None, 5.0)],
                               "id long, k long, ts timestamp_ntz, v double")
    hour = 3_600_000_000
    got = {r["id"]: (r["n"], r["s"]) for r in rolling_frames(
        df, ["k"], "ts", [("count", None, "n", hour), ("sum", "v", "s", 24 * hour)]).collect()}
    assert got == {1: (2, 5.0), 2: (2, 5.0), 3: (1, 4.0), 4: (1, 5.0)}


def test_rolling_distinct_count_equals_brute_force(spark):
    rnd = random.Random(8)
    base = dt.datetime(2024, 1, 1)
    data = [(i, rnd.choice([0, 0, 1, None]),
             None if rnd.random() < 0.05 else base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 6, 30)),
             None if rnd.random() < 0.1 else rnd.randrange(6)) for i in range(400)]
    df = spark.createDataFrame(data, "id long, k long, ts timestamp_ntz, v long")
    for minutes in (30, 60, 24 * 60):
        got = {r["id"]: r["n"] for r in rolling_distinct_count(
            df, ["k"], "ts", "v", minutes * 60_000_000, "n").collect()}
        length = dt.timedelta(minutes=minutes)
        for i, k, ts, _ in data:
            near = {v for _, k2, t2, v in data if k2 == k and v is not None and (
                t2 is None if ts is None else t2 is not None and ts - length <= t2 <= ts)}
            assert got[i] == len(near), (i, minutes)


def test_knn_leaves_out_vectors_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, None)],
                                  "i long, v array<double>")
    got = knn_exact(items, "i", "v", k=3)
    assert sorted((r["query_id"], r["neighbor_id"]) for r in got.collect()) == [(1, 2), (2, 1)]
    with pytest.raises(ValueError):
        knn_exact(items.unionByName(spark.createDataFrame([(7, [1.0])], "i long, v array<double>")), "i", "v")


def test_elasticity_shrinks_noisy_groups_to_their_category(spark):
    r = random.Random(4)
    rows, kinds = [], []
    for g in range(30):
        n = 200 if g < 20 else 4
        true = -1.0 - 0.05 * (g % 5)
        kinds.append((g, "x"))
        for _ in range(n):
            p = math.exp(r.uniform(0, 1))
            rows.append((g, p, math.exp(true * math.log(p) + r.gauss(0, 0.3))))
    rows += [(30, 2.0, 5.0)] * 5 + [(31, 0.0, 1.0), (31, None, 2.0), (32, 1.0, 1.0)]
    kinds += [(30, "x"), (31, None), (32, "y")]
    got = {x["g"]: x for x in price_elasticity(
        spark.createDataFrame(rows, "g long, p double, q double"), "g", "p", "q",
        spark.createDataFrame(kinds, "g long, c string"), "c").collect()}
    mean = got[0]["category_mean"]
    assert -1.3 < mean < -0.9
    for g in range(30):
        x = got[g]
        assert 0 <= x["weight"] <= 1 and min(x["slope"], mean) - 1e-9 <= x["elasticity"] <= max(x["slope"], mean) + 1e-9
    assert max(got[g]["weight"] for g in range(20, 30)) < min(got[g]["weight"] for g in range(20)) + 0.5
    assert sum(abs(got[g]["elasticity"] + 1.1) for g in range(20, 30)) < sum(abs(got[g]["slope"] + 1.1) for g in range(20, 30))
    assert got[30]["elasticity"] == mean and got[30]["weight"] == 0
    assert got[31]["elasticity"] is None and got[32]["elasticity"] is None and got[31]["n_sales"] == 0


def test_knn_blocks_are_sized_by_their_bytes(spark):
    # 30,000 short vectors: copies to a few cells, not one for every 4,096 rows
    df = spark.range(30_000).selectExpr("id", "array(CAST(id % 97 AS FLOAT)) AS v")
    plan = knn_exact(df, "id", "v")._jdf.queryExecution().analyzed().toString()
    blocks = [int(n) for n in re.findall(r"sequence\(0, (\d+)", plan)]
    assert len(blocks) == 2 and (blocks[0] + 1) * (blocks[1] + 1) <= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("chunk", [3, 50, 1000])
def test_nearest_by_chunks_equals_brute_force(chunk):
    rng = np.random.default_rng(5)
    t = rng.integers(0, 4, size=(200, 3)).astype(float)          # many ties
    tid = np.repeat(np.arange(100), 2)                           # ids come twice
    q, qid = t[:30], tid[:30]
    got = list(_nearest(q, qid, t, tid, 7, True, chunk))
    assert len(got) == 1
    for i in range(30):
        d = np.sqrt(((t - q[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((tid, d)) if tid[j] != qid[i]][:7]
        mine = got[0][0] == i
        assert [tid[j] for j in got[0][1][mine]] == [tid[j] for j in order]
        assert list(got[0][2][mine]) == list(d[order])
