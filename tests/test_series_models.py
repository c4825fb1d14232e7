"""Forecasts per series and the isolation forest on literal frames."""

import math

import numpy as np
from pyspark.sql import functions as F

from tierline.operators.forecast import GRID, seasonal_forecast
from tierline.operators.isolation import fit_isolation_forest, grow_trees, isolation_scores, sample_rows
from helpers import rows


def _smooth(y, m, a, b, g):
    """Plain Python: state after all periods, squared errors before the last season, absolute ones in it."""
    mean = sum(y[:m]) / m
    trend = (sum(y[m:2 * m]) / m - mean) / m
    season = [v - (mean + trend * (i - (m - 1) / 2)) for i, v in enumerate(y[:m])]
    level = mean + trend * (m - 1) / 2
    sse = sae = snaive = 0.0
    for i in range(m, len(y)):
        v, old = y[i], season[i % m]
        error = v - (level + trend + old)
        new = a * (v - old) + (1 - a) * (level + trend)
        trend, level = b * (new - level) + (1 - b) * trend, new
        season[i % m] = g * (v - new) + (1 - g) * old
        if i >= len(y) - m:
            sae, snaive = sae + abs(error), snaive + abs(v - y[i - m])
        else:
            sse += error * error
    return level, trend, season, sse, sae, snaive


def test_forecast_matches_a_plain_loop(spark):
    rng, m, grid = np.random.default_rng(1), 4, [(0.2, 0.1, 0.3), (0.7, 0.0, 0.1)]
    data, expect = [], {}
    for store, n in ((1, 20), (2, 12), (3, 11), (None, 15)):
        y = [float(rng.integers(0, 50)) for _ in range(n)]
        data += [(store, 100 + 20 - n + i, v) for i, v in enumerate(y) if i in (0, n - 1) or i % 5]
        y = [v if i in (0, n - 1) or i % 5 else 0.0 for i, v in enumerate(y)]     # gaps are zero
        expect[store] = y
    df = spark.createDataFrame(data, "store long, month int, units double")
    got = {(r["store"], r["horizon"]): r for r in seasonal_forecast(
        df, ["store"], "month", "units", season=m, horizon=5, grid=grid).collect()}
    assert len(got) == 4 * 5
    for store, y in expect.items():
        fits = [_smooth(y, m, *w) for w in grid] if len(y) >= 3 * m else []
        for h in range(1, 6):
            r = got[store, h]
            assert (r["n_periods"], r["period"]) == (len(y), 119 + h)
            if not fits:
                assert r["forecast"] is None and r["mae"] is None and r["alpha"] is None
                continue
            k = min(range(len(grid)), key=lambda i: (fits[i][3], i))
            level, trend, season, _, sae, snaive = fits[k]
            assert math.isclose(r["forecast"], level + h * trend + season[(len(y) + h - 1) % m], rel_tol=1e-9)
            assert (r["alpha"], r["beta"], r["gamma"]) == grid[k]
            assert math.isclose(r["mae"], sae / m, rel_tol=1e-9) and math.isclose(r["naive_mae"], snaive / m)


def test_forecast_follows_a_clean_season_and_takes_empty_input(spark):
    data = [(1, i, 100.0 + 2 * i + (30.0 if i % 12 == 5 else 0.0)) for i in range(48)]
    df = spark.createDataFrame(data, "store long, month int, units double")
    for r in seasonal_forecast(df, ["store"], "month", "units", horizon=12).collect():
        i = r["period"]
        assert abs(r["forecast"] - (100 + 2 * i + (30 if i % 12 == 5 else 0))) < 1e-6
        assert r["mae"] < 1e-6 < r["naive_mae"]
    assert seasonal_forecast(df.filter("false"), ["store"], "month", "units").collect() == []


def _walk(model, row):
    """One row through every tree, node by node."""
    total = 0.0
    for column, cut, path in zip(model.column, model.cut, model.path):
        node = 0
        while column[node] >= 0:
            node = 2 * node + (1 if row[column[node]] < cut[node] else 2)
        total += path[node]
    n = model.size
    c = 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return 2 ** (-total / len(model.path) / c)


def _table(spark, hot=0):
    rng = np.random.default_rng(3)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    data += [(1000 + i, 9.0 + i, -9.0) for i in range(6)]
    data += [(2000 + i, 0.25, 0.25) for i in range(hot)]
    return spark.createDataFrame(data, "id long, a double, b double")


def test_isolation_scores_equal_a_row_by_row_walk_and_reruns(spark):
    df = _table(spark)
    model = fit_isolation_forest(df, ["a", "b"], trees=30, sample=64)
    got = {r["id"]: r["anomaly_score"] for r in isolation_scores(df, "id", ["a", "b"], trees=30, sample=64).collect()}
    for r in df.collect():
        assert abs(got[r["id"]] - _walk(model, (r["a"], r["b"]))) < 1e-8
    again = isolation_scores(df.repartition(7), "id", ["a", "b"], trees=30, sample=64)
    assert {r["id"]: r["anomaly_score"] for r in again.collect()} == got


def test_planted_outliers_rank_above_the_95th_percentile(spark):
    for hot in (0, 700):                                    # also beside one value of half of all rows
        out = isolation_scores(_table(spark, hot), "id", ["a", "b"]).collect()
        flagged = {r["id"] for r in out if r["is_outlier"]}
        assert set(range(1000, 1006)) <= flagged
        assert len(flagged) <= 0.05 * len(out) + 1


def test_isolation_sample_is_bounded_and_not_filled_by_copies(spark):
    copies = spark.range(5000).select(F.lit(1.0).alias("x0")).union(
        spark.range(3000).select(F.col("id").cast("double")))
    s = sample_rows(copies, 200, 1)
    assert len(s) == 200 and len(np.unique(s)) == 200


def test_isolation_missing_constant_and_empty(spark):
    rows_ = [(i, float(i % 7), 5.0) for i in range(50)] + [(50, None, 5.0), (51, float("nan"), None), (52, float("inf"), 5.0)]
    df = spark.createDataFrame(rows_, "id long, a double, b double")
    got = isolation_scores(df, "id", ["a", "b"], trees=10, sample=16).collect()
    assert len(got) == 53 and all(0.0 <= r["anomaly_score"] <= 1.0 for r in got)
    assert rows(isolation_scores(df.filter("false"), "id", ["a", "b"])) == []
    one = isolation_scores(df.filter("id = 1"), "id", ["a", "b"], trees=5).collect()
    assert len(one) == 1 and not one[0]["is_outlier"]
    flat = grow_trees(np.full((10, 2), 3.0), 3, 8, 1)
    assert (flat.column == -1).all()


def test_forecast_folds_series_in_batches(spark):
    # all weights of a batch of series at once, in one Python step; no lambda per period and weight
    data = spark.range(600).selectExpr("id % 5 AS g", "CAST(id DIV 5 AS INT) AS month", "CAST(id * 7 % 11 AS DOUBLE) AS u") \
        .filter("month >= g * 25")
    got = seasonal_forecast(data, ["g"], "month", "u", season=12, horizon=1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan
    for r in got.collect():         # 120, 95, 70, 45 and 20 periods, the last too short
        y = [float((m * 5 + r["g"]) * 7 % 11) for m in range(r["g"] * 25, 120)]
        fits = [_smooth(y, 12, *w) for w in GRID] if len(y) >= 36 else []
        if not fits:
            assert r["forecast"] is None and r["mae"] is None
            continue
        k = min(range(len(GRID)), key=lambda i: (fits[i][3], i))
        level, trend, season, _, sae, _ = fits[k]
        assert (r["alpha"], r["beta"], r["gamma"]) == GRID[k]
        assert math.isclose(r["forecast"], level + trend + season[len(y) % 12], rel_tol=1e-9)
        assert math.isclose(r["mae"], sae / 12, rel_tol=1e-9)
