"""Forecasts per series by exponential smoothing of level, trend and season.

A series is one bounded array of periods, so the sequential part is a fold over that
array, without a window: groups are spread by the one shuffle that collects their
periods.  The fold runs in tasks over Arrow batches of series, all weights at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smoothing weights of level, trend and season that are tried per series.
GRID = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.1) for g in (0.1, 0.3)]


def dense_series(totals: DataFrame, group: Sequence[str], period: str, y: str, last: Column) -> DataFrame:
    """One row per group: ``first``, ``n`` and the array ``y`` of its periods from its own
    first to ``last``; a period without a row is 0."""
    known = totals.filter(F.col(period).isNotNull()).groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(period).alias("p"), F.col(y).cast("double").alias("v")))).alias("_m"),
        F.min(period).alias("first")).withColumn("_last", last)
    full = known.withColumn("y", F.transform(F.sequence("first", "_last"), lambda p: F.coalesce(
        F.try_element_at("_m", p), F.lit(0.0))))
    return full.select(*group, "first", F.size("y").alias("n"), "y")


_FIT = "k int, level double, trend double, season array<double>, sae double, snaive double"


def _fold(series: Sequence[np.ndarray], grid: np.ndarray, m: int) -> pd.DataFrame:
    """Smooths each series (at least three seasons of ``m`` periods) with each row of weights (a, b, g)
    and keeps the weights with the least squared errors before its last ``m`` periods (ties: the
    first): their number, the last state and the absolute errors in the last ``m`` periods."""
    n = np.array([len(y) for y in series])
    data = np.zeros((n.max(), len(series)))
    for i, y in enumerate(series):
        data[:len(y), i] = y
    a, b, g = (grid[:, [c]] for c in range(3))          # weights by series
    # line through the means of the first two seasons; the first season's offsets are from it
    mean, second = (sum(data[s * m + i] for i in range(m)) / float(m) for s in range(2))
    slope, half = (second - mean) / float(m), (m - 1) / 2.0
    wide = (len(grid), len(series))
    level, trend = (np.broadcast_to(x, wide).copy() for x in (mean + slope * half, slope))
    season = np.stack([np.broadcast_to(data[i] - (mean + slope * (i - half)), wide) for i in range(m)])
    sse, sae, snaive = np.zeros(wide), np.zeros(wide), np.zeros(len(series))
    for i in range(m, len(data)):
        v, old = data[i], season[i % m]
        there, held = i < n, i >= n - m
        base = level + trend
        error = v - (base + old)
        new = a * (v - old) + (1.0 - a) * base
        season[i % m] = np.where(there, g * (v - new) + (1.0 - g) * old, old)
        trend = np.where(there, b * (new - level) + (1.0 - b) * trend, trend)
        level = np.where(there, new, level)
        sse += np.where(there & ~held, error * error, 0.0)
        sae += np.where(there & held, np.abs(error), 0.0)
        snaive += np.where(there & held, np.abs(v - data[i - m]), 0.0)
    k = np.lexsort((sse, np.isnan(sse)), axis=0)[0]
    at = np.arange(len(series))
    return pd.DataFrame({"k": k.astype(np.int32), "level": level[k, at], "trend": trend[k, at],
                         "season": list(season[:, k, at].T), "sae": sae[k, at], "snaive": snaive})


def _fitted(grid: Sequence[tuple[float, float, float]], m: int, block: int = 4096):
    weights = np.array([[float(x) for x in w] for w in grid])

    @F.pandas_udf(_FIT)
    def fit(y: pd.Series) -> pd.DataFrame:
        long = np.flatnonzero(y.map(len).to_numpy() >= 3 * m)
        out = pd.DataFrame({"k": np.zeros(len(y), np.int32), **{c: np.nan for c in ("level", "trend")},
                            "season": [[]] * len(y), "sae": np.nan, "snaive": np.nan})
        parts = [_fold([y.iloc[i] for i in long[s:s + block]], weights, m) for s in range(0, len(long), block)]
        if parts:
            done = pd.concat(parts).set_axis(long)
            out = pd.concat([out.drop(index=long), done]).sort_index()
        return out

    return fit


def seasonal_forecast(totals: DataFrame, group: Sequence[str], period: str, y: str, season: int = 12,
                      horizon: int = 3, grid: Sequence[tuple[float, float, float]] = GRID) -> DataFrame:
    """Additive seasonal smoothing per group and its next ``horizon`` periods.

    ``totals`` has one row per (group, period), ``period`` a whole number that counts up by
    one; each series runs from its first period to the last one of all.  Of the weights in
    ``grid`` those with the least squared one-step errors before the last season are taken
    (ties: the first), so the last season judges them: ``mae`` is the mean absolute error of
    one-step forecasts there, each from the periods before it alone, ``naive_mae`` that of
    last season's value.  Series shorter than three seasons have NULL in all these.
    Columns: group, n_periods, horizon, period, forecast, alpha, beta, gamma, mae, naive_mae."""
    m = season
    last = totals.agg(F.max(period)).scalar()
    series = dense_series(totals, group, period, y, last)
    weights = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(g)).alias("g"))
                        for a, b, g in grid])

    best = F.when(F.col("n") >= 3 * m, _fitted(grid, m)("y"))
    chosen = series.withColumn("_best", best)
    fit, w = F.col("_best"), F.get(weights, F.col("_best.k"))
    ahead = chosen.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = fit["level"] + F.col("horizon") * fit["trend"] + F.get(fit["season"], (F.col("n") + F.col("horizon") - 1) % m)
    return ahead.select(*group, F.col("n").alias("n_periods"), "horizon",
                        (F.col("first") + F.col("n") - 1 + F.col("horizon")).alias("period"), value.alias("forecast"),
                        w["a"].alias("alpha"), w["b"].alias("beta"), w["g"].alias("gamma"),
                        (fit["sae"] / float(m)).alias("mae"), (fit["snaive"] / float(m)).alias("naive_mae"))
