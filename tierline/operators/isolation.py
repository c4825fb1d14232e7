"""Isolation forest: random split trees over a bounded sample, scored on all rows.

A tree cuts a few hundred sampled rows at random columns and random values until a row is
alone or the depth limit is reached; rows that are cut off early are unusual.  The
sample is the one bounded, documented parameter (``trees * sample`` rows).  Every row of the
table is scored: each task walks a batch of rows through all trees at once, one NumPy step
per tree and level, so a row costs ``trees * depth`` array reads and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.operators.ranking import exact_quantile
from tierline.session import scratch_path

EULER = 0.5772156649015329


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows: what a leaf of n rows adds."""
    n = np.asarray(n, dtype=np.float64)
    many = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(many - 1) + EULER) - 2 * (n - 1) / many, np.where(n == 2, 1.0, 0.0))


class IsolationTrees:
    """Trees as arrays: node i has children 2i + 1 (value below the cut) and 2i + 2.

    ``column`` is -1 at a leaf, whose ``path`` is its depth plus :func:`expected_path` of its rows."""

    def __init__(self, column: np.ndarray, cut: np.ndarray, path: np.ndarray, depth: int, size: int):
        self.column, self.cut, self.path, self.depth, self.size = column, cut, path, depth, size

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), 0 to 1, high is unusual.  NaN goes to the upper side."""
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for column, cut, path in zip(self.column, self.cut, self.path):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                c = column[node]
                below = x[rows, np.maximum(c, 0)] < cut[node]
                node = np.where(c < 0, node, 2 * node + np.where(below, 1, 2))
            total += path[node]
        return np.power(2.0, -total / len(self.path) / max(float(expected_path(self.size)), 1.0))


def grow_trees(rows: np.ndarray, trees: int, sample: int, seed: int) -> IsolationTrees:
    """Trees of ``sample`` rows each, taken from ``rows`` without repetition within a tree."""
    size = min(sample, len(rows))
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    nodes = 2 ** (depth + 1) - 1
    column = np.full((trees, nodes), -1, dtype=np.int64)
    cut, path = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        todo = [(0, 0, rows[rng.choice(len(rows), size, replace=False)])]
        while todo:
            node, level, part = todo.pop()
            lo = np.fmin.reduce(part, axis=0) if len(part) else np.empty(0)
            hi = np.fmax.reduce(part, axis=0) if len(part) else np.empty(0)
            open_ = np.flatnonzero(lo < hi)            # NaN and constant columns cannot be cut
            if level == depth or len(part) < 2 or not len(open_):
                path[t, node] = level + float(expected_path(len(part)))
                continue
            c = int(rng.choice(open_))
            at = lo[c] + (hi[c] - lo[c]) * (1.0 - rng.random())     # in (lo, hi]: both sides get rows
            column[t, node], cut[t, node] = c, at
            below = part[:, c] < at
            todo += [(2 * node + 1, level + 1, part[below]), (2 * node + 2, level + 1, part[~below])]
    return IsolationTrees(column, cut, path, depth, size)


def sample_rows(values: DataFrame, n: int, seed: int) -> np.ndarray:
    """About ``n`` distinct rows (all, if fewer) with the least hashes of their values.

    The hash of the values decides, so equal rows are one candidate, however many a table
    holds: a value that a third of all rows share cannot fill the sample.  Only
    rows below a cut of the hash, set from the number of distinct rows, leave the executors."""
    cols = values.columns
    distinct = values.groupBy(*cols).agg(F.xxhash64(F.lit(seed), *cols).alias("_h"))
    total = distinct.count()
    if total > 2 * n:
        distinct = distinct.filter(F.col("_h") < F.lit(int(-2 ** 63 + 2 ** 64 * (1.2 * n / total))))
    pdf = distinct.toPandas().sort_values(["_h", *cols])[:n]
    return pdf[cols].to_numpy(dtype=np.float64)


def fit_isolation_forest(df: DataFrame, cols: Sequence[str], trees: int = 100, sample: int = 256,
                         seed: int = 42) -> IsolationTrees:
    """The model: ``trees`` arrays of at most ``4 * sample`` nodes, the same for the same rows."""
    values = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    rows = sample_rows(values, trees * sample, seed)
    if not len(rows):
        rows = np.zeros((1, len(cols)))
    return grow_trees(np.where(np.isfinite(rows), rows, np.nan), trees, sample, seed)


def isolation_scores(df: DataFrame, key: str, cols: Sequence[str], contamination: float = 0.05,
                     trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Per row: key, ``anomaly_score`` (0 to 1) and ``is_outlier`` (score above the exact
    ``1 - contamination`` quantile of all rows).

    NULL, NaN and infinite values count as missing and take the upper side of every cut.
    Equal rows have equal scores; reruns agree.  Empty input: empty output."""
    model = fit_isolation_forest(df, cols, trees, sample, seed)
    names = [f"x{i}" for i in range(len(cols))]

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
        return pd.Series(model.scores(np.where(np.isfinite(x), x, np.nan)))

    rows = df.select(key, *[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)])
    # read by several passes (count, quantile, flag): written once
    path = scratch_path(df.sparkSession, "isolation")
    rows.select(key, F.round(score(*names), 9).alias("anomaly_score")).write.parquet(path)
    scored = df.sparkSession.read.parquet(path)
    limit = exact_quantile(scored, "anomaly_score", 1.0 - contamination)
    return scored.withColumn("is_outlier", F.col("anomaly_score") > F.lit(limit))
