"""Exact running totals / ranks over a global order, without one-task windows.

``Window.orderBy(x)`` with no partition key (or a handful of keys) pulls all
rows into a single task.  Instead every row gets a bucket that is a pure
function of its order value (:func:`hash_bucket`, :func:`range_bucket`),
rows are numbered inside their bucket, and each bucket's offset -- the total of
all earlier buckets, a table with one row per (group, bucket) -- is joined
back.  Both sides of that join see the same bucket for a row whatever plan,
sample or retry computed it, so the result is the same on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(h: Column, buckets: int = 1024) -> Column:
    """Bucket of a 32-bit hash value: ``floor(h * buckets / 2^32)``."""
    return F.shiftright(h.cast("bigint") * F.lit(buckets), 32).cast("int")


def range_bucket(df: DataFrame, col: str, buckets: int = 256) -> Column:
    """Bucket of ``col`` by bounds computed once and written into the plan as
    literals: how many bounds are at or below the value (NULL: 0)."""
    x = F.col(col).cast("double")
    probs = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(x, probs, 10000).alias("b")).first()["b"] or []
    cuts = sorted({b for b in bounds if b is not None})
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in cuts]), lambda b: b <= x))


def running_total(df: DataFrame, order_cols: Sequence[str | Column], bucket: Column,
                  weight: str | Column | None = None, group_cols: Sequence[str] = (),
                  out: str = "_cum", total: str | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` (default 1 = row number) in
    ``order_cols`` order within each group (NULL is a group).

    ``order_cols`` must make the order total (add a unique key as the last
    column); ``bucket`` must be a function of the row that never decreases
    along that order (NULL counts as first).  ``total`` names an extra column with the group's sum."""
    w_col = F.lit(1).cast("bigint") if weight is None else (
        F.col(weight) if isinstance(weight, str) else weight)
    staged = df.withColumn("_w", w_col).withColumn("_b", F.coalesce(bucket, F.lit(-1)))
    local = Window.partitionBy(*group_cols, "_b").orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy(*group_cols).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*group_cols)
    sums = staged.groupBy(*group_cols, "_b").agg(F.sum("_w").alias("_tot"))
    offsets = sums.select(*[F.col(g).alias(f"_g_{i}") for i, g in enumerate(group_cols)],
                          F.col("_b").alias("_ob"),
                          F.coalesce(F.sum("_tot").over(along), F.lit(0)).alias("_off"),
                          F.sum("_tot").over(group).alias("_all"))
    same = F.col("_b") == F.col("_ob")
    for i, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{i}"))
    joined = staged.withColumn("_local", F.sum("_w").over(local)).join(offsets, same) \
        .withColumn(out, F.col("_local") + F.col("_off"))
    if total:
        joined = joined.withColumn(total, F.col("_all"))
    return joined.select(*df.columns, out, *([total] if total else []))


def kth_smallest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """Exact k-th smallest (1-based) non-null value of ``col``; NaN counts as
    larger than any number, as in Spark's own order.

    Histogram refinement, the same at every size: count the values per
    equal-width bin over the current [lo, hi] range (a scan + a small grouped
    aggregate, at most ``bins`` rows reach the driver), keep only the bin
    holding rank k, and repeat on it until one value is left.  A round always
    separates the smallest value from the largest."""
    x = F.col(col).cast("double")
    values = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    inf = float("inf")
    st = values.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("_x")).alias("nan"),
                    F.count_if(F.col("_x") == -inf).alias("low"),
                    F.count_if(F.col("_x") == inf).alias("high")).first()
    n, nan, low, high = st["n"], st["nan"], st["low"], st["high"]
    if k < 1 or k > n:
        raise ValueError(f"rank {k} outside 1..{n}")
    if k <= low:
        return -inf
    if k > n - nan:
        return float("nan")
    if k > n - nan - high:
        return inf
    k -= low
    cand = values.filter(~F.isnan("_x") & (F.abs("_x") != inf))
    for _ in range(400):
        st = cand.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
        lo, hi = st["lo"], st["hi"]
        if lo == hi:
            return float(lo)
        # halves keep the difference of two huge values finite
        step = hi / 2 - lo / 2
        share = (F.col("_x") / 2 - F.lit(lo / 2)) / F.lit(step)
        b = F.when(F.col("_x") == F.lit(hi), F.lit(bins - 1)).when(F.col("_x") == F.lit(lo), F.lit(0)) \
            .otherwise(F.least(F.floor(share * bins), F.lit(bins - 1))).cast("int")
        counts = sorted((r["b"], r["c"]) for r in
                        cand.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect())
        before = 0
        for bucket, c in counts:
            if before + c >= k:
                k -= before
                cand = cand.filter(b == F.lit(bucket))
                break
            before += c
    raise RuntimeError(f"no single value left for rank {k} of {col}")


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Linear-interpolated quantile (like ``percentile`` / ``quantile_cont``)
    from two exact order statistics; see :func:`kth_smallest`."""
    vals = df.select(F.col(col).cast("double").alias(col)).filter(F.col(col).isNotNull())
    n = vals.count()
    if n == 0:
        return None
    pos = q * (n - 1)
    lo = int(pos)
    a = kth_smallest(vals, col, lo + 1)
    if pos == lo or lo + 1 >= n:
        return a
    # the next order statistic: a again if enough ties, else the next value up
    le = vals.filter(F.col(col) <= F.lit(a)).count()
    b = a if le >= lo + 2 else vals.filter(F.col(col) > F.lit(a)).agg(F.min(col)).first()[0]
    return a + (b - a) * (pos - lo)
