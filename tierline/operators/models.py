"""Model operators on DataFrames: splits, MLlib fits, metrics, kNN, outliers.

Everything data-sized stays in Spark: splits are hash-based (no shuffle, no
random state), metrics are single-pass aggregates, AUC and quantiles use
distributed ranks, kNN is a blocked exact search, per-group regressions
reduce each group to its sufficient statistics first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierline.functions import hash_fraction, safe_ratio
from tierline.operators.ranking import exact_quantile, hash_bucket, range_bucket, running_total
from tierline.session import scratch_path


# --- splits -------------------------------------------------------------------

def train_test_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``split`` = 'test' | 'train' from md5(key ':' seed): per-row,
    reproducible, independent of partitioning (no sort, no shuffle)."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    b = hash_fraction(keys, seed, 1000)
    return df.withColumn("split", F.when(b < int(round(test_size * 1000)), "test").otherwise("train"))


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Exact per-label proportions: within each label, rows ordered by their
    32-bit key hash (then key); the first round(test_size * n_label) are test.
    Rows without a label are a class of their own.  Ranks come from
    :func:`running_total` over 1024 hash buckets, so a big label class is still
    processed by many tasks, and a row's split depends on the row set alone."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8),
               16, 10).cast("bigint")
    ranked = running_total(df.withColumn("_h", h), ["_h", key], hash_bucket(F.col("_h")),
                           group_cols=[label], out="_r", total="_n")
    per_mille = int(round(test_size * 1000))
    n_test = ((F.col("_n") * per_mille + 500) / 1000).cast("bigint")
    return (ranked.withColumn("split", F.when(F.col("_r") <= n_test, "test").otherwise("train"))
                  .drop("_h", "_r", "_n"))


# --- MLlib fits -----------------------------------------------------------------

ESTIMATORS = {
    ("random_forest", "classification"): RandomForestClassifier,
    ("random_forest", "regression"): RandomForestRegressor,
    ("gbt", "classification"): GBTClassifier,
    ("gbt", "regression"): GBTRegressor,
}


def fit_model(train: DataFrame, features: Sequence[str], label: str, framework: str = "random_forest",
              task: str = "classification", scale: bool = False, seed: int = 42,
              fill: float | None = 0.0, partitions: int = 32, **params) -> PipelineModel:
    """Assemble features, optionally scale, fit one estimator.

    ``fill`` replaces NULL features (None: a NULL feature fails the fit).  Rows
    are dealt by a hash of their values into ``partitions`` partitions and sorted
    there, so bootstrap samples, which MLlib draws per partition, and with them
    the model, do not depend on the cluster's size or on file order."""
    if (framework, task) not in ESTIMATORS:
        raise ValueError(f"unsupported framework/task {framework}/{task}")
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw",
                              handleInvalid="error" if fill is None else "keep")]
    feat_col = "_raw"
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True))
        feat_col = "_scaled"
    est = ESTIMATORS[(framework, task)](featuresCol=feat_col, labelCol=label, seed=seed, **params)
    stages.append(est)
    # iterative fits read the input many times (metadata, splits, one pass
    # per tree level / boosting round): keep only the needed columns cached
    # for the duration of the fit, spilling to disk when large
    rows = _filled(train.select(*features, label), features, fill)
    dealt = rows.repartition(partitions, F.xxhash64(*rows.columns)) \
        .sortWithinPartitions(*rows.columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(dealt)
    finally:
        dealt.unpersist()


def _filled(df: DataFrame, features: Sequence[str], fill: float | None) -> DataFrame:
    return df if fill is None else df.fillna(float(fill), subset=list(features))


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str],
            probabilities: bool = True, fill: float | None = 0.0,
            prediction_col: str = "prediction") -> DataFrame:
    """Batch scoring: ``keep`` columns + prediction (+ one ``class_i`` probability
    per class the fitted model knows)."""
    out = model.transform(_filled(df, features, fill))
    cols = [F.col(c) for c in keep] + [F.col("prediction").alias(prediction_col)]
    if probabilities and "probability" in out.columns:
        arr = vector_to_array("probability")
        cols += [arr[i].alias(f"class_{i}") for i in range(model.stages[-1].numClasses)]
    return out.select(*cols)


def save_model(model: PipelineModel, path: str) -> str:
    """Save a fitted pipeline below the shared root; returns its path."""
    model.write().overwrite().save(path)
    return path


def score_saved_model(spark: SparkSession, path: str, df: DataFrame, entity_cols: Sequence[str],
                      prediction_col: str = "prediction", probabilities: bool = True,
                      fill: float | None = 0.0) -> DataFrame:
    """Score ``df`` with a saved pipeline: every column that is not an entity column
    is a feature.  They must be the model's own features (in any order)."""
    model = PipelineModel.load(path)
    wanted = model.stages[0].getInputCols()
    features = [c for c in df.columns if c not in set(entity_cols)]
    if sorted(features) != sorted(wanted):
        raise ValueError(f"the model takes {sorted(wanted)}, the frame has {sorted(features)}")
    return predict(model, df, wanted, [*entity_cols, *features], probabilities, fill, prediction_col)


def feature_importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    imp = model.stages[-1].featureImportances.toArray()
    return [(f, float(v)) for f, v in zip(features, imp)]


# --- metrics --------------------------------------------------------------------

def classification_metrics(df: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """accuracy and support-weighted precision / recall / F1 in two small
    aggregates (confusion counts per class, then a weighted sum)."""
    y, p = F.col(label), F.col(prediction)
    classes = (df.select(y.alias("c")).union(df.select(p.alias("c"))).distinct())
    conf = df.groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = (classes.join(conf, F.col("c") == F.col("y"), "left")
           .groupBy("c").agg(F.sum(F.when(F.col("p") == F.col("c"), F.col("n")).otherwise(0)).alias("tp"),
                             F.sum(F.coalesce(F.col("n"), F.lit(0))).alias("support")))
    pred_n = conf.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("pred_n"))
    per = per.join(pred_n, "c", "left").fillna(0, subset=["pred_n"])
    prec = F.coalesce(safe_ratio(F.col("tp"), F.col("pred_n")), F.lit(0.0))
    rec = F.coalesce(safe_ratio(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(safe_ratio(2.0 * F.col("tp"), F.col("pred_n") + F.col("support")), F.lit(0.0))
    total = F.sum("support")
    return per.agg(
        F.round(safe_ratio(F.sum("tp"), total), 6).alias("accuracy"),
        F.round(safe_ratio(F.sum(prec * F.col("support")), total), 6).alias("precision_weighted"),
        F.round(safe_ratio(F.sum(rec * F.col("support")), total), 6).alias("recall_weighted"),
        F.round(safe_ratio(F.sum(f1 * F.col("support")), total), 6).alias("f1_weighted"),
        total.cast("bigint").alias("n"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MSE and R2 in double on centred values, unrounded.

    The label's mean comes first, so R2 keeps its digits however far the label
    lies from zero; pairs with a NULL side are left out.  A constant label gives
    a NULL R2."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    pairs = df.select(y.alias("y"), p.alias("p")).filter("y IS NOT NULL AND p IS NOT NULL")
    mean = pairs.agg(F.avg("y")).first()[0] or 0.0
    e, d = F.col("y") - F.col("p"), F.col("y") - F.lit(mean)
    a = pairs.agg(F.sum(e * e).alias("sse"), F.sum(d * d).alias("sst"), F.sum(d).alias("sd"),
                  F.count(F.lit(1)).alias("n"))
    sst = F.col("sst") - F.col("sd") * F.col("sd") / F.col("n")
    return a.select(safe_ratio(F.col("sse"), F.col("n")).alias("mse"),
                    (1.0 - safe_ratio(F.col("sse"), sst)).alias("r2"),
                    F.col("n").cast("bigint").alias("n"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC AUC by rank sum with average ranks for tied scores (rows with a NULL
    score or label are left out; NaN is the highest score).

    Rows are first reduced to one row per distinct score (positives,
    negatives), then ranks are running totals over the distinct scores."""
    g = (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
           .groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"),
                               F.count_if(F.col(label) != 1).alias("neg")))
    g = g.withColumn("cnt", F.col("pos") + F.col("neg"))
    r = running_total(g, [score], range_bucket(g, score), "cnt", out="_cum")
    avg_rank = F.col("_cum") - F.col("cnt") + (F.col("cnt") + 1) / 2.0
    s = r.agg(F.sum(F.col("pos") * avg_rank).alias("rsum"), F.sum("pos").alias("P"),
              F.sum("neg").alias("N"))
    u = F.col("rsum") - F.col("P") * (F.col("P") + 1) / 2.0
    return s.select(F.round(safe_ratio(u, F.col("P") * F.col("N")), 6).alias("auc"),
                    F.col("P").cast("bigint").alias("n_pos"), F.col("N").cast("bigint").alias("n_neg"))


# --- scaling, outliers ------------------------------------------------------------

def standard_scale(df: DataFrame, cols: Sequence[str], keep: Sequence[str], digits: int = 6) -> DataFrame:
    """Population z-score per column (like sklearn's StandardScaler).

    The means / deviations are one global aggregate row, read once and
    applied as literals; the scaling itself is a narrow projection."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    st = df.agg(*aggs).first()
    out = [F.col(k) for k in keep]
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        z = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
        out.append(F.round(z, digits).alias(f"{c}_z"))
    return df.select(*out)


def outlier_scores(df: DataFrame, key: str, cols: Sequence[str], contamination: float = 0.05) -> DataFrame:
    """Score = max |population z| over the columns; the top ``contamination``
    share (score above the exact (1 - c) quantile) is flagged.  A stated
    different method from an isolation forest, which MLlib does not have.
    NaN counts as missing; a row without any value scores 0."""
    clean = df.select(key, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols])
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    st = clean.agg(*aggs).first()
    # a constant column (deviation 0) says nothing; NaN and NULL values neither
    zs = [F.abs((F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(st[f"s_{c}"])) for c in cols if st[f"s_{c}"]]
    score = F.greatest(*zs, F.lit(0.0)) if zs else F.lit(0.0)
    # the (key, score) pairs are read by several passes (count, selection
    # rounds, final flag): written once, so nothing stays cached afterwards
    path = scratch_path(df.sparkSession, "outliers")
    clean.select(key, score.alias("outlier_score")).write.parquet(path)
    scored = df.sparkSession.read.parquet(path)
    thr = exact_quantile(scored, "outlier_score", 1.0 - contamination)
    return scored.select(key, F.round("outlier_score", 6).alias("outlier_score"),
                         (F.col("outlier_score") > F.lit(thr)).alias("is_outlier"))


# --- exact kNN ----------------------------------------------------------------------

def scaled_vectors(items: DataFrame, vec_col: str, *others: DataFrame) -> list[DataFrame]:
    """``items`` and ``others`` with each dimension of ``vec_col`` standardized by the
    items' population mean and deviation (a constant dimension becomes 0).  The
    statistics are one row per dimension, applied as literal arrays."""
    st = (items.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("i", "x"))
          .groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect())
    mean = F.array(*[F.lit(r["m"]) for r in st])
    dev = F.array(*[F.lit(r["s"]) for r in st])

    def scaled(df):
        v = F.col(vec_col).cast("array<double>")
        return df.withColumn(vec_col, F.transform(v, lambda x, i: F.when(
            F.get(dev, i) > 0, (x - F.get(mean, i)) / F.get(dev, i)).otherwise(0.0)))
    return [scaled(d) for d in (items, *others)]


def _nearest(q: np.ndarray, qid: np.ndarray, t: np.ndarray, tid: np.ndarray, k: int, skip_self: bool, chunk: int = 4096):
    """(query row, item row, distance) of the k best per query: distances by matrix
    product first, then exactly for all items up to a rounding margin of the k-th.  Items
    come in chunks; after the first, only those within the k-th found so far are looked at."""
    tt = (t * t).sum(axis=1)
    for start in range(0, len(q), 256):
        part, pid = q[start:start + 256], qid[start:start + 256]
        qq = (part * part).sum(axis=1)
        margin = 1e-9 * (qq + tt.max(initial=0.0) + 1.0)
        bound = np.full(len(part), np.inf)
        rows, cols, found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(t), chunk):
            near = part @ t[at:at + chunk].T
            near *= -2.0
            near += tt[at:at + chunk]
            near += qq[:, None]
            if at == 0:
                if skip_self:
                    near[pid[:, None] == tid[None, :chunk]] = np.inf
                kk = min(k, near.shape[1])
                limit = np.partition(near, kk - 1, axis=1)[:, kk - 1] + margin if kk == k else bound
            else:
                limit = bound
            r, c = np.nonzero(near <= limit[:, None])
            new = near[r, c]
            fit = np.isfinite(new)
            if skip_self:
                fit &= pid[r] != tid[c + at]
            if not fit.any():
                continue
            rows, cols = np.concatenate([rows, r[fit]]), np.concatenate([cols, c[fit] + at])
            found = np.concatenate([found, new[fit]])
            order = np.lexsort((found, rows))
            rows, cols, found = rows[order], cols[order], found[order]
            kth = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == k - 1)
            bound[rows[kth]] = found[kth] + margin[rows[kth]]
            keep = found <= bound[rows]
            rows, cols, found = rows[keep], cols[keep], found[keep]
        d = np.sqrt(((part[rows] - t[cols]) ** 2).sum(axis=1))
        order = np.lexsort((tid[cols], d, rows))
        rows, cols, d = rows[order], cols[order], d[order]
        first = np.searchsorted(rows, rows)          # place of the query's first candidate
        best = np.arange(len(rows)) - first < k
        yield rows[best] + start, cols[best], d[best]


def _finite(vec: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True))


def knn_exact(items: DataFrame, id_col: str, vec_col: str, k: int = 10, block_rows: int | None = None,
              exclude_self: bool = True, queries: DataFrame | None = None) -> DataFrame:
    """Exact k nearest items (Euclidean) of every query (default: of every item).

    Queries and items are hashed into blocks of about ``block_rows`` (default: 16 MB of
    doubles, so that copies and candidates, which fall with a block's rows, stay few).  Cell (q, i)
    holds query block q and item block i; a pandas task per cell multiplies the two
    blocks as matrices and keeps each query's k best; a final per-query step keeps
    the k best of its candidates.  Items are copied once per query block and queries
    once per item block: for a bounded query set that is linear in the items, for a
    full self-join it is the inherent quadratic work.  Vectors that are NULL or hold a
    NULL or non-finite component take no part; vectors of unequal length raise."""
    def vectors(df: DataFrame) -> DataFrame:
        # floats are copied as they are and widened in the task
        v = F.col(vec_col) if dict(df.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
        return df.select(F.col(id_col).alias("_id"), v.alias("_v")).filter(_finite("_v"))

    base = vectors(items)
    asked = base if queries is None else vectors(queries)
    sizes = [df.agg(F.count("*").alias("n"), F.min(F.size("_v")).alias("lo"), F.max(F.size("_v")).alias("hi")).first()
             for df in ([base] if queries is None else [base, asked])]
    if len({x for r in sizes for x in (r["lo"], r["hi"]) if x is not None}) > 1:
        raise ValueError(f"{vec_col} holds vectors of unequal length")
    n_items, n_queries = sizes[0]["n"], sizes[-1]["n"]
    block_rows = block_rows or max(1024, (16 << 20) // (8 * max(1, sizes[0]["hi"] or 1)))
    # few item blocks, for few candidates; a few cells per task slot, so small inputs still fan out
    item_blocks = max(1, math.ceil(n_items / block_rows))
    cells = 3 * items.sparkSession.sparkContext.defaultParallelism
    query_blocks = max(math.ceil(n_queries / block_rows), math.ceil(cells / item_blocks))
    h = F.abs(F.xxhash64("_id"))
    left = asked.select("_id", "_v", (h % query_blocks).alias("_q"),
                        F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1)).cast("array<bigint>")).alias("_i"),
                        F.lit(True).alias("_is_q"))
    right = base.select("_id", "_v",
                        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")).alias("_q"),
                        (h % item_blocks).alias("_i"), F.lit(False).alias("_is_q"))

    def best_in_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        is_q = pdf["_is_q"].to_numpy(bool)
        qd, td = pdf[is_q], pdf[~is_q]
        if qd.empty or td.empty:
            return pd.DataFrame({"query_id": [], "neighbor_id": [], "distance": []})
        qid, tid = qd["_id"].to_numpy(), td["_id"].to_numpy()
        qv, tv = (np.stack(d["_v"].to_numpy()).astype(np.float64, copy=False) for d in (qd, td))
        found = list(_nearest(qv, qid, tv, tid, k, exclude_self))
        return pd.DataFrame({"query_id": np.concatenate([qid[r] for r, _, _ in found]),
                             "neighbor_id": np.concatenate([tid[c] for _, c, _ in found]),
                             "distance": np.concatenate([d for _, _, d in found])})

    cand = left.unionByName(right).groupBy("_q", "_i").applyInPandas(
        best_in_cell, "query_id long, neighbor_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select("query_id", "neighbor_id", F.col("rank").cast("int").alias("rank"),
                        F.round("distance", 6).alias("distance")))


# --- per-group least squares ----------------------------------------------------------

def per_group_least_squares(df: DataFrame, group: str, xs: Sequence[str], y: str) -> DataFrame:
    """One linear model per group: y = b0 + sum(b_j x_j).

    Each group is first reduced (partial aggregation, any group size) to its
    means and population covariances; a tiny pandas step per group solves
    the p x p normal equations.  No group's rows are ever collected."""
    xs = list(xs)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias(f"m_{y}")]
    for i, a in enumerate(xs):
        aggs += [F.avg(a).alias(f"m_{a}"), F.covar_pop(a, y).alias(f"cy_{i}")]
        for j, b in enumerate(xs[i:], start=i):
            aggs.append(F.covar_pop(a, b).alias(f"c_{i}_{j}"))
    stats = df.groupBy(group).agg(*aggs)
    p = len(xs)
    out_schema = f"{group} {dict(stats.dtypes)[group]}, intercept double, " + \
        ", ".join(f"coef_{a} double" for a in xs) + ", n bigint"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            c = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    c[i, j] = c[j, i] = r[f"c_{i}_{j}"]
            cy = np.array([r[f"cy_{i}"] for i in range(p)], dtype=float)
            if p == 1:
                beta = np.array([cy[0] / c[0, 0] if c[0, 0] else np.nan])
            else:
                beta = np.linalg.lstsq(c, cy, rcond=None)[0]
            b0 = r[f"m_{y}"] - float(sum(beta[i] * r[f"m_{a}"] for i, a in enumerate(xs)))
            rows.append([r[group], b0, *beta.tolist(), int(r["n"])])
        return pd.DataFrame(rows, columns=[group, "intercept", *[f"coef_{a}" for a in xs], "n"])

    return stats.groupBy(group).applyInPandas(solve, out_schema)

