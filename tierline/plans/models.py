"""Model queries: entity frames, splits, metrics, scaling, outliers, kNN,
per-group regressions, and MLlib fits / batch scoring (rows-only checks).

Order-level training frame: each order with its line items aggregated
(lines, units, discount, extended price); label = order completed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions import round_double
from tierline.operators.isolation import isolation_scores
from tierline.operators.models import (
    auc, classification_metrics, feature_importances, fit_model, knn_exact, outlier_scores,
    per_group_least_squares, predict, regression_metrics, save_model, scaled_vectors, score_saved_model,
    standard_scale, stratified_split, train_test_split,
)
from tierline.operators.sinks import write_parquet
from tierline.plans.common import t
from tierline.session import scratch_path

ORDER_FEATURES = ["n_lines", "total_qty", "avg_discount", "total_ext"]


def order_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Line items are aggregated per order before the 1:1 join."""
    li = (t(spark, sf, "lineitem").groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("total_qty"),
               F.avg("l_discount").alias("avg_discount"),
               F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total_ext")))
    o = t(spark, sf, "orders")
    return (o.join(li, o.o_orderkey == li.l_orderkey, "inner")
             .select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate",
                     F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
                     *ORDER_FEATURES))


ORDER_FRAME_SQL = """
SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority, o.o_totalprice, o.o_orderdate,
       CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
       l.n_lines, l.total_qty, l.avg_discount, l.total_ext
FROM orders o JOIN (
  SELECT l_orderkey, COUNT(*) AS n_lines, SUM(l_quantity) AS total_qty, AVG(l_discount) AS avg_discount,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_ext
  FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
"""


def train_entity_df(spark: SparkSession, sf: str) -> DataFrame:
    """DISTINCT (entity, timestamp, label) rows in a date range (BETWEEN)."""
    o = t(spark, sf, "orders")
    return (o.filter(F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"),
                                                  F.lit("1998-12-31").cast("timestamp_ntz")))
             .select(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("event_timestamp"),
                     F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
             .distinct())


TRAIN_ENTITY_SQL = """
SELECT DISTINCT o_custkey AS customer_id, o_orderdate AS event_timestamp,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1998-12-31 00:00:00'
"""


def train_test_split_q(spark: SparkSession, sf: str) -> DataFrame:
    return train_test_split(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"),
                            ["o_orderkey"], 0.2, 42)


SPLIT_SQL = """
SELECT o_orderkey, o_orderstatus,
       CASE WHEN ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT % 1000 < 200
            THEN 'test' ELSE 'train' END AS split
FROM orders
"""


def stratified_split_q(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"),
                            "o_orderkey", "o_orderstatus", 0.2, 42)


STRATIFIED_SQL = """
WITH h AS (SELECT o_orderkey, o_orderstatus,
                  ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT AS hv FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY hv, o_orderkey) AS rn,
             COUNT(*) OVER (PARTITION BY o_orderstatus) AS n FROM h)
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= (n * 200 + 500) // 1000 THEN 'test' ELSE 'train' END AS split
FROM r
"""


def stratified_split_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The same split with every column of the orders carried along."""
    o = t(spark, sf, "orders")
    return stratified_split(o, "o_orderkey", "o_orderstatus", 0.2, 42)


STRATIFIED_WIDE_SQL = STRATIFIED_SQL.replace("SELECT o_orderkey, o_orderstatus,\n", "SELECT *,\n", 1) \
    .replace("SELECT o_orderkey, o_orderstatus, CASE", "SELECT * EXCLUDE (hv, rn, n), CASE")


def metrics_classification(spark: SparkSession, sf: str) -> DataFrame:
    """label = document quality, prediction = not toxic."""
    lab = t(spark, sf, "labels")
    return classification_metrics(lab.select(F.col("quality").alias("label"),
                                             (1 - F.col("toxic")).alias("prediction")))


METRICS_CLASSIFICATION_SQL = """
WITH d AS (SELECT quality AS y, 1 - toxic AS p FROM labels),
classes AS (SELECT y AS c FROM d UNION SELECT p FROM d),
conf AS (SELECT y, p, COUNT(*) AS n FROM d GROUP BY y, p),
per AS (SELECT cl.c, COALESCE(SUM(CASE WHEN conf.p = cl.c THEN conf.n ELSE 0 END), 0) AS tp,
               COALESCE(SUM(conf.n), 0) AS support
        FROM classes cl LEFT JOIN conf ON conf.y = cl.c GROUP BY cl.c),
pn AS (SELECT p AS c, SUM(n) AS pred_n FROM conf GROUP BY p),
m AS (SELECT per.*, COALESCE(pn.pred_n, 0) AS pred_n FROM per LEFT JOIN pn ON per.c = pn.c)
SELECT ROUND(CAST(SUM(tp) AS DOUBLE) / SUM(support), 6) AS accuracy,
       ROUND(SUM(COALESCE(CAST(tp AS DOUBLE) / NULLIF(pred_n, 0), 0.0) * support) / SUM(support), 6) AS precision_weighted,
       ROUND(SUM(COALESCE(CAST(tp AS DOUBLE) / NULLIF(support, 0), 0.0) * support) / SUM(support), 6) AS recall_weighted,
       ROUND(SUM(COALESCE(2.0 * tp / NULLIF(pred_n + support, 0), 0.0) * support) / SUM(support), 6) AS f1_weighted,
       CAST(SUM(support) AS BIGINT) AS n
FROM m
"""


def metrics_regression(spark: SparkSession, sf: str) -> DataFrame:
    """label = order total, prediction = sum of its line extended prices."""
    f = order_frame(spark, sf)
    m = regression_metrics(f, "o_totalprice", "total_ext")
    return m.select(F.round("mse", 0).alias("mse"), F.round("r2", 6).alias("r2"), "n")


def _regression_sql(frame: str, y: str, p: str, digits: int) -> str:
    return f"""
WITH d AS (SELECT CAST({y} AS DOUBLE) AS y, CAST({p} AS DOUBLE) AS p FROM ({frame}) f),
m AS (SELECT AVG(y) AS my FROM d),
a AS (SELECT SUM((y - p) * (y - p)) AS sse, SUM((y - my) * (y - my)) AS sst, COUNT(*) AS n FROM d, m)
SELECT ROUND(sse / n, {digits}) AS mse, ROUND(1.0 - sse / NULLIF(sst, 0), 6) AS r2, CAST(n AS BIGINT) AS n
FROM a
"""


METRICS_REGRESSION_SQL = _regression_sql(ORDER_FRAME_SQL, "o_totalprice", "total_ext", 0)


def metrics_regression_unit(spark: SparkSession, sf: str) -> DataFrame:
    """A target in 0..1: a line's discount against its tax."""
    m = regression_metrics(t(spark, sf, "lineitem"), "l_discount", "l_tax")
    return m.select(F.round("mse", 9).alias("mse"), F.round("r2", 6).alias("r2"), "n")


METRICS_REGRESSION_UNIT_SQL = _regression_sql("SELECT * FROM lineitem", "l_discount", "l_tax", 9)


def metrics_auc(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of document length as a score for the quality label."""
    lab = t(spark, sf, "labels").select("doc_id", "quality")
    docs = t(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return auc(lab.join(docs, "doc_id"), "quality", "score")


METRICS_AUC_SQL = """
WITH d AS (SELECT l.quality AS y, CAST(doc.n_chars AS DOUBLE) AS s
           FROM labels l JOIN documents doc ON l.doc_id = doc.doc_id),
g AS (SELECT s, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg, COUNT(*) AS cnt
      FROM d WHERE s IS NOT NULL AND y IS NOT NULL GROUP BY s),
r AS (SELECT *, SUM(cnt) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g)
SELECT ROUND((SUM(pos * (cum - cnt + (cnt + 1) / 2.0)) - SUM(pos) * (SUM(pos) + 1) / 2.0)
             / NULLIF(CAST(SUM(pos) AS DOUBLE) * SUM(neg), 0), 6) AS auc,
       CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg
FROM r
"""

def auc_scores(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of a nearly unique score: order total against order completed."""
    o = t(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), "o_totalprice")
    return auc(o, "y", "o_totalprice")


AUC_SCORES_SQL = METRICS_AUC_SQL.replace("""SELECT l.quality AS y, CAST(doc.n_chars AS DOUBLE) AS s
           FROM labels l JOIN documents doc ON l.doc_id = doc.doc_id""",
                                         """SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
                  o_totalprice AS s FROM orders""")

SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def standard_scale_q(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem")
    return standard_scale(li, SCALE_COLS, ["l_orderkey", "l_linenumber"])


STANDARD_SCALE_SQL = "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"ROUND(({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER (), 6) AS {c}_z" for c in SCALE_COLS) + \
    " FROM lineitem"

OUTLIER_COLS = ["o_totalprice", "n_lines", "total_qty"]


def outlier_score(spark: SparkSession, sf: str) -> DataFrame:
    return outlier_scores(order_frame(spark, sf), "o_orderkey", OUTLIER_COLS, 0.05)


OUTLIER_SQL = f"""
WITH f AS ({ORDER_FRAME_SQL}),
z AS (SELECT o_orderkey, GREATEST({", ".join(
    f"ABS(({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER ())" for c in OUTLIER_COLS)}) AS sc FROM f)
SELECT o_orderkey, ROUND(sc, 6) AS outlier_score, sc > quantile_cont(sc, 0.95) OVER () AS is_outlier FROM z
"""


def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Isolation forest over the same columns.  Random trees have no SQL form: the
    tests hold it against a row-by-row walk and planted outliers."""
    return isolation_scores(order_frame(spark, sf), "o_orderkey", OUTLIER_COLS, 0.05)


def knn_exact_q(spark: SparkSession, sf: str) -> DataFrame:
    return knn_exact(t(spark, sf, "embeddings"), "vec_id", "embedding", k=10)


KNN_SQL = """
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
                  list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rn FROM p)
SELECT query_id, neighbor_id, CAST(rn AS INTEGER) AS rank, ROUND(d, 6) AS distance FROM r WHERE rn <= 10
"""


def knn_queries(spark: SparkSession, sf: str) -> DataFrame:
    """A query set (every id divisible by 20) against all items, on scaled features."""
    items = t(spark, sf, "embeddings").select("vec_id", "embedding")
    scaled, asked = scaled_vectors(items, "embedding", items.filter("vec_id % 20 = 0"))
    return knn_exact(scaled, "vec_id", "embedding", k=10, queries=asked)


KNN_QUERIES_SQL = """
WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
st AS (SELECT i, AVG(x) AS m, STDDEV_POP(x) AS s FROM x GROUP BY i),
e AS (SELECT x.vec_id, list(CASE WHEN st.s > 0 THEN (x.x - st.m) / st.s ELSE 0.0 END ORDER BY x.i) AS v
      FROM x JOIN st ON x.i = st.i GROUP BY x.vec_id),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS d
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rn FROM p)
SELECT query_id, neighbor_id, CAST(rn AS INTEGER) AS rank, ROUND(d, 6) AS distance FROM r WHERE rn <= 10
"""


def model_per_group(spark: SparkSession, sf: str) -> DataFrame:
    f = order_frame(spark, sf).withColumn("total_k", F.col("o_totalprice") / 1000.0)
    m = per_group_least_squares(f, "o_orderpriority", ["n_lines"], "total_k")
    return m.select("o_orderpriority", round_double("intercept", 4).alias("intercept"),
                    round_double("coef_n_lines", 4).alias("coef_n_lines"), "n")


MODEL_PER_GROUP_SQL = f"""
SELECT o_orderpriority, ROUND(regr_intercept(o_totalprice / 1000.0, n_lines), 4) AS intercept,
       ROUND(regr_slope(o_totalprice / 1000.0, n_lines), 4) AS coef_n_lines, COUNT(*) AS n
FROM ({ORDER_FRAME_SQL}) f GROUP BY o_orderpriority
"""


# --- MLlib fits ---------------------------------------------------------------------
# A tree's splits cannot be recomputed in SQL.  What the keys return can be: every
# scored row with its inputs, what must hold for its prediction, and metrics that
# are computed once by the operators and once by plain aggregates of the written
# predictions.

_MODEL_LABEL = {"classification": "label", "regression": "o_totalprice"}


def _scored(spark: SparkSession, sf: str, framework: str, task: str) -> DataFrame:
    """Predictions of every order, split included, written and read back."""
    f = train_test_split(order_frame(spark, sf), ["o_orderkey"], 0.2, 42)
    feats = ORDER_FEATURES if task == "classification" else ORDER_FEATURES[:3]
    params = {"maxIter": 20} if framework == "gbt" else {"numTrees": 20}
    model = fit_model(f.filter(F.col("split") == "train"), feats, _MODEL_LABEL[task], framework, task,
                      maxDepth=5, **params)
    path = scratch_path(spark, f"scored_{uuid.uuid4().hex[:8]}")
    write_parquet(predict(model, f, feats, ["o_orderkey", "split", _MODEL_LABEL[task]]), path)
    return spark.read.parquet(path)


def _classify(spark: SparkSession, sf: str, framework: str) -> DataFrame:
    s = _scored(spark, sf, framework, "classification")
    rows = s.select("o_orderkey", "split", "label", (F.abs(F.col("class_0") + F.col("class_1") - 1) < 1e-9).alias("sums_to_one"),
                    (F.col("prediction") == F.when(F.col("class_1") > F.col("class_0"), 1.0).otherwise(0.0)).alias("is_argmax"))
    checks = []
    for split in ("train", "test"):
        part = s.filter(F.col("split") == split)
        m = classification_metrics(part.select(F.col("label").cast("double").alias("label"), "prediction")).first()
        again = part.agg(F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6),
                         F.count(F.lit(1))).first()
        checks.append(abs(m["accuracy"] - again[0]) < 1e-5 and m["n"] == again[1])
    return rows.withColumn("metrics_agree", F.lit(all(checks)))


CLASSIFY_SQL = f"""
SELECT o_orderkey, label, true AS sums_to_one, true AS is_argmax, true AS metrics_agree,
       CASE WHEN ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT % 1000 < 200
            THEN 'test' ELSE 'train' END AS split
FROM ({ORDER_FRAME_SQL}) f
"""


def _regress(spark: SparkSession, sf: str, framework: str) -> DataFrame:
    """A tree model predicts means of training labels: within their range.  (Boosted
    trees add up corrections: within the range widened by itself.)"""
    s = _scored(spark, sf, framework, "regression")
    lim = s.filter("split = 'train'").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).first()
    wide = 0.0 if framework == "random_forest" else lim["hi"] - lim["lo"]
    m = regression_metrics(s, "o_totalprice", "prediction").first()
    e = F.col("o_totalprice") - F.col("prediction")
    again = s.agg(F.avg(e * e), F.count(F.lit(1)), F.var_pop("o_totalprice")).first()
    agree = abs(m["mse"] / again[0] - 1) < 1e-6 and m["n"] == again[1] and \
        abs(m["r2"] - (1 - again[0] / again[2])) < 1e-6
    return s.select("o_orderkey", "split", "o_totalprice",
                    F.col("prediction").between(lim["lo"] - wide - 1e-6, lim["hi"] + wide + 1e-6).alias("in_range"),
                    F.lit(agree).alias("metrics_agree"), F.lit(m["mse"] < again[2]).alias("beats_mean"))


REGRESS_SQL = f"""
SELECT o_orderkey, o_totalprice, true AS in_range, true AS metrics_agree, true AS beats_mean,
       CASE WHEN ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT % 1000 < 200
            THEN 'test' ELSE 'train' END AS split
FROM ({ORDER_FRAME_SQL}) f
"""


def rf_classify(spark, sf):
    return _classify(spark, sf, "random_forest")


def rf_regress(spark, sf):
    return _regress(spark, sf, "random_forest")


def gbt_classify(spark, sf):
    return _classify(spark, sf, "gbt")


def gbt_regress(spark, sf):
    return _regress(spark, sf, "gbt")


def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """One row per feature: importances are non-negative and add up to 1."""
    f = order_frame(spark, sf)
    model = fit_model(f, ORDER_FEATURES, "label", "random_forest", "classification", numTrees=20, maxDepth=5)
    imp = feature_importances(model, ORDER_FEATURES)
    total = sum(v for _, v in imp)
    return spark.createDataFrame([(k, v >= 0.0, abs(total - 1.0) < 1e-9) for k, v in imp],
                                 "feature string, non_negative boolean, sums_to_one boolean")


FEATURE_IMPORTANCE_SQL = "SELECT unnest([" + ", ".join(f"'{c}'" for c in ORDER_FEATURES) + \
    "]) AS feature, true AS non_negative, true AS sums_to_one"


def batch_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Train on the train split, save the model, score every order from the saved
    model, write the prediction table and return it with its inputs."""
    f = train_test_split(order_frame(spark, sf), ["o_orderkey"], 0.2, 42)
    model = fit_model(f.filter(F.col("split") == "train"), ORDER_FEATURES, "label",
                      "random_forest", "classification", numTrees=20, maxDepth=5)
    saved = save_model(model, scratch_path(spark, "model"))
    path = scratch_path(spark, f"predictions_{uuid.uuid4().hex[:8]}")
    scored = score_saved_model(spark, saved, f.select("o_orderkey", *ORDER_FEATURES), ["o_orderkey"],
                               prediction_col="completed")
    write_parquet(scored, path)
    p = spark.read.parquet(path)
    return p.select("o_orderkey", *ORDER_FEATURES, F.col("completed").isin(0.0, 1.0).alias("is_class"),
                    (F.abs(F.col("class_0") + F.col("class_1") - 1) < 1e-9).alias("sums_to_one"))


BATCH_PREDICT_SQL = f"""
SELECT o_orderkey, n_lines, total_qty, avg_discount, total_ext, true AS is_class, true AS sums_to_one
FROM ({ORDER_FRAME_SQL}) f
"""


QUERIES = {
    "train_entity_df": train_entity_df,
    "train_test_split": train_test_split_q,
    "stratified_split": stratified_split_q,
    "stratified_split_wide": stratified_split_wide,
    "metrics_regression_unit": metrics_regression_unit,
    "auc_scores": auc_scores,
    "knn_queries": knn_queries,
    "metrics_classification": metrics_classification,
    "metrics_regression": metrics_regression,
    "metrics_auc": metrics_auc,
    "standard_scale": standard_scale_q,
    "outlier_score": outlier_score,
    "isolation_forest": isolation_forest,
    "knn_exact": knn_exact_q,
    "model_per_group": model_per_group,
    "rf_classify": rf_classify,
    "rf_regress": rf_regress,
    "gbt_classify": gbt_classify,
    "gbt_regress": gbt_regress,
    "feature_importance": feature_importance,
    "batch_predict": batch_predict,
}

ORACLES = {
    "train_entity_df": TRAIN_ENTITY_SQL,
    "train_test_split": SPLIT_SQL,
    "stratified_split": STRATIFIED_SQL,
    "stratified_split_wide": STRATIFIED_WIDE_SQL,
    "metrics_regression_unit": METRICS_REGRESSION_UNIT_SQL,
    "auc_scores": AUC_SCORES_SQL,
    "knn_queries": KNN_QUERIES_SQL,
    "rf_classify": CLASSIFY_SQL,
    "gbt_classify": CLASSIFY_SQL,
    "rf_regress": REGRESS_SQL,
    "gbt_regress": REGRESS_SQL,
    "feature_importance": FEATURE_IMPORTANCE_SQL,
    "batch_predict": BATCH_PREDICT_SQL,
    "metrics_classification": METRICS_CLASSIFICATION_SQL,
    "metrics_regression": METRICS_REGRESSION_SQL,
    "metrics_auc": METRICS_AUC_SQL,
    "standard_scale": STANDARD_SCALE_SQL,
    "outlier_score": OUTLIER_SQL,
    "knn_exact": KNN_SQL,
    "model_per_group": MODEL_PER_GROUP_SQL,
}
