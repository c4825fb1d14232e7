"""Feature-store queries: views, point-in-time joins, latest values.

Entity frame: purchase events (event_id, user_id, event_timestamp).
Views over events keyed by user_id:
  * user_last_event: the latest view/click event (type, value)
  * user_daily:      per user-day aggregates, available at the end of the day
  * user_hourly_evt: events stamped with their hour (created = exact time),
                     many rows share one event time -> created breaks ties
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions import lit_ts, trunc_ntz
from tierline.operators.features import (
    FeatureView, define_feature_view, describe_views, features_for_entities,
    get_historical_features, latest_features, point_in_time_join, resolve_refs,
)
from tierline.operators.models import score_saved_model
from tierline.operators.sinks import materialize_newest, write_parquet
from tierline.operators.training import train_from_views
from tierline.operators.windows import exact_sum
from tierline.plans.common import EVENTS_ASOF, t
from tierline.session import scratch_path


def entity_frame(spark: SparkSession, sf: str) -> DataFrame:
    return (t(spark, sf, "events").filter(F.col("event_type") == "purchase")
            .select("event_id", "user_id", F.col("ts").alias("event_timestamp")))


ENTITY_SQL = ("SELECT event_id, user_id, ts AS event_timestamp FROM events "
              "WHERE event_type = 'purchase'")


def user_last_event(spark: SparkSession, sf: str, ttl: int | None) -> FeatureView:
    src = (t(spark, sf, "events").filter(F.col("event_type").isin("view", "click"))
           .select("user_id", F.col("ts").alias("event_timestamp"),
                   F.col("event_type").alias("last_event_type"),
                   F.col("value").alias("last_event_value")))
    return define_feature_view("user_last_event", src, ["user_id"],
                               [("last_event_type", "string"), ("last_event_value", "float64")],
                               ttl_seconds=ttl)


def user_daily(spark: SparkSession, sf: str, ttl: int | None = 2 * 86400) -> FeatureView:
    e = t(spark, sf, "events")
    src = (e.groupBy("user_id", trunc_ntz("ts", "day").alias("day"))
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum(exact_sum("value")).cast("double").alias("total_value"),
                 F.count_if(F.col("event_type") == "purchase").alias("n_purchases"))
            .withColumn("event_timestamp", F.col("day") + F.expr("INTERVAL 1 DAY"))
            .drop("day"))
    return define_feature_view("user_daily", src, ["user_id"],
                               [("n_events", "int64"), ("total_value", "float64"),
                                ("n_purchases", "int32")], ttl_seconds=ttl)


USER_DAILY_SQL = """
SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS event_timestamp,
       COUNT(*) AS n_events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
       CAST(COUNT(*) FILTER (WHERE event_type = 'purchase') AS INTEGER) AS n_purchases
FROM events GROUP BY user_id, date_trunc('day', ts)
"""


def user_hourly_evt(spark: SparkSession, sf: str) -> FeatureView:
    src = (t(spark, sf, "events").filter(F.col("event_type") != "purchase")
           .select("user_id", trunc_ntz("ts", "hour").alias("event_timestamp"),
                   F.col("ts").alias("created"),
                   F.col("event_type").alias("hour_event_type"),
                   F.col("value").alias("hour_event_value")))
    return define_feature_view("user_hourly_evt", src, ["user_id"],
                               [("hour_event_type", "string"), ("hour_event_value", "float64")],
                               created_timestamp_column="created", ttl_seconds=86400)


def _pit_sql(feature_sql: str, feature_cols: list[str], ttl_interval: str | None,
             order_extra: str = "") -> str:
    """Oracle for one view: join on key and time, rank, keep the newest."""
    fsel = ", ".join(f"f.{c}" for c in feature_cols)
    ttl = f" AND f.ft >= e.event_timestamp - {ttl_interval}" if ttl_interval else ""
    order = "f.ft DESC" + (f", {order_extra}" if order_extra else "") + \
        "".join(f", f.{c} DESC" for c in feature_cols)
    msel = ", ".join(f"m.{c}" for c in feature_cols)
    return f"""
WITH e AS ({ENTITY_SQL}), f AS ({feature_sql}),
m AS (SELECT e.event_id, {fsel}, row_number() OVER (PARTITION BY e.event_id ORDER BY {order}) AS rn
      FROM e JOIN f ON e.user_id = f.user_id AND f.ft <= e.event_timestamp{ttl})
SELECT e.event_id, e.user_id, e.event_timestamp, {msel}
FROM e LEFT JOIN m ON e.event_id = m.event_id AND m.rn = 1
"""


LAST_EVENT_SQL = ("SELECT user_id, ts AS ft, event_type AS last_event_type, value AS last_event_value "
                  "FROM events WHERE event_type IN ('view', 'click')")


def pit_join(spark: SparkSession, sf: str) -> DataFrame:
    return point_in_time_join(entity_frame(spark, sf), user_last_event(spark, sf, None),
                              "event_timestamp")


PIT_JOIN_SQL = _pit_sql(LAST_EVENT_SQL, ["last_event_type", "last_event_value"], None)


def pit_join_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return point_in_time_join(entity_frame(spark, sf), user_last_event(spark, sf, 3600),
                              "event_timestamp")


PIT_JOIN_TTL_SQL = _pit_sql(LAST_EVENT_SQL, ["last_event_type", "last_event_value"],
                            "INTERVAL 1 HOUR")


def pit_created_tiebreak(spark: SparkSession, sf: str) -> DataFrame:
    return point_in_time_join(entity_frame(spark, sf), user_hourly_evt(spark, sf),
                              "event_timestamp")


PIT_CREATED_SQL = _pit_sql(
    "SELECT user_id, date_trunc('hour', ts) AS ft, ts AS created, event_type AS hour_event_type, "
    "value AS hour_event_value FROM events WHERE event_type <> 'purchase'",
    ["hour_event_type", "hour_event_value"], "INTERVAL 1 DAY", "f.created DESC")


def feature_service(spark: SparkSession, sf: str) -> DataFrame:
    """Two views on one entity frame with view-prefixed names."""
    views = {"user_last_event": user_last_event(spark, sf, 3600), "user_daily": user_daily(spark, sf)}
    refs = resolve_refs(views, ["user_last_event:last_event_type", "user_daily:n_events",
                                "user_daily:total_value"])
    return get_historical_features(entity_frame(spark, sf), refs, "event_timestamp",
                                   full_feature_names=True)


FEATURE_SERVICE_SQL = f"""
WITH e AS ({ENTITY_SQL}),
a AS ({_pit_sql(LAST_EVENT_SQL, ["last_event_type"], "INTERVAL 1 HOUR")}),
d AS ({_pit_sql("SELECT user_id, event_timestamp AS ft, n_events, total_value FROM (" + USER_DAILY_SQL + ") x",
                ["n_events", "total_value"], "INTERVAL 2 DAY")})
SELECT e.event_id, e.user_id, e.event_timestamp,
       a.last_event_type AS user_last_event__last_event_type,
       d.n_events AS user_daily__n_events, d.total_value AS user_daily__total_value
FROM e JOIN a ON e.event_id = a.event_id JOIN d ON e.event_id = d.event_id
"""


def _trained(spark: SparkSession, sf: str) -> dict:
    """Purchases with a label (a large one) and the buyer's daily features as of then."""
    purchases = t(spark, sf, "events").filter(F.col("event_type") == "purchase") \
        .select("event_id", "user_id", F.col("ts").alias("event_timestamp"),
                F.when(F.col("value") >= REQUEST_MIN_VALUE, 1).otherwise(0).alias("label"))
    return train_from_views(purchases, [(user_daily(spark, sf), None)], "event_timestamp", "label", ["event_id"],
                            scratch_path(spark, "view_model"), numTrees=10, maxDepth=4)


def train_from_views_q(spark: SparkSession, sf: str) -> DataFrame:
    """The scored training frame; its metrics agree with plain aggregates of it."""
    run = _trained(spark, sf)
    scored = run["scored"]
    again = scored.groupBy("split").agg(F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("acc"),
                                        F.count(F.lit(1)).alias("k"))
    agree = run["metrics"].join(again, "split").filter("abs(accuracy - acc) < 1e-5 AND n = k").count() == 2
    return scored.select("event_id", "user_id", "event_timestamp", "label", *run["features"], "split",
                         F.col("prediction").isin(0.0, 1.0).alias("is_class")).withColumn("metrics_agree", F.lit(agree))


TRAIN_FROM_VIEWS_SQL = f"""
WITH e AS ({ENTITY_SQL}),
d AS ({_pit_sql("SELECT user_id, event_timestamp AS ft, n_events, total_value, n_purchases FROM (" + USER_DAILY_SQL + ") x",
                ["n_events", "total_value", "n_purchases"], "INTERVAL 2 DAY")})
SELECT e.event_id, e.user_id, e.event_timestamp, CAST(v.value >= 45.0 AS INTEGER) AS label,
       COALESCE(d.n_events, 0) AS n_events, COALESCE(d.total_value, 0.0) AS total_value,
       CAST(COALESCE(d.n_purchases, 0) AS INTEGER) AS n_purchases,
       CASE WHEN ('0x' || substr(md5(CAST(e.event_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 1000 < 200
            THEN 'test' ELSE 'train' END AS split, true AS is_class, true AS metrics_agree
FROM e JOIN d ON e.event_id = d.event_id JOIN events v ON v.event_id = e.event_id
"""


def score_saved_model_q(spark: SparkSession, sf: str) -> DataFrame:
    """The saved model on the latest features of every user: all columns but the
    entity's are features; the prediction column is named by the caller."""
    run = _trained(spark, sf)
    latest = latest_features(user_daily(spark, sf, ttl=None), EVENTS_ASOF)
    out = score_saved_model(spark, run["model"], latest, ["user_id", "event_timestamp"], prediction_col="big_spender")
    path = scratch_path(spark, "scored_users")
    write_parquet(out, path)
    back = spark.read.parquet(path)
    return back.select("user_id", "event_timestamp", "n_events", "total_value", "n_purchases",
                       F.col("big_spender").isin(0.0, 1.0).alias("is_class"),
                       (F.abs(F.col("class_0") + F.col("class_1") - 1) < 1e-9).alias("sums_to_one"))


def latest_features_q(spark: SparkSession, sf: str) -> DataFrame:
    return latest_features(user_daily(spark, sf), EVENTS_ASOF)


LATEST_SQL = f"""
WITH d AS ({USER_DAILY_SQL}),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS rn
      FROM d WHERE event_timestamp <= TIMESTAMP '{EVENTS_ASOF}')
SELECT user_id, event_timestamp,
       CASE WHEN event_timestamp >= TIMESTAMP '{EVENTS_ASOF}' - INTERVAL 2 DAY THEN n_events END AS n_events,
       CASE WHEN event_timestamp >= TIMESTAMP '{EVENTS_ASOF}' - INTERVAL 2 DAY THEN total_value END AS total_value,
       CASE WHEN event_timestamp >= TIMESTAMP '{EVENTS_ASOF}' - INTERVAL 2 DAY THEN n_purchases END AS n_purchases
FROM b WHERE rn = 1
"""

REQUEST_MIN_VALUE = 45.0


def features_for_entities_q(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows of requested users only (request derived from data:
    users with a purchase of at least 45)."""
    req = (t(spark, sf, "events")
           .filter((F.col("event_type") == "purchase") & (F.col("value") >= REQUEST_MIN_VALUE))
           .select("user_id"))
    return features_for_entities(user_daily(spark, sf).frame(), req, ["user_id"])


FEATURES_FOR_ENTITIES_SQL = f"""
SELECT * FROM ({USER_DAILY_SQL}) d
WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value >= 45.0)
"""


def materialize_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Online table kept incrementally: latest rows of (-inf, mid] first,
    then rows of (mid, end] merged in by key."""
    view = user_daily(spark, sf, ttl=None)
    mid, end = "2024-01-15 00:00:00", EVENTS_ASOF
    table = f"online.{'user_daily_' + uuid.uuid4().hex[:10]}"
    first = latest_features(view, mid)
    materialize_newest(spark, first, table, ["user_id"], "event_timestamp", scratch_path(spark, "online"))
    fv = view.frame()
    window = fv.filter((F.col("event_timestamp") > lit_ts(mid)) & (F.col("event_timestamp") <= lit_ts(end)))
    recent = latest_features(FeatureView(view.name, window, view.entities, view.features,
                                         view.timestamp_field, None, None), end)
    return materialize_newest(spark, recent, table, ["user_id"], "event_timestamp")


def materialize_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """The newer range first, an older one afterwards: newer rows stay."""
    view = user_daily(spark, sf, ttl=None)
    table = f"online.{'user_backfill_' + uuid.uuid4().hex[:10]}"
    materialize_newest(spark, latest_features(view, EVENTS_ASOF), table, ["user_id"], "event_timestamp",
                       scratch_path(spark, "online"))
    older = latest_features(view, "2024-01-15 00:00:00")
    return materialize_newest(spark, older, table, ["user_id"], "event_timestamp")


MATERIALIZE_LATEST_SQL = f"""
SELECT user_id, event_timestamp, n_events, total_value, n_purchases FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS rn
  FROM ({USER_DAILY_SQL}) d WHERE event_timestamp <= TIMESTAMP '{EVENTS_ASOF}') WHERE rn = 1
"""

SCORE_SAVED_MODEL_SQL = f"""
SELECT user_id, event_timestamp, n_events, total_value, CAST(n_purchases AS INTEGER) AS n_purchases,
       true AS is_class, true AS sums_to_one
FROM ({MATERIALIZE_LATEST_SQL}) m
"""


def _embedding_view(spark: SparkSession, sf: str) -> FeatureView:
    src = t(spark, sf, "embeddings").withColumn("snapshot_time", lit_ts(EVENTS_ASOF))
    return define_feature_view("item_embedding", src, ["vec_id"],
                               [("embedding", "array_float64"), ("label", "int64")],
                               timestamp_field="snapshot_time", ttl_seconds=None)


def feature_types(spark: SparkSession, sf: str) -> DataFrame:
    """Declared dtypes applied on read (float array -> double array, int -> bigint)."""
    return _embedding_view(spark, sf).frame()


FEATURE_TYPES_SQL = f"""
SELECT vec_id, TIMESTAMP '{EVENTS_ASOF}' AS snapshot_time, CAST(embedding AS DOUBLE[]) AS embedding,
       CAST(label AS BIGINT) AS label FROM embeddings
"""


def feature_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Registered views as rows with their current row counts."""
    views = [user_last_event(spark, sf, 3600), user_daily(spark, sf), user_hourly_evt(spark, sf),
             _embedding_view(spark, sf)]
    meta = spark.createDataFrame(
        describe_views(views),
        "name string, entities array<string>, features array<string>, dtypes array<string>, "
        "ttl_seconds bigint, timestamp_field string")
    counts = None
    for v in views:
        c = v.frame().agg(F.count(F.lit(1)).alias("row_count")).withColumn("name", F.lit(v.name))
        counts = c if counts is None else counts.unionByName(c)
    return meta.join(counts, "name")


FEATURE_CATALOG_SQL = f"""
SELECT 'user_last_event' AS name, ['user_id'] AS entities, ['last_event_type', 'last_event_value'] AS features,
       ['string', 'float64'] AS dtypes, CAST(3600 AS BIGINT) AS ttl_seconds, 'event_timestamp' AS timestamp_field,
       (SELECT COUNT(*) FROM events WHERE event_type IN ('view', 'click')) AS row_count
UNION ALL
SELECT 'user_daily', ['user_id'], ['n_events', 'total_value', 'n_purchases'], ['int64', 'float64', 'int32'],
       172800, 'event_timestamp', (SELECT COUNT(*) FROM ({USER_DAILY_SQL}) d)
UNION ALL
SELECT 'user_hourly_evt', ['user_id'], ['hour_event_type', 'hour_event_value'], ['string', 'float64'],
       86400, 'event_timestamp', (SELECT COUNT(*) FROM events WHERE event_type <> 'purchase')
UNION ALL
SELECT 'item_embedding', ['vec_id'], ['embedding', 'label'], ['array_float64', 'int64'], NULL,
       'snapshot_time', (SELECT COUNT(*) FROM embeddings)
"""


QUERIES = {
    "pit_join": pit_join,
    "pit_join_ttl": pit_join_ttl,
    "pit_created_tiebreak": pit_created_tiebreak,
    "feature_service": feature_service,
    "train_from_views": train_from_views_q,
    "score_saved_model": score_saved_model_q,
    "latest_features": latest_features_q,
    "features_for_entities": features_for_entities_q,
    "materialize_latest": materialize_latest,
    "materialize_backfill": materialize_backfill,
    "feature_types": feature_types,
    "feature_catalog": feature_catalog,
}

ORACLES = {
    "pit_join": PIT_JOIN_SQL,
    "pit_join_ttl": PIT_JOIN_TTL_SQL,
    "pit_created_tiebreak": PIT_CREATED_SQL,
    "feature_service": FEATURE_SERVICE_SQL,
    "train_from_views": TRAIN_FROM_VIEWS_SQL,
    "score_saved_model": SCORE_SAVED_MODEL_SQL,
    "latest_features": LATEST_SQL,
    "features_for_entities": FEATURES_FOR_ENTITIES_SQL,
    "materialize_latest": MATERIALIZE_LATEST_SQL,
    "materialize_backfill": MATERIALIZE_LATEST_SQL,
    "feature_types": FEATURE_TYPES_SQL,
    "feature_catalog": FEATURE_CATALOG_SQL,
}
