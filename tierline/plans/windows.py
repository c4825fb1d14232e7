"""Rolling-window and per-key statistics features over the events stream.

events stand in for transactions: user_id = account, value = amount,
props {"k": n} = merchant / product id, event types view / click /
purchase / signup / error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierline.functions import json_int, lit_ts, round_double, safe_ratio
from tierline.operators.windows import duration_us, exact_sum, rolling_distinct_count, rolling_frames
from tierline.plans.common import EVENTS_ASOF, t

H24 = duration_us(24, "hour")
D7 = duration_us(7, "day")
D30 = duration_us(30, "day")
M5 = duration_us(5, "minute")


def events_k(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").withColumn("k", json_int("props", "k"))


def rolling_24h(spark: SparkSession, sf: str) -> DataFrame:
    """24 h count / sum / avg / max per user at every event (linear-time
    frames, hourly pieces)."""
    e = (t(spark, sf, "events").select("event_id", "user_id", "ts", "value")
         .withColumn("_v", exact_sum("value")))
    out = rolling_frames(e, ["user_id"], "ts", [("count", None, "count_24h", H24),
                                                ("sum", "_v", "_s", H24),
                                                ("max", "value", "max_24h", H24)])
    return out.select("event_id", "user_id", "ts", "value", "count_24h",
                      F.col("_s").cast("double").alias("sum_24h"),
                      round_double(safe_ratio(F.col("_s"), F.col("count_24h"))).alias("avg_24h"),
                      "max_24h")


ROLLING_24H_SQL = """
SELECT event_id, user_id, ts, value,
       COUNT(*) OVER w AS count_24h,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS sum_24h,
       ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / CAST(COUNT(*) OVER w AS DOUBLE), 6) AS avg_24h,
       MAX(value) OVER w AS max_24h
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)
"""


def rolling_multi(spark: SparkSession, sf: str) -> DataFrame:
    """5 min / 24 h / 30 d frames behind one shuffle (linear-time frames)."""
    e = (t(spark, sf, "events").select("event_id", "user_id", "ts", "value")
         .withColumn("_v", exact_sum("value")))
    frames = (("5m", M5), ("24h", H24), ("30d", D30))
    aggs = []
    for name, length in frames:
        aggs += [("count", None, f"count_{name}", length), ("sum", "_v", f"_s_{name}", length),
                 ("max", "value", f"max_{name}", length)]
    out = rolling_frames(e, ["user_id"], "ts", aggs)
    cols = []
    for name, _ in frames:
        cols += [f"count_{name}", F.col(f"_s_{name}").cast("double").alias(f"sum_{name}"), f"max_{name}"]
    return out.select("event_id", "user_id", "ts", "value", *cols)


def _multi_sql():
    parts = []
    for name, interval in (("5m", "INTERVAL 5 MINUTES"), ("24h", "INTERVAL 24 HOURS"),
                           ("30d", "INTERVAL 30 DAYS")):
        w = f"(PARTITION BY user_id ORDER BY ts RANGE BETWEEN {interval} PRECEDING AND CURRENT ROW)"
        parts.append(f"COUNT(*) OVER {w} AS count_{name}, "
                     f"CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER {w} AS DOUBLE) AS sum_{name}, "
                     f"MAX(value) OVER {w} AS max_{name}")
    return f"SELECT event_id, user_id, ts, value, {', '.join(parts)} FROM events"


ROLLING_MULTI_SQL = _multi_sql()


def rolling_30d(spark: SparkSession, sf: str) -> DataFrame:
    """30-day count / sum / avg / min / max per user with daily buckets."""
    e = (t(spark, sf, "events").select("event_id", "user_id", "ts", "value")
         .withColumn("_v", exact_sum("value")))
    out = rolling_frames(e, ["user_id"], "ts", [
        ("count", "event_id", "count_30d", D30), ("sum", "_v", "_s", D30),
        ("min", "value", "min_30d", D30), ("max", "value", "max_30d", D30)], {D30: 30})
    return out.select("event_id", "user_id", "ts", "value", "count_30d",
                      F.col("_s").cast("double").alias("sum_30d"),
                      round_double(safe_ratio(F.col("_s"), F.col("count_30d"))).alias("avg_30d"),
                      "min_30d", "max_30d")


ROLLING_30D_SQL = """
SELECT event_id, user_id, ts, value, COUNT(event_id) OVER w AS count_30d,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS sum_30d,
       ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / CAST(COUNT(event_id) OVER w AS DOUBLE), 6) AS avg_30d,
       MIN(value) OVER w AS min_30d, MAX(value) OVER w AS max_30d
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)
"""


def rolling_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct merchants in 24 h."""
    e = events_k(spark, sf).select("event_id", "user_id", "ts", "k")
    return rolling_distinct_count(e, ["user_id"], "ts", "k", H24, "unique_merchants_24h")


ROLLING_DISTINCT_SQL = """
SELECT event_id, user_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(len(list_distinct(list(CAST(json_extract(props, '$.k') AS BIGINT)) OVER (
           PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)))
         AS INTEGER) AS unique_merchants_24h
FROM events
"""

# Event types counted per window.
EVENT_TYPES_7D = ("view", "click", "purchase")
EVENT_TYPES_30D = ("error", "signup")


def event_counts_7d(spark: SparkSession, sf: str) -> DataFrame:
    """Typed event counts over 7 / 30 days (counts of a 1-if-type column)."""
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    aggs = []
    for ets, length, suffix in ((EVENT_TYPES_7D, D7, "7d"), (EVENT_TYPES_30D, D30, "30d")):
        for et in ets:
            e = e.withColumn(f"_is_{et}", F.when(F.col("event_type") == et, 1))
            aggs.append(("count", f"_is_{et}", f"{et}_count_{suffix}", length))
    out = rolling_frames(e, ["user_id"], "ts", aggs)
    return out.select("event_id", "user_id", "ts", "event_type", *[a[2] for a in aggs])


def _counts_sql():
    w7 = "(PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)"
    w30 = "(PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"
    cols = [f"CAST(SUM(CASE WHEN event_type = '{et}' THEN 1 ELSE 0 END) OVER {w7} AS BIGINT) AS {et}_count_7d"
            for et in EVENT_TYPES_7D]
    cols += [f"CAST(SUM(CASE WHEN event_type = '{et}' THEN 1 ELSE 0 END) OVER {w30} AS BIGINT) AS {et}_count_30d"
             for et in EVENT_TYPES_30D]
    return f"SELECT event_id, user_id, ts, event_type, {', '.join(cols)} FROM events"


EVENT_COUNTS_7D_SQL = _counts_sql()


def velocity(spark: SparkSession, sf: str) -> DataFrame:
    """Events per user-day vs the previous calendar day.

    Aggregate to (user, day) first; the window then runs over one row per
    user-day (days per key, not events per key)."""
    e = t(spark, sf, "events")
    daily = (e.groupBy("user_id", F.col("ts").cast("date").alias("day"))
              .agg(F.count(F.lit(1)).alias("n_events"))
              .withColumn("_d", F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))))
    w = Window.partitionBy("user_id").orderBy("_d").rangeBetween(-1, -1)
    prev = F.coalesce(F.sum("n_events").over(w), F.lit(0)).cast("bigint")
    return daily.select("user_id", "day", "n_events", prev.alias("prev_day_events"),
                        (F.col("n_events") - prev).alias("velocity_change")).drop("_d")


VELOCITY_SQL = """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n_events FROM events GROUP BY 1, 2),
p AS (SELECT *, CAST(COALESCE(SUM(n_events) OVER (PARTITION BY user_id ORDER BY date_diff('day', DATE '1970-01-01', day)
                     RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prev_day_events FROM d)
SELECT user_id, day, n_events, prev_day_events, n_events - prev_day_events AS velocity_change FROM p
"""


def zscore_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Deviation from each user's normal: (value - mean) / stddev_pop.

    Per-key statistics come from a grouped (partially aggregated) pass and
    are joined back on the key; AQE splits a skewed join partition, whereas a
    whole-partition window would put a hot key in one task."""
    e = t(spark, sf, "events").select("event_id", "user_id", "value")
    stats = e.groupBy("user_id").agg(
        F.sum(exact_sum("value")).alias("_s"), F.count("value").alias("_n"),
        F.stddev_pop("value").alias("_sd"))
    z = safe_ratio(F.col("value") - safe_ratio(F.col("_s"), F.col("_n")), F.col("_sd"))
    return (e.join(stats, "user_id", "left")
             .select("event_id", "user_id", "value", round_double(z, 6).alias("zscore")))


ZSCORE_SQL = """
SELECT event_id, user_id, value,
       ROUND((value - CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER u AS DOUBLE) / CAST(COUNT(value) OVER u AS DOUBLE))
             / NULLIF(STDDEV_POP(value) OVER u, 0), 6) AS zscore
FROM events WINDOW u AS (PARTITION BY user_id)
"""


def interaction_features(spark: SparkSession, sf: str, days: int = 7) -> DataFrame:
    """Product interaction counts over the last ``days`` and conversion rate."""
    e = events_k(spark, sf)
    asof = lit_ts(EVENTS_ASOF)
    recent = e.filter((F.col("ts") <= asof) & (F.col("ts") > asof - F.expr(f"INTERVAL {days} DAYS")))

    def cnt(et):
        return F.count_if(F.col("event_type") == et)
    agg = recent.groupBy(F.col("k").alias("product_id")).agg(
        cnt("view").alias("view_count_7d"), cnt("click").alias("add_to_cart_count_7d"),
        cnt("purchase").alias("purchase_count_7d"),
        F.sum(F.when(F.col("event_type") == "purchase", exact_sum("value"))).alias("_rs"),
        F.count(F.when(F.col("event_type") == "purchase", F.col("value"))).cast("int").alias("review_count"))
    return agg.select("product_id", "view_count_7d", "add_to_cart_count_7d", "purchase_count_7d",
                      round_double(safe_ratio(F.col("purchase_count_7d"), F.col("view_count_7d")))
                      .alias("conversion_rate"),
                      round_double(safe_ratio(F.col("_rs"), F.col("review_count"))).alias("avg_rating"),
                      "review_count", asof.alias("event_time"))


INTERACTION_SQL = f"""
WITH r AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
           WHERE ts <= TIMESTAMP '{EVENTS_ASOF}' AND ts > TIMESTAMP '{EVENTS_ASOF}' - INTERVAL 7 DAYS),
a AS (SELECT k AS product_id,
             COUNT(*) FILTER (WHERE event_type = 'view') AS view_count_7d,
             COUNT(*) FILTER (WHERE event_type = 'click') AS add_to_cart_count_7d,
             COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase_count_7d,
             SUM(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'purchase') AS rs,
             CAST(COUNT(value) FILTER (WHERE event_type = 'purchase') AS INTEGER) AS review_count
      FROM r GROUP BY k)
SELECT product_id, view_count_7d, add_to_cart_count_7d, purchase_count_7d,
       ROUND(CAST(purchase_count_7d AS DOUBLE) / NULLIF(CAST(view_count_7d AS DOUBLE), 0), 6) AS conversion_rate,
       ROUND(CAST(rs AS DOUBLE) / NULLIF(CAST(review_count AS DOUBLE), 0), 6) AS avg_rating,
       review_count, TIMESTAMP '{EVENTS_ASOF}' AS event_time
FROM a
"""

# Merchant id ranges standing in for foreign / high-risk merchants.
FOREIGN_MERCHANT_MIN = 90
HIGH_RISK_MERCHANT_MAX = 9


def txn_pattern_features(spark: SparkSession, sf: str) -> DataFrame:
    """Transaction pattern features at every purchase (24 h / 30 d frames)."""
    e = events_k(spark, sf).filter(F.col("event_type") == "purchase") \
        .select("user_id", "ts", "value", "k")

    e = (e.withColumn("_v", exact_sum("value"))
          .withColumn("_foreign", F.when(F.col("k") >= FOREIGN_MERCHANT_MIN, 1))
          .withColumn("_risky", F.when(F.col("k") <= HIGH_RISK_MERCHANT_MAX, 1)))
    r = rolling_frames(e, ["user_id"], "ts", [
        ("count", None, "_n24", H24), ("sum", "_v", "_s24", H24), ("max", "value", "_mx24", H24),
        ("count", "_foreign", "_fo24", H24), ("count", "_risky", "_hr24", H24),
        ("sum", "_v", "_s30", D30), ("count", "value", "_n30", D30)])
    r = rolling_distinct_count(r, ["user_id"], "ts", "k", H24, "unique_merchants_24h")
    return r.select("user_id", F.col("ts").alias("pattern_timestamp"),
                    F.col("_n24").cast("int").alias("transaction_count_24h"),
                    F.col("_s24").cast("double").alias("total_amount_24h"),
                    round_double(safe_ratio(F.col("_s30"), F.col("_n30"))).alias("avg_transaction_amount"),
                    F.col("_mx24").alias("max_single_transaction"), "unique_merchants_24h",
                    F.col("_fo24").cast("int").alias("foreign_transaction_count"),
                    F.col("_hr24").cast("int").alias("high_risk_merchant_count"))


TXN_PATTERN_SQL = """
WITH p AS (SELECT user_id, ts, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k
           FROM events WHERE event_type = 'purchase')
SELECT user_id, ts AS pattern_timestamp,
       CAST(COUNT(*) OVER w AS INTEGER) AS transaction_count_24h,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total_amount_24h,
       ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w30 AS DOUBLE) / NULLIF(CAST(COUNT(value) OVER w30 AS DOUBLE), 0), 6) AS avg_transaction_amount,
       MAX(value) OVER w AS max_single_transaction,
       CAST(len(list_distinct(list(k) OVER w)) AS INTEGER) AS unique_merchants_24h,
       CAST(COUNT(*) FILTER (WHERE k >= 90) OVER w AS INTEGER) AS foreign_transaction_count,
       CAST(COUNT(*) FILTER (WHERE k <= 9) OVER w AS INTEGER) AS high_risk_merchant_count
FROM p
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)
"""

FRAUD_VALUE_MIN = 45.0


def account_risk_features(spark: SparkSession, sf: str) -> DataFrame:
    """Account security features assessed at every error (failed login)."""
    e = t(spark, sf, "events").select("user_id", "ts", "event_type", "value")
    first_seen = e.groupBy("user_id").agg(F.min("ts").alias("_first"))

    is_err = F.col("event_type") == "error"
    e = (e.withColumn("_err", F.when(is_err, 1))
          .withColumn("_pw", F.when(F.col("event_type") == "signup", 1))
          .withColumn("_flag", F.when(is_err & (F.col("value") >= FRAUD_VALUE_MIN), 1)))
    r = rolling_frames(e, ["user_id"], "ts", [("count", "_err", "_f7", D7), ("count", "_pw", "_p30", D30),
                                              ("count", "_flag", "_fl", D30)])
    r = (r.filter(is_err)
          .select("*", F.col("_f7").cast("int").alias("failed_login_attempts_7d"),
                  F.col("_p30").cast("int").alias("password_changes_30d"),
                  F.col("_fl").cast("int").alias("previous_fraud_flags")))
    r = r.join(first_seen, "user_id", "left")
    return r.select(
        "user_id", F.col("ts").alias("assessed_at"),
        F.datediff(F.col("ts").cast("date"), F.col("_first").cast("date")).cast("int")
         .alias("account_age_days"),
        "failed_login_attempts_7d", "password_changes_30d",
        (F.col("password_changes_30d") > 0).alias("verified_email"),
        F.least(F.lit(100.0), F.col("failed_login_attempts_7d") * 10.0
                + F.col("password_changes_30d") * 5.0 + F.col("previous_fraud_flags") * 20.0)
         .alias("risk_score"),
        "previous_fraud_flags")


ACCOUNT_RISK_SQL = """
WITH r AS (
  SELECT user_id, ts, event_type,
         COUNT(*) FILTER (WHERE event_type = 'error') OVER w7 AS f7,
         COUNT(*) FILTER (WHERE event_type = 'signup') OVER w30 AS p30,
         COUNT(*) FILTER (WHERE event_type = 'error' AND value >= 45.0) OVER w30 AS fl,
         MIN(ts) OVER (PARTITION BY user_id) AS first_ts
  FROM events
  WINDOW w7 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW))
SELECT user_id, ts AS assessed_at,
       CAST(date_diff('day', CAST(first_ts AS DATE), CAST(ts AS DATE)) AS INTEGER) AS account_age_days,
       CAST(f7 AS INTEGER) AS failed_login_attempts_7d, CAST(p30 AS INTEGER) AS password_changes_30d,
       p30 > 0 AS verified_email,
       CAST(LEAST(100.0, f7 * 10.0 + p30 * 5.0 + fl * 20.0) AS DOUBLE) AS risk_score,
       CAST(fl AS INTEGER) AS previous_fraud_flags
FROM r WHERE event_type = 'error'
"""


QUERIES = {
    "rolling_24h": rolling_24h,
    "rolling_multi": rolling_multi,
    "rolling_30d": rolling_30d,
    "rolling_distinct": rolling_distinct,
    "event_counts_7d": event_counts_7d,
    "velocity": velocity,
    "zscore_per_key": zscore_per_key,
    "interaction_features": interaction_features,
    "txn_pattern_features": txn_pattern_features,
    "account_risk_features": account_risk_features,
}

ORACLES = {
    "rolling_24h": ROLLING_24H_SQL,
    "rolling_multi": ROLLING_MULTI_SQL,
    "rolling_30d": ROLLING_30D_SQL,
    "rolling_distinct": ROLLING_DISTINCT_SQL,
    "event_counts_7d": EVENT_COUNTS_7D_SQL,
    "velocity": VELOCITY_SQL,
    "zscore_per_key": ZSCORE_SQL,
    "interaction_features": INTERACTION_SQL,
    "txn_pattern_features": TXN_PATTERN_SQL,
    "account_risk_features": ACCOUNT_RISK_SQL,
}
