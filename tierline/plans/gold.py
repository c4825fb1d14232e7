"""Gold layer queries: joins, aggregates, shares, profiles, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions import lit_date, lit_ts, round_double, safe_ratio, trunc_ntz
from tierline.operators.gold import customer_metrics, operator_profile, price_elasticity as group_elasticity, share_of_total
from tierline.plans.common import ORDERS_ASOF, t
from tierline.plans.silver import (
    CLEAN_CUSTOMERS_SQL, CLEAN_TRANSACTIONS_SQL, QUALITY_FLAG_SQL, clean_customers,
    clean_transactions, quality_flag, support_tickets,
)


def customer_metrics_q(spark: SparkSession, sf: str) -> DataFrame:
    return customer_metrics(clean_customers(spark, sf), clean_transactions(spark, sf),
                            support_tickets(spark, sf), ORDERS_ASOF)


#: Written from the rules: purchases and tickets are summed per customer first, then
#: each customer looks up its sums.
CUSTOMER_METRICS_SQL = f"""
WITH bought AS (
  SELECT customer_id AS who, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS spent,
         MIN(transaction_date) AS oldest, MAX(transaction_date) AS newest
  FROM ({CLEAN_TRANSACTIONS_SQL}) GROUP BY ALL),
asked AS (
  SELECT user_id AS who, COUNT(*) AS n, ROUND(SUM(COALESCE(value, 0)) / COUNT(*), 6) AS hours
  FROM events WHERE event_type = 'error' GROUP BY ALL),
seen AS (
  SELECT p.*, COALESCE(bought.n, 0) AS buys, bought.spent, asked.n AS tickets, asked.hours,
         DATE '{ORDERS_ASOF}' - bought.newest AS idle, DATE '{ORDERS_ASOF}' - bought.oldest AS active,
         DATE '{ORDERS_ASOF}' - CAST(p.registration_date AS DATE) AS age
  FROM ({CLEAN_CUSTOMERS_SQL}) p LEFT JOIN bought ON bought.who = p.customer_id
       LEFT JOIN asked ON asked.who = p.customer_id)
SELECT customer_id, email, country, status, buys AS total_purchases,
       IFNULL(spent, 0.0) AS customer_lifetime_value,
       IFNULL(ROUND(spent / buys, 6), 0.0) AS avg_purchase_value,
       CAST(idle AS INTEGER) AS days_since_last_purchase, CAST(age AS INTEGER) AS account_age_days,
       IF(buys = 0, 0.0, ROUND(buys::DOUBLE / NULLIF(active::DOUBLE / 30.0, 0), 6)) AS purchase_frequency,
       IFNULL(tickets, 0) AS support_tickets, IFNULL(hours, 0.0) AS avg_support_resolution_hours,
       CAST(IFNULL(idle > 60, false) AS INTEGER) AS churned,
       TIMESTAMP '{ORDERS_ASOF} 00:00:00' AS updated_at
FROM seen
"""


# --- AG-01 grouped aggregates -----------------------------------------------

def txn_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    money = F.col("o_totalprice").cast("decimal(12,2)")
    return (o.groupBy(F.col("o_orderstatus").alias("status"))
             .agg(F.count(F.lit(1)).alias("n_orders"),
                  F.count("o_custkey").alias("n_with_customer"),
                  F.sum(money).alias("_sum"),
                  F.min("o_totalprice").alias("min_amount"),
                  F.max("o_totalprice").alias("max_amount"))
             .select("status", "n_orders", "n_with_customer",
                     F.col("_sum").cast("double").alias("total_amount"),
                     round_double(safe_ratio(F.col("_sum"), F.col("n_with_customer"))).alias("avg_amount"),
                     "min_amount", "max_amount"))


TXN_SUMMARY_SQL = """
SELECT o_orderstatus AS status, COUNT(*) AS n_orders, COUNT(o_custkey) AS n_with_customer,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total_amount,
       ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / NULLIF(CAST(COUNT(o_custkey) AS DOUBLE), 0), 6) AS avg_amount,
       MIN(o_totalprice) AS min_amount, MAX(o_totalprice) AS max_amount
FROM orders GROUP BY o_orderstatus
"""


def data_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Global aggregate with an exact distinct count (two-level aggregate)."""
    e = t(spark, sf, "events")
    return e.agg(F.min("ts").alias("earliest_date"), F.max("ts").alias("latest_date"),
                 F.count(F.lit(1)).alias("total_rows"),
                 F.count_distinct("user_id").alias("unique_entities"))


DATA_COVERAGE_SQL = """
WITH per_user AS (SELECT user_id, MIN(ts) AS a, MAX(ts) AS z, COUNT(*) AS n FROM events GROUP BY ALL)
SELECT (SELECT MIN(a) FROM per_user) AS earliest_date, (SELECT MAX(z) FROM per_user) AS latest_date,
       (SELECT CAST(SUM(n) AS BIGINT) FROM per_user) AS total_rows, COUNT(user_id) AS unique_entities FROM per_user
"""


def monthly_summary(spark: SparkSession, sf: str, months: int = 6) -> DataFrame:
    """Orders per month for the ``months`` months before the as-of date."""
    o = t(spark, sf, "orders")
    start = F.add_months(F.trunc(lit_date(ORDERS_ASOF), "month"), -months)
    money = F.col("o_totalprice").cast("decimal(12,2)")
    return (o.filter(F.col("o_orderdate") >= start.cast("timestamp_ntz"))
             .groupBy(trunc_ntz("o_orderdate", "month").alias("month"))
             .agg(F.count(F.lit(1)).alias("n_orders"), F.sum(money).alias("_sum"),
                  F.count_distinct("o_custkey").alias("n_customers"))
             .select("month", "n_orders", F.col("_sum").cast("double").alias("revenue"),
                     round_double(safe_ratio(F.col("_sum"), F.col("n_orders"))).alias("avg_order_value"),
                     "n_customers"))


MONTHLY_SUMMARY_SQL = f"""
SELECT date_trunc('month', o_orderdate) AS month, COUNT(*) AS n_orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue,
       ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 6) AS avg_order_value,
       COUNT(DISTINCT o_custkey) AS n_customers
FROM orders
WHERE o_orderdate >= CAST(date_trunc('month', DATE '{ORDERS_ASOF}') - INTERVAL 6 MONTH AS TIMESTAMP)
GROUP BY 1
"""


def daily_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    return (e.groupBy(F.col("ts").cast("date").alias("day"), "event_type")
             .agg(F.count(F.lit(1)).alias("n_events"),
                  F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("total_value"),
                  F.count_distinct("user_id").alias("n_users")))


DAILY_SUMMARY_SQL = """
SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n_events,
       CAST(SUM(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS total_value,
       COUNT(DISTINCT user_id) AS n_users
FROM events GROUP BY 1, 2
"""


# --- scoring stand-in, risk bands, top-k ------------------------------------

def churn_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic churn score in [0, 1]: recency over one year."""
    cm = customer_metrics_q(spark, sf)
    return cm.select("customer_id",
                     F.least(F.lit(1.0), F.col("days_since_last_purchase") / 365.0)
                      .alias("churn_probability"))


CHURN_SCORES_SQL = f"""
SELECT customer_id, LEAST(1.0, days_since_last_purchase / 365.0) AS churn_probability
FROM ({CUSTOMER_METRICS_SQL}) cm
"""

# Probability bands (lower bound, label) and risk thresholds.
PROB_BANDS = [(0.8, "80-100%"), (0.6, "60-80%"), (0.4, "40-60%"), (0.2, "20-40%")]
PROB_BAND_ELSE = "0-20%"
RISK_HIGH, RISK_MEDIUM = 0.7, 0.4


def probability_band(col):
    expr = None
    for lo, label in PROB_BANDS:
        expr = F.when(col >= lo, label) if expr is None else expr.when(col >= lo, label)
    return expr.otherwise(PROB_BAND_ELSE)


def risk_distribution(spark: SparkSession, sf: str) -> DataFrame:
    s = churn_scores(spark, sf)
    return share_of_total(s, [probability_band(F.col("churn_probability")).alias("probability_range")])


#: The bands as a table, looked up by their lower bounds.
_BANDS_SQL = "(VALUES " + ", ".join(f"({lo}, '{name}')" for lo, name in [*PROB_BANDS, (-1.0, PROB_BAND_ELSE)]) + \
    ") AS band(floor, name)"

RISK_DISTRIBUTION_SQL = f"""
WITH banded AS (SELECT (SELECT max_by(name, floor) FROM {_BANDS_SQL} WHERE floor <= churn_probability) AS found
                FROM ({CHURN_SCORES_SQL})),
sized AS (SELECT IFNULL(found, '{PROB_BAND_ELSE}') AS probability_range, COUNT(*) AS count FROM banded GROUP BY ALL)
SELECT probability_range, count, ROUND(100.0 * count / (SELECT SUM(count) FROM sized), 6) AS percentage FROM sized
"""


def top_risk(spark: SparkSession, sf: str, k: int = 100) -> DataFrame:
    """ORDER BY score DESC LIMIT k -> TakeOrderedAndProject: each task keeps
    its local top k, only k rows per task reach the final merge."""
    s = churn_scores(spark, sf)
    p = F.col("churn_probability")
    cat = F.when(p > RISK_HIGH, "High Risk").when(p > RISK_MEDIUM, "Medium Risk").otherwise("Low Risk")
    return (s.select("customer_id", "churn_probability", cat.alias("risk_category"))
             .orderBy(F.col("churn_probability").desc_nulls_last(), F.col("customer_id").asc())
             .limit(k))


TOP_RISK_SQL = f"""
WITH ranked AS (SELECT customer_id, churn_probability AS p,
                       row_number() OVER (ORDER BY churn_probability DESC NULLS LAST, customer_id) AS place
                FROM ({CHURN_SCORES_SQL}))
SELECT customer_id, p AS churn_probability,
       ['Low Risk', 'Medium Risk', 'High Risk'][1 + IFNULL(p > {RISK_MEDIUM}, false)::INT + IFNULL(p > {RISK_HIGH}, false)::INT]
         AS risk_category
FROM ranked WHERE place <= 100
"""


def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    lab = t(spark, sf, "labels")
    return share_of_total(lab, ["quality"])


LABEL_DISTRIBUTION_SQL = """
WITH sized AS (SELECT quality, COUNT(*) AS count FROM labels GROUP BY ALL)
SELECT quality, count, ROUND(100.0 * count / (SELECT SUM(count) FROM sized), 6) AS percentage FROM sized
"""


# --- operator profile (factory) ---------------------------------------------

def operator_profile_q(spark: SparkSession, sf: str) -> DataFrame:
    return operator_profile(quality_flag(spark, sf), ORDERS_ASOF)


OPERATOR_PROFILE_SQL = f"""
WITH w AS ({QUALITY_FLAG_SQL}),
a AS (
  SELECT operator_id,
         COUNT(*) FILTER (WHERE quality_flag = 'VALID') AS total_work_orders,
         COUNT(*) FILTER (WHERE quality_flag = 'VALID' AND status = 'completed') AS completed_orders,
         COUNT(*) FILTER (WHERE quality_flag = 'VALID' AND status <> 'completed') AS open_orders,
         SUM(quantity) FILTER (WHERE quality_flag = 'VALID') AS total_units,
         AVG(duration_hours) FILTER (WHERE quality_flag = 'VALID') AS avg_duration_hours,
         MIN(duration_hours) FILTER (WHERE quality_flag = 'VALID') AS min_duration_hours,
         MAX(duration_hours) FILTER (WHERE quality_flag = 'VALID') AS max_duration_hours,
         STDDEV_SAMP(duration_hours) FILTER (WHERE quality_flag = 'VALID') AS stddev_duration_hours,
         SUM(duration_hours) FILTER (WHERE quality_flag = 'VALID') AS hours,
         COUNT(DISTINCT product_id) FILTER (WHERE quality_flag = 'VALID') AS distinct_products,
         COUNT(*) AS n_all
  FROM w GROUP BY operator_id)
SELECT operator_id, total_work_orders, completed_orders, open_orders,
       ROUND(total_units, 4) AS total_units,
       ROUND(avg_duration_hours, 4) AS avg_duration_hours,
       ROUND(min_duration_hours, 4) AS min_duration_hours,
       ROUND(max_duration_hours, 4) AS max_duration_hours,
       ROUND(stddev_duration_hours, 4) AS stddev_duration_hours,
       ROUND(total_units / NULLIF(hours, 0), 6) AS units_per_hour,
       ROUND(CAST(completed_orders AS DOUBLE) / NULLIF(total_work_orders, 0), 6) AS completion_rate,
       distinct_products,
       ROUND(CAST(total_work_orders AS DOUBLE) / NULLIF(n_all, 0), 6) AS quality_score,
       CASE WHEN total_units / NULLIF(hours, 0) > 75
             AND CAST(completed_orders AS DOUBLE) / NULLIF(total_work_orders, 0) > 0.9 THEN 1 ELSE 0 END
         AS is_high_performer,
       TIMESTAMP '{ORDERS_ASOF} 00:00:00' AS feature_timestamp
FROM a WHERE total_work_orders >= 5
"""


def layer_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row count per layer, one union of three distributed counts."""
    def cnt(df, layer, name):
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), "row_count")
    return (cnt(t(spark, sf, "orders"), "bronze", "orders")
            .unionByName(cnt(clean_transactions(spark, sf), "silver", "transactions_cleaned"))
            .unionByName(cnt(customer_metrics_q(spark, sf), "gold", "customer_metrics")))


LAYER_COUNTS_SQL = f"""
SELECT 'bronze' AS layer, 'orders' AS table_name, COUNT(*) AS row_count FROM orders
UNION ALL SELECT 'silver', 'transactions_cleaned', COUNT(*) FROM ({CLEAN_TRANSACTIONS_SQL}) s
UNION ALL SELECT 'gold', 'customer_metrics', COUNT(*) FROM ({CUSTOMER_METRICS_SQL}) g
"""


def label_churn(spark: SparkSession, sf: str, days: int = 60) -> DataFrame:
    """Churn label: last purchase more than ``days`` before the as-of date.

    Customers with no purchase get 0, because the comparison with NULL is not
    true (kept as the reference's SQL behaves)."""
    cust = clean_customers(spark, sf).select("customer_id")
    last = clean_transactions(spark, sf).groupBy("customer_id").agg(
        F.max("transaction_date").alias("last_purchase_date"))
    gap = F.datediff(lit_date(ORDERS_ASOF), F.col("last_purchase_date"))
    return (cust.join(last, "customer_id", "left")
                .select("customer_id", "last_purchase_date",
                        F.when(gap > days, 1).otherwise(0).alias("churned"),
                        lit_ts(ORDERS_ASOF).alias("label_timestamp")))


LABEL_CHURN_SQL = f"""
SELECT c.customer_id, l.last_purchase_date,
       CASE WHEN date_diff('day', l.last_purchase_date, DATE '{ORDERS_ASOF}') > 60 THEN 1 ELSE 0 END AS churned,
       TIMESTAMP '{ORDERS_ASOF} 00:00:00' AS label_timestamp
FROM ({CLEAN_CUSTOMERS_SQL}) c
LEFT JOIN (SELECT customer_id, MAX(transaction_date) AS last_purchase_date
           FROM ({CLEAN_TRANSACTIONS_SQL}) t GROUP BY customer_id) l ON c.customer_id = l.customer_id
"""


# --- trend / seasonality (F-10) ---------------------------------------------

def _monthly_revenue(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    month_idx = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1)
    return (o.groupBy(F.col("o_orderpriority").alias("group_key"), month_idx.alias("month_index"))
             .agg(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("_rev"))
             .withColumn("revenue_k", F.col("_rev").cast("double") / 1000.0).drop("_rev"))


def trend_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Linear trend of monthly revenue per group (pre-aggregated per month,
    then regr_* over the small monthly series)."""
    m = _monthly_revenue(spark, sf)
    return (m.groupBy("group_key")
             .agg(F.regr_slope("revenue_k", "month_index").alias("slope"),
                  F.regr_intercept("revenue_k", "month_index").alias("intercept"),
                  F.count(F.lit(1)).alias("n_months"))
             .select("group_key", round_double("slope", 4).alias("slope"),
                     round_double("intercept", 4).alias("intercept"), "n_months"))


MONTHLY_REVENUE_SQL = """
SELECT o_orderpriority AS group_key,
       (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS month_index,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / 1000.0 AS revenue_k
FROM orders GROUP BY 1, 2
"""

TREND_PER_GROUP_SQL = f"""
SELECT group_key, ROUND(regr_slope(revenue_k, month_index), 4) AS slope,
       ROUND(regr_intercept(revenue_k, month_index), 4) AS intercept, COUNT(*) AS n_months
FROM ({MONTHLY_REVENUE_SQL}) m GROUP BY group_key
"""


def seasonality_index(spark: SparkSession, sf: str) -> DataFrame:
    """Month-of-year index = avg revenue of that calendar month / overall
    monthly average, per group; all on the monthly aggregate."""
    m = (_monthly_revenue(spark, sf)
         .withColumn("month_of_year", (F.col("month_index") % 12) + 1))
    by_moy = m.groupBy("group_key", "month_of_year").agg(F.avg("revenue_k").alias("moy_avg"))
    overall = m.groupBy("group_key").agg(F.avg("revenue_k").alias("all_avg"))
    return (by_moy.join(overall, "group_key")
                  .select("group_key", "month_of_year",
                          round_double(safe_ratio(F.col("moy_avg"), F.col("all_avg")), 4)
                           .alias("seasonality_index")))


SEASONALITY_INDEX_SQL = f"""
WITH m AS (SELECT *, (month_index % 12) + 1 AS month_of_year FROM ({MONTHLY_REVENUE_SQL}) x),
b AS (SELECT group_key, month_of_year, AVG(revenue_k) AS moy_avg FROM m GROUP BY 1, 2),
o AS (SELECT group_key, AVG(revenue_k) AS all_avg FROM m GROUP BY 1)
SELECT b.group_key, CAST(b.month_of_year AS INTEGER) AS month_of_year, ROUND(b.moy_avg / NULLIF(o.all_avg, 0), 4) AS seasonality_index
FROM b JOIN o ON b.group_key = o.group_key
"""


def price_elasticity(spark: SparkSession, sf: str) -> DataFrame:
    """Elasticity per product, shrunk to its brand: units sold against the unit price
    after discount."""
    sales = t(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("units"),
        (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)) * (1 - F.col("l_discount"))).alias("unit_price"))
    products = t(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))
    out = group_elasticity(sales, "product_id", "unit_price", "units", products, "brand")
    return out.select("product_id", "brand", F.col("n_sales").cast("bigint").alias("n_sales"),
                      *[round_double(c, 4).alias(c) for c in ("slope", "category_mean", "weight", "elasticity")])


PRICE_ELASTICITY_SQL = """
WITH s AS (SELECT l_partkey, ln(l_extendedprice / NULLIF(l_quantity, 0) * (1 - l_discount)) AS x, ln(l_quantity) AS y
           FROM lineitem WHERE l_quantity > 0 AND l_extendedprice * (1 - l_discount) > 0),
f AS (SELECT l_partkey, regr_count(y, x) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy
      FROM s GROUP BY l_partkey),
v AS (SELECT f.l_partkey, p_brand, n, b, CASE WHEN n > 2 AND sxx > 1e-12 AND syy - b * b * sxx > 1e-12
                                      THEN (syy - b * b * sxx) / (n - 2) / sxx END AS v
      FROM f JOIN part ON p_partkey = f.l_partkey),
m AS (SELECT p_brand, sum(b / v) / sum(1 / v) AS mean, count(*) AS k, sum(1 / v) AS sw, sum(1 / v / v) AS sw2
      FROM v WHERE v IS NOT NULL GROUP BY p_brand),
q AS (SELECT m.p_brand, mean, k, sw, sw2, sum((b - mean) * (b - mean) / v) AS q
      FROM v JOIN m ON m.p_brand = v.p_brand WHERE v IS NOT NULL GROUP BY ALL),
c AS (SELECT p_brand, mean, CASE WHEN k > 1 THEN greatest((q - (k - 1)) / nullif(sw - sw2 / sw, 0), 0.0) ELSE 0.0 END AS t FROM q),
w AS (SELECT v.*, c.mean, coalesce(t / (t + v), 0.0) AS w FROM v LEFT JOIN c ON c.p_brand = v.p_brand)
SELECT l_partkey AS product_id, p_brand AS brand, CAST(n AS BIGINT) AS n_sales, ROUND(b, 4) AS slope,
       ROUND(mean, 4) AS category_mean, ROUND(w, 4) AS weight,
       ROUND(CASE WHEN w > 0 THEN mean + w * (b - mean) ELSE mean END, 4) AS elasticity
FROM w
"""


# --- user SQL pass-through (PRJ-01) -------------------------------------------

PASSTHROUGH_SQL = """
WITH spend AS (
  SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS spend, COUNT(*) AS n
  FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey)
SELECT c.c_mktsegment AS segment, COUNT(*) AS customers,
       CAST(SUM(s.spend) AS DOUBLE) AS total_spend, CAST(SUM(s.n) AS BIGINT) AS n_orders,
       MAX(s.n) AS max_orders_per_customer
FROM customer c JOIN spend s ON c.c_custkey = s.o_custkey
GROUP BY c.c_mktsegment;
"""


def sql_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    from tierline.operators.clean import transform_sql
    return transform_sql(spark, PASSTHROUGH_SQL,
                         {"orders": t(spark, sf, "orders"), "customer": t(spark, sf, "customer")})


DEFECT_UNITS = 50


def label_defect(spark: SparkSession, sf: str) -> DataFrame:
    """Defect label per work order: fewer than 50 units produced."""
    w = quality_flag(spark, sf)
    return w.select("work_order_id", F.col("quantity").alias("produced_units"),
                    (F.col("quantity") < DEFECT_UNITS).alias("defect_detected"),
                    F.col("processed_at").alias("created_at"))


LABEL_DEFECT_SQL = f"""
SELECT work_order_id, quantity AS produced_units, quantity < 50 AS defect_detected, processed_at AS created_at
FROM ({QUALITY_FLAG_SQL}) w
"""


QUERIES = {
    "customer_metrics": customer_metrics_q,
    "txn_summary": txn_summary,
    "data_coverage": data_coverage,
    "monthly_summary": monthly_summary,
    "daily_summary": daily_summary,
    "risk_distribution": risk_distribution,
    "top_risk": top_risk,
    "label_distribution": label_distribution,
    "operator_profile": operator_profile_q,
    "layer_counts": layer_counts,
    "label_churn": label_churn,
    "trend_per_group": trend_per_group,
    "seasonality_index": seasonality_index,
    "price_elasticity": price_elasticity,
    "sql_passthrough": sql_passthrough,
    "label_defect": label_defect,
}

ORACLES = {
    "customer_metrics": CUSTOMER_METRICS_SQL,
    "txn_summary": TXN_SUMMARY_SQL,
    "data_coverage": DATA_COVERAGE_SQL,
    "monthly_summary": MONTHLY_SUMMARY_SQL,
    "daily_summary": DAILY_SUMMARY_SQL,
    "risk_distribution": RISK_DISTRIBUTION_SQL,
    "top_risk": TOP_RISK_SQL,
    "label_distribution": LABEL_DISTRIBUTION_SQL,
    "operator_profile": OPERATOR_PROFILE_SQL,
    "layer_counts": LAYER_COUNTS_SQL,
    "label_churn": LABEL_CHURN_SQL,
    "trend_per_group": TREND_PER_GROUP_SQL,
    "seasonality_index": SEASONALITY_INDEX_SQL,
    "price_elasticity": PRICE_ELASTICITY_SQL,
    "sql_passthrough": PASSTHROUGH_SQL.strip().rstrip(";"),
    "label_defect": LABEL_DEFECT_SQL,
}
