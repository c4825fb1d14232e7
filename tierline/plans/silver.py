"""Silver layer over the driver tables.

Mapping (see FIXTURES.md C): customers = customer + nation (country) with the
first order date as registration date; transactions = orders; work orders =
lineitem + orders (operator = supplier, units = quantity, start = order date,
end = ship date); support tickets = error events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions import hours_between
from tierline.operators.clean import (
    add_audit_columns, dedup_exact, dedup_latest, deidentify, quality_flags,
    quality_report, standardize,
)
from tierline.plans.common import PROCESSED_AT, RULE_VERSION, RUN_ID, t


def clean_customers(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer")
    n = t(spark, sf, "nation").select("n_nationkey", "n_name")
    first_order = (t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
                   .agg(F.min("o_orderdate").cast("date").alias("registration_date")))
    email = F.trim(F.lower(F.concat(F.regexp_replace("c_name", "#", "@"), F.lit(".example.com"))))
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
             .join(first_order, "c_custkey", "left")
             .select(F.col("c_custkey").alias("customer_id"),
                     email.alias("email"),
                     F.coalesce(F.col("c_name"), F.lit("Unknown")).alias("name"),
                     F.col("registration_date"),
                     F.when(F.lower("c_mktsegment").isin("building", "automobile"),
                            F.lower("c_mktsegment")).otherwise(F.lit("inactive")).alias("status"),
                     F.coalesce(F.upper("n_name"), F.lit("UNKNOWN")).alias("country"),
                     F.col("c_acctbal").alias("account_balance"))
             .filter(F.col("email").isNotNull() & F.col("email").like("%@%")
                     & (F.col("account_balance") > 0)))


CLEAN_CUSTOMERS_SQL = """
SELECT c.c_custkey AS customer_id,
       TRIM(LOWER(REPLACE(c.c_name, '#', '@') || '.example.com')) AS email,
       COALESCE(c.c_name, 'Unknown') AS name,
       fo.registration_date,
       CASE WHEN LOWER(c.c_mktsegment) IN ('building', 'automobile') THEN LOWER(c.c_mktsegment)
            ELSE 'inactive' END AS status,
       COALESCE(UPPER(n.n_name), 'UNKNOWN') AS country,
       c.c_acctbal AS account_balance
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS registration_date
           FROM orders GROUP BY o_custkey) fo ON fo.o_custkey = c.c_custkey
WHERE TRIM(LOWER(REPLACE(c.c_name, '#', '@') || '.example.com')) IS NOT NULL
  AND TRIM(LOWER(REPLACE(c.c_name, '#', '@') || '.example.com')) LIKE '%@%'
  AND c.c_acctbal > 0
"""


def clean_transactions(spark: SparkSession, sf: str, since: str = "1996-01-01") -> DataFrame:
    return clean_orders(t(spark, sf, "orders"), since)


def clean_orders(o: DataFrame, since: str = "1996-01-01") -> DataFrame:
    """Completed, positive, attributed orders since ``since`` as transactions."""
    status = F.lower(F.trim(F.col("o_orderstatus")))
    return (o.filter((F.col("o_totalprice") > 0) & F.col("o_custkey").isNotNull()
                     & (F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
                     & (status == "f"))
             .select(F.col("o_orderkey").alias("transaction_id"),
                     F.col("o_custkey").alias("customer_id"),
                     F.col("o_totalprice").try_cast("decimal(10,2)").alias("amount"),
                     F.col("o_orderdate").cast("date").alias("transaction_date"),
                     F.lower(F.trim("o_orderpriority")).alias("payment_method"),
                     F.lit("completed").alias("status")))


def clean_transactions_checked(spark: SparkSession, sf: str) -> DataFrame:
    return clean_transactions(spark, sf).withColumn("amount", F.col("amount").cast("double"))


CLEAN_TRANSACTIONS_SQL = """
SELECT o_orderkey AS transaction_id, o_custkey AS customer_id,
       TRY_CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
       CAST(o_orderdate AS DATE) AS transaction_date,
       LOWER(TRIM(o_orderpriority)) AS payment_method,
       'completed' AS status
FROM orders
WHERE o_totalprice > 0 AND o_custkey IS NOT NULL
  AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'
  AND LOWER(TRIM(o_orderstatus)) = 'f'
"""
CLEAN_TRANSACTIONS_CHECKED_SQL = f"""
SELECT transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount, transaction_date,
       payment_method, status FROM ({CLEAN_TRANSACTIONS_SQL}) s
"""


def support_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Error events stand in for support tickets; value = resolution hours."""
    e = t(spark, sf, "events")
    return (e.filter(F.col("event_type") == "error")
             .select(F.col("event_id").alias("ticket_id"), F.col("user_id").alias("customer_id"),
                     F.col("ts").alias("created_at"),
                     F.col("value").alias("resolution_time_hours")))


# --- work orders (factory example) ---------------------------------------

def work_orders_bronze(spark: SparkSession, sf: str) -> DataFrame:
    """Raw work orders: one per line item, start = order date."""
    li = t(spark, sf, "lineitem")
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "left")
              .select(F.concat(F.lit(" wo-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                               F.col("l_linenumber").cast("string")).alias("work_order_id"),
                      F.concat(F.lit("prod-"), F.col("l_partkey").cast("string")).alias("product_id"),
                      F.when(F.col("l_linestatus") == "F", F.lit("COMPLETED"))
                       .otherwise(F.lit("Open")).alias("status"),
                      F.col("l_quantity").alias("quantity"),
                      F.when(F.col("l_suppkey").isNotNull(),
                             F.concat(F.lit("emp-"), F.col("l_suppkey").cast("string")))
                       .alias("operator_id"),
                      F.col("o_orderdate").alias("start_time"),
                      F.col("l_shipdate").alias("end_time")))


# Work-order quality rules (rule name -> broken when TRUE).
def work_order_rules() -> dict:
    return {
        "completed_without_end": (F.col("status") == "completed") & F.col("end_time").isNull(),
        "non_positive_quantity": F.col("quantity") <= 0,
        "end_before_start": F.col("end_time") < F.col("start_time"),
        "unassigned_operator": F.col("operator_id") == "UNASSIGNED",
    }


def quality_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Standardize, default bad values, flag VALID/INVALID, stamp audit columns.

    Rows with no work order id are unusable and removed; rows breaking a rule
    are kept with the failed rule names."""
    raw = work_orders_bronze(spark, sf).filter(F.col("work_order_id").isNotNull())
    std = standardize(raw, upper_trim=["work_order_id", "product_id", "operator_id"],
                      lower_trim=["status"])
    std = std.withColumns({
        "operator_id": F.coalesce(F.col("operator_id"), F.lit("UNASSIGNED")),
        "raw_quantity": F.col("quantity"),
        "quantity": F.greatest(F.coalesce(F.col("quantity"), F.lit(0.0)), F.lit(0.0)),
        "duration_hours": hours_between("start_time", "end_time"),
    })
    flagged = quality_flags(std, work_order_rules())
    return add_audit_columns(flagged.drop("raw_quantity"), RUN_ID, RULE_VERSION, PROCESSED_AT)


WORK_ORDERS_SQL = """
SELECT UPPER(TRIM(' wo-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR))) AS work_order_id,
       UPPER(TRIM('prod-' || CAST(l.l_partkey AS VARCHAR))) AS product_id,
       LOWER(TRIM(CASE WHEN l.l_linestatus = 'F' THEN 'COMPLETED' ELSE 'Open' END)) AS status,
       GREATEST(COALESCE(l.l_quantity, 0.0), 0.0) AS quantity,
       COALESCE(UPPER(TRIM(CASE WHEN l.l_suppkey IS NOT NULL THEN 'emp-' || CAST(l.l_suppkey AS VARCHAR) END)), 'UNASSIGNED') AS operator_id,
       o.o_orderdate AS start_time,
       l.l_shipdate AS end_time,
       CAST(date_diff('microsecond', o.o_orderdate, l.l_shipdate) AS DOUBLE) / 3600000000.0 AS duration_hours,
       l.l_quantity AS raw_quantity
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

QUALITY_FLAG_SQL = f"""
WITH w AS ({WORK_ORDERS_SQL}),
r AS (
  SELECT *, list_filter([
      CASE WHEN COALESCE(status = 'completed' AND end_time IS NULL, FALSE) THEN 'completed_without_end' END,
      CASE WHEN COALESCE(quantity <= 0, FALSE) THEN 'non_positive_quantity' END,
      CASE WHEN COALESCE(end_time < start_time, FALSE) THEN 'end_before_start' END,
      CASE WHEN COALESCE(operator_id = 'UNASSIGNED', FALSE) THEN 'unassigned_operator' END
  ], lambda x: x IS NOT NULL) AS failed_rules
  FROM w)
SELECT work_order_id, product_id, status, quantity, operator_id, start_time, end_time,
       duration_hours, failed_rules,
       CASE WHEN len(failed_rules) = 0 THEN 'VALID' ELSE 'INVALID' END AS quality_flag,
       TIMESTAMP '2024-02-01 00:00:00' AS processed_at,
       'rules-v1' AS rule_version, 'run-0001' AS ingest_run_id
FROM r
"""


def quality_report_q(spark: SparkSession, sf: str) -> DataFrame:
    raw = work_orders_bronze(spark, sf)
    std = standardize(raw, upper_trim=["work_order_id", "product_id", "operator_id"],
                      lower_trim=["status"])
    std = std.withColumns({"operator_id": F.coalesce(F.col("operator_id"), F.lit("UNASSIGNED")),
                           "quantity": F.greatest(F.coalesce(F.col("quantity"), F.lit(0.0)),
                                                  F.lit(0.0))})
    return quality_report(std, work_order_rules(), F.col("work_order_id").isNotNull())


QUALITY_REPORT_SQL = f"""
WITH w AS ({WORK_ORDERS_SQL}),
k AS (SELECT *, COALESCE(work_order_id IS NOT NULL, FALSE) AS kept FROM w),
a AS (
  SELECT COUNT(*) AS rows_in, COUNT(*) FILTER (WHERE kept) AS rows_kept,
         COUNT(*) FILTER (WHERE NOT kept) AS rows_removed,
         COUNT(*) FILTER (WHERE kept AND COALESCE(status = 'completed' AND end_time IS NULL, FALSE)) AS f1,
         COUNT(*) FILTER (WHERE kept AND COALESCE(quantity <= 0, FALSE)) AS f2,
         COUNT(*) FILTER (WHERE kept AND COALESCE(end_time < start_time, FALSE)) AS f3,
         COUNT(*) FILTER (WHERE kept AND COALESCE(operator_id = 'UNASSIGNED', FALSE)) AS f4
  FROM k)
SELECT rows_in, rows_kept, rows_removed, 'completed_without_end' AS rule, f1 AS failed, rows_kept - f1 AS passed FROM a
UNION ALL SELECT rows_in, rows_kept, rows_removed, 'non_positive_quantity', f2, rows_kept - f2 FROM a
UNION ALL SELECT rows_in, rows_kept, rows_removed, 'end_before_start', f3, rows_kept - f3 FROM a
UNION ALL SELECT rows_in, rows_kept, rows_removed, 'unassigned_operator', f4, rows_kept - f4 FROM a
"""


def standardize_text(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return standardize(p, upper_trim=["p_brand"], lower_trim=["p_type", "p_name"])


STANDARDIZE_TEXT_SQL = """
SELECT p_partkey, LOWER(TRIM(p_name)) AS p_name, UPPER(TRIM(p_brand)) AS p_brand,
       LOWER(TRIM(p_type)) AS p_type FROM part
"""


def dedup_exact_q(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                         "l_linestatus")
    return dedup_exact(li)


DEDUP_EXACT_SQL = "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem"


def dedup_latest_q(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem")
    return dedup_latest(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


DEDUP_LATEST_SQL = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
     ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
              l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
              l_linestatus DESC) AS rn
  FROM lineitem) WHERE rn = 1
"""


def deidentify_q(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select("doc_id", "source", "text")
    return deidentify(d, hash_cols=["source"], redact_cols=["text"])


DEIDENTIFY_SQL = r"""
SELECT doc_id, sha256(source) AS source,
       regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'),
                      '\+?[0-9][0-9 ().-]{7,}[0-9]', '[PHONE]', 'g') AS text
FROM documents
"""


def audit_columns(spark: SparkSession, sf: str) -> DataFrame:
    return add_audit_columns(clean_transactions_checked(spark, sf), RUN_ID, RULE_VERSION,
                             PROCESSED_AT)


AUDIT_COLUMNS_SQL = f"""
SELECT *, TIMESTAMP '2024-02-01 00:00:00' AS processed_at, 'rules-v1' AS rule_version,
       'run-0001' AS ingest_run_id FROM ({CLEAN_TRANSACTIONS_CHECKED_SQL}) s
"""


QUERIES = {
    "clean_customers": clean_customers,
    "clean_transactions": clean_transactions_checked,
    "quality_flag": quality_flag,
    "quality_report": quality_report_q,
    "standardize_text": standardize_text,
    "dedup_exact": dedup_exact_q,
    "dedup_latest": dedup_latest_q,
    "deidentify": deidentify_q,
    "audit_columns": audit_columns,
}

ORACLES = {
    "clean_customers": CLEAN_CUSTOMERS_SQL,
    "clean_transactions": CLEAN_TRANSACTIONS_CHECKED_SQL,
    "quality_flag": QUALITY_FLAG_SQL,
    "quality_report": QUALITY_REPORT_SQL,
    "standardize_text": STANDARDIZE_TEXT_SQL,
    "dedup_exact": DEDUP_EXACT_SQL,
    "dedup_latest": DEDUP_LATEST_SQL,
    "deidentify": DEIDENTIFY_SQL,
    "audit_columns": AUDIT_COLUMNS_SQL,
}
