"""Sources, bronze copy, sinks and materializations over the driver tables.

Each query writes below the shared scratch root (``spark.checkpoint.dir``)
and returns the data read back, so the check sees what was persisted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.operators.clean import transform_sql
from tierline.operators.jobs import silver_job
from tierline.operators.sinks import (
    apply_change_feed, materialize, observed_write, write_parquet, write_table,
)
from tierline.plans.common import PROCESSED_AT, RUN_ID, t
from tierline.plans.silver import (
    CLEAN_TRANSACTIONS_CHECKED_SQL, CLEAN_TRANSACTIONS_SQL, clean_orders,
    clean_transactions_checked,
)
from tierline.session import scratch_path
from tierline.sources.catalog import catalog_profile
from tierline.sources.files import files_of, path_sql, read_json_documents, read_sources
from tierline.sources.tables import TABLES, table_path


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


# --- sources ----------------------------------------------------------------

def src_union(spark: SparkSession, sf: str) -> DataFrame:
    return read_sources(spark, [table_path(sf, "customer"), table_path(sf, "supplier")],
                        view=None)


SRC_UNION_SQL = "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier"

PATH_SQL = """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n_lines,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price
FROM {source}
WHERE l_shipdate <= {cutoff}
GROUP BY l_returnflag, l_linestatus
"""


def src_path_sql(spark: SparkSession, sf: str) -> DataFrame:
    return path_sql(spark, PATH_SQL.replace("{source}", "parquet.`{lineitem}`")
                    .replace("{cutoff}", "TIMESTAMP_NTZ '1998-09-02 00:00:00'"),
                    lineitem=table_path(sf, "lineitem"))


SRC_PATH_SQL = PATH_SQL.replace("{source}", "lineitem") \
    .replace("{cutoff}", "TIMESTAMP '1998-09-02 00:00:00'")


def src_json_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Document collection exported as JSON lines, read back with an inferred
    schema (stands in for a document-store ingestion)."""
    path = scratch_path(spark, "json_docs")
    t(spark, sf, "documents").write.mode("overwrite").json(path)
    return read_json_documents(spark, path)


SRC_JSON_DOCS_SQL = "SELECT doc_id, text, lang, source, n_chars FROM documents"


def src_files(spark: SparkSession, sf: str) -> DataFrame:
    return files_of(t(spark, sf, "orders")).drop("file_size")


SRC_FILES_SQL = "SELECT 'orders.parquet' AS file_name, COUNT(*) AS n_rows FROM orders"

def catalog_profile_q(spark: SparkSession, sf: str) -> DataFrame:
    """Every driver table as an external table of a fresh namespace, a partitioned
    table and a view on it; bytes and places are reported as present or not."""
    ns = _name("profile")
    spark.sql(f"CREATE DATABASE {ns} LOCATION '{scratch_path(spark, ns)}'")
    for n in TABLES:
        spark.sql(f"CREATE TABLE {ns}.{n} USING parquet LOCATION '{table_path(sf, n)}'")
    write_table(spark, _orders_by_year(spark, sf), f"{ns}.orders_by_year", partition_by=["year"],
                location=scratch_path(spark, ns) + "/orders_by_year")
    spark.sql(f"CREATE VIEW {ns}.big_years AS SELECT year, COUNT(*) AS n FROM {ns}.orders_by_year GROUP BY year")
    return catalog_profile(spark, ns).select(
        "table_name", "kind", "column_count", F.array_join("partition_columns", ",").alias("partitioned_by"), "row_count",
        F.col("location").isNotNull().alias("has_location"), F.coalesce(F.col("size_bytes") > 0, F.lit(False)).alias("has_size"))


CATALOG_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, 'EXTERNAL' AS kind, "
    f"CAST((SELECT COUNT(*) FROM (DESCRIBE {n})) AS BIGINT) AS column_count, '' AS partitioned_by, COUNT(*) AS row_count, "
    f"true AS has_location, true AS has_size FROM {n}"
    for n in TABLES) + """
 UNION ALL SELECT 'orders_by_year', 'EXTERNAL', 3, 'year', COUNT(*), true, true FROM orders
 UNION ALL SELECT 'big_years', 'VIEW', 2, '', COUNT(DISTINCT year(o_orderdate)), false, false FROM orders
"""


def bronze_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Raw copy with ingest stamps (run id, time, source file); no change
    to the data columns."""
    src = t(spark, sf, "orders")
    stamped = src.select("*", F.lit(RUN_ID).alias("_ingest_run_id"),
                         F.lit(PROCESSED_AT).cast("timestamp_ntz").alias("_ingested_at"),
                         F.col("_metadata.file_name").alias("_source_file"))
    path = scratch_path(spark, "bronze_orders")
    write_parquet(stamped, path)
    return spark.read.parquet(path)


BRONZE_COPY_SQL = f"""
SELECT *, '{RUN_ID}' AS _ingest_run_id, TIMESTAMP '{PROCESSED_AT}' AS _ingested_at,
       'orders.parquet' AS _source_file FROM orders
"""


# --- sinks ------------------------------------------------------------------

def _split(df: DataFrame, col: str, at: str):
    return df.filter(F.col(col) < F.lit(at).cast("date")), df.filter(F.col(col) >= F.lit(at).cast("date"))


def snk_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    tx = clean_transactions_checked(spark, sf)
    first, _ = _split(tx, "transaction_date", "1998-01-01")
    path = scratch_path(spark, "snk_overwrite")
    write_parquet(first, path)             # an earlier run
    write_parquet(tx, path, "overwrite")   # replaced whole
    return spark.read.parquet(path)


def snk_append(spark: SparkSession, sf: str) -> DataFrame:
    tx = clean_transactions_checked(spark, sf)
    first, second = _split(tx, "transaction_date", "1998-01-01")
    path = scratch_path(spark, "snk_append")
    write_parquet(first, path)
    write_parquet(second, path, "append")
    return spark.read.parquet(path)


def snk_create_then_append(spark: SparkSession, sf: str) -> DataFrame:
    tx = clean_transactions_checked(spark, sf)
    first, second = _split(tx, "transaction_date", "1998-01-01")
    table = f"silver.{_name('transactions_cleaned')}"
    loc = scratch_path(spark, "snk_table")
    write_table(spark, first, table, "append", location=loc)   # missing -> created
    write_table(spark, second, table, "append")               # exists -> appended
    return spark.table(table)


def snk_dynamic_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Overwrite only the partitions present in the new data."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice",
                                      F.year("o_orderdate").alias("year"))
    table = f"silver.{_name('orders_by_year')}"
    write_table(spark, o, table, partition_by=["year"], location=scratch_path(spark, "snk_dyn"))
    redo = o.filter(F.col("year") == 1999).withColumn("o_totalprice", F.col("o_totalprice") + 100.0)
    write_table(spark, redo, table, "overwrite")
    return spark.table(table)


SNK_DYNAMIC_SQL = """
SELECT o_orderkey,
       CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice + 100.0 ELSE o_totalprice END AS o_totalprice,
       CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders
"""


def snk_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Partitioned write, all partitions read back (pruning by a filter on the
    partition column is a plan test)."""
    path = scratch_path(spark, "snk_partitioned")
    write_parquet(clean_transactions_checked(spark, sf), path, partition_by=["payment_method"])
    return spark.read.parquet(path)


def snk_replace_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Replacing a partitioned table: years missing in the new data are gone."""
    o = _orders_by_year(spark, sf)
    table = f"silver.{_name('orders_replaced')}"
    write_table(spark, o, table, partition_by=["year"], location=scratch_path(spark, "snk_rep") + "/v0")
    write_table(spark, o.filter("year <> 1997").withColumn("o_totalprice", F.col("o_totalprice") + 1.0), table, "replace")
    return spark.table(table)


SNK_REPLACE_PARTITIONED_SQL = """
SELECT o_orderkey, o_totalprice + 1.0 AS o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders WHERE year(o_orderdate) <> 1997
"""


def _orders_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in / out of a silver run, observed during the single write."""
    path = scratch_path(spark, "run_metrics")
    m = observed_write(spark, lambda s: t(s, sf, "orders"), clean_orders, path)
    return spark.createDataFrame([(int(m["rows_in"]), int(m["rows_out"]))],
                                 "rows_in bigint, rows_out bigint")


RUN_METRICS_SQL = f"""
SELECT (SELECT COUNT(*) FROM orders) AS rows_in,
       (SELECT COUNT(*) FROM ({CLEAN_TRANSACTIONS_SQL}) s) AS rows_out
"""


SILVER_JOB_SQL = """
SELECT thousand, COUNT(*) AS n, CAST(SUM(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM (SELECT CAST(FLOOR(COALESCE(c_acctbal, s_acctbal) / 1000) AS INTEGER) AS thousand,
             COALESCE(c_acctbal, s_acctbal) AS balance FROM source_data) b
GROUP BY thousand
"""


def silver_job_q(spark: SparkSession, sf: str) -> DataFrame:
    """Two paths -> user SQL -> table, with the run's counts beside the rows."""
    table = f"silver.{_name('parties')}"
    m = silver_job(spark, [table_path(sf, "customer"), table_path(sf, "supplier")], SILVER_JOB_SQL, table,
                   location=scratch_path(spark, "silver") + "/parties")
    return spark.table(table).withColumns({k: F.lit(int(m[k])).cast("bigint") for k in ("rows_in", "rows_out")})


SILVER_JOB_CHECK_SQL = f"""
WITH source_data AS ({SRC_UNION_SQL}), r AS ({SILVER_JOB_SQL})
SELECT r.*, (SELECT COUNT(*) FROM source_data) AS rows_in, (SELECT COUNT(*) FROM r) AS rows_out FROM r
"""


# --- materializations ---------------------------------------------------------

def mat_table(spark: SparkSession, sf: str) -> DataFrame:
    tx = clean_transactions_checked(spark, sf)
    table = f"gold.{_name('transactions')}"
    materialize(spark, tx.limit(0), table, "table", root=scratch_path(spark, "gold"))   # first version (empty)
    return materialize(spark, tx, table, "table")        # full refresh swaps in


def mat_view(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(spark, clean_transactions_checked(spark, sf), _name("gold_view"), "view")


def mat_incr_append(spark: SparkSession, sf: str) -> DataFrame:
    tx = clean_transactions_checked(spark, sf)
    first, second = _split(tx, "transaction_date", "1998-01-01")
    table = f"gold.{_name('tx_incr')}"
    materialize(spark, first, table, "incremental", "append", root=scratch_path(spark, "gold"))
    return materialize(spark, second, table, "incremental", "append")


def mat_table_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Full refresh of a partitioned table: a year that is no more goes, a year
    that is new comes, all others are replaced."""
    o = _orders_by_year(spark, sf)
    table = f"gold.{_name('orders_by_year')}"
    materialize(spark, o.filter("year < 2000"), table, "table", partition_by=["year"], root=scratch_path(spark, "gold"))
    return materialize(spark, o.filter("year <> 1998"), table, "table")


MAT_TABLE_PARTITIONED_SQL = """
SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) <> 1998
"""


def mat_incr_append_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Appends into partitions that exist and into new ones."""
    o = _orders_by_year(spark, sf)
    table = f"gold.{_name('orders_appended')}"
    early = F.col("o_orderkey") % 2 == 0
    materialize(spark, o.filter(early & (F.col("year") < 2000)), table, "incremental", "append",
                partition_by=["year"], root=scratch_path(spark, "gold"))
    return materialize(spark, o.filter(~(early & (F.col("year") < 2000))), table, "incremental", "append")


ORDERS_BY_YEAR_SQL = "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders"


def mat_incr_merge_nonkey_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Merge on a key without the partition column: a row moves to another partition."""
    o = _orders_by_year(spark, sf)
    table = f"gold.{_name('orders_moved')}"
    materialize(spark, o, table, "incremental", "merge", ["o_orderkey"], partition_by=["year"],
                root=scratch_path(spark, "gold"))
    moved = o.filter("year >= 1999").withColumn("year", F.col("year") - 1)
    return materialize(spark, moved, table, "incremental", "merge", ["o_orderkey"])


MAT_MERGE_MOVED_SQL = f"""
SELECT o_orderkey, o_totalprice, CASE WHEN year >= 1999 THEN year - 1 ELSE year END AS year
FROM ({ORDERS_BY_YEAR_SQL}) o
"""


def _orders_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                         "o_totalprice", "o_orderdate")


def mat_incr_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed merge: the old snapshot (orders before 2000) is updated by a
    change batch (orders from 1999 on, repriced and completed)."""
    o = _orders_snapshot(spark, sf)
    old = o.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    changes = (o.filter(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
                .withColumns({"o_orderstatus": F.lit("F"),
                              "o_totalprice": F.col("o_totalprice") + 100.0}))
    table = f"gold.{_name('orders_merge')}"
    materialize(spark, old, table, "incremental", "merge", ["o_orderkey"], root=scratch_path(spark, "gold"))
    return materialize(spark, changes, table, "incremental", "merge", ["o_orderkey"])


MAT_MERGE_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate
FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00'
UNION ALL
SELECT o_orderkey, o_custkey, 'F' AS o_orderstatus, o_totalprice + 100.0 AS o_totalprice, o_orderdate
FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01 00:00:00'
"""


def mat_incr_merge_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """The keyed merge of ``mat_incr_merge`` into a year-partitioned table:
    only the years present in the change batch are read and rewritten."""
    o = _orders_snapshot(spark, sf).withColumn("year", F.year("o_orderdate"))
    old = o.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    changes = (o.filter(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
                .withColumns({"o_orderstatus": F.lit("F"),
                              "o_totalprice": F.col("o_totalprice") + 100.0}))
    table = f"gold.{_name('orders_merge_part')}"
    keys = ["year", "o_orderkey"]
    materialize(spark, old, table, "incremental", "merge", keys, partition_by=["year"],
                root=scratch_path(spark, "gold"))
    return materialize(spark, changes, table, "incremental", "merge", keys)


MAT_MERGE_PART_SQL = f"""
SELECT *, CAST(year(o_orderdate) AS INTEGER) AS year FROM ({MAT_MERGE_SQL}) m
"""


def mat_incr_delete_insert(spark: SparkSession, sf: str) -> DataFrame:
    """delete+insert on a non-unique key: every old row of a key present in
    the batch goes, all batch rows (duplicates too) come in."""
    li = t(spark, sf, "lineitem")
    old = li.filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    batch = li.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    table = f"gold.{_name('lineitem_di')}"
    keys = ["l_orderkey", "l_linenumber"]
    materialize(spark, old, table, "incremental", "delete+insert", keys, root=scratch_path(spark, "gold"))
    return materialize(spark, batch, table, "incremental", "delete_insert", keys)


MAT_DELETE_INSERT_SQL = """
WITH old AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01 00:00:00'),
new AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00')
SELECT * FROM old o WHERE NOT EXISTS (
  SELECT 1 FROM new n WHERE n.l_orderkey IS NOT DISTINCT FROM o.l_orderkey
                        AND n.l_linenumber IS NOT DISTINCT FROM o.l_linenumber)
UNION ALL SELECT * FROM new
"""


def bronze_cdc(spark: SparkSession, sf: str) -> DataFrame:
    """CDC replication into bronze: a snapshot of orders before 2000 plus a
    change feed (inserts of later orders, status updates, a second later
    update of some keys, deletes) applied by key and sequence."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                      "o_orderdate", "o_orderpriority")
    ts = lambda v: F.lit(v).cast("timestamp_ntz")
    snapshot = o.filter(F.col("o_orderdate") < ts("2000-01-01"))
    in_1999 = (F.col("o_orderdate") >= ts("1999-01-01")) & (F.col("o_orderdate") < ts("2000-01-01")) \
        & (F.col("o_orderstatus") == "O")
    inserts = o.filter(F.col("o_orderdate") >= ts("2000-01-01")) \
        .withColumns({"_op": F.lit("I"), "_seq": F.lit(1)})
    updates = o.filter(in_1999).withColumns({"o_orderstatus": F.lit("F"), "_op": F.lit("U"),
                                             "_seq": F.lit(2)})
    again = (o.filter(in_1999 & (F.col("o_orderpriority") == "1-URGENT"))
              .withColumns({"o_orderstatus": F.lit("F"), "o_totalprice": F.col("o_totalprice") + 1.0,
                            "_op": F.lit("U"), "_seq": F.lit(4)}))
    # a change that lost its op is an upsert
    updates = updates.withColumn("_op", F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("_op")))
    deletes = (o.filter((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderdate") >= ts("1998-01-01"))
                        & (F.col("o_orderdate") < ts("1999-01-01")))
                .withColumns({"_op": F.lit("D"), "_seq": F.lit(3)}))
    feed = inserts.unionByName(updates).unionByName(again).unionByName(deletes)
    return apply_change_feed(snapshot, feed, ["o_orderkey"], "_seq", "_op")


BRONZE_CDC_SQL = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01 00:00:00' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00'
                 AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01 00:00:00' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00'
                 AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_totalprice + 1.0
            ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders
WHERE NOT (o_orderpriority = '5-LOW' AND o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'
           AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00')
"""

PREVIEW_SQL = """
SELECT o_orderpriority, COUNT(*) AS n_orders, MAX(o_totalprice) AS max_total
FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3
"""


def preview_sql(spark: SparkSession, sf: str) -> DataFrame:
    """ORDER BY ordinal + LIMIT preview of a user query."""
    return transform_sql(spark, PREVIEW_SQL, {"orders": t(spark, sf, "orders")})


QUERIES = {
    "src_union": src_union,
    "src_path_sql": src_path_sql,
    "src_json_docs": src_json_docs,
    "src_files": src_files,
    "catalog_profile": catalog_profile_q,
    "bronze_copy": bronze_copy,
    "snk_overwrite": snk_overwrite,
    "snk_append": snk_append,
    "snk_create_then_append": snk_create_then_append,
    "snk_dynamic_partitions": snk_dynamic_partitions,
    "snk_partitioned": snk_partitioned,
    "run_metrics": run_metrics,
    "silver_job": silver_job_q,
    "mat_table": mat_table,
    "mat_view": mat_view,
    "snk_replace_partitioned": snk_replace_partitioned,
    "mat_table_partitioned": mat_table_partitioned,
    "mat_incr_append_partitioned": mat_incr_append_partitioned,
    "mat_incr_merge_nonkey_partition": mat_incr_merge_nonkey_partition,
    "mat_incr_append": mat_incr_append,
    "mat_incr_merge": mat_incr_merge,
    "mat_incr_delete_insert": mat_incr_delete_insert,
    "mat_incr_merge_partitioned": mat_incr_merge_partitioned,
    "bronze_cdc": bronze_cdc,
    "preview_sql": preview_sql,
}

ORACLES = {
    "src_union": SRC_UNION_SQL,
    "src_path_sql": SRC_PATH_SQL,
    "src_json_docs": SRC_JSON_DOCS_SQL,
    "src_files": SRC_FILES_SQL,
    "catalog_profile": CATALOG_PROFILE_SQL,
    "bronze_copy": BRONZE_COPY_SQL,
    "snk_overwrite": CLEAN_TRANSACTIONS_CHECKED_SQL,
    "snk_append": CLEAN_TRANSACTIONS_CHECKED_SQL,
    "snk_create_then_append": CLEAN_TRANSACTIONS_CHECKED_SQL,
    "snk_dynamic_partitions": SNK_DYNAMIC_SQL,
    "snk_partitioned": CLEAN_TRANSACTIONS_CHECKED_SQL,
    "snk_replace_partitioned": SNK_REPLACE_PARTITIONED_SQL,
    "mat_table_partitioned": MAT_TABLE_PARTITIONED_SQL,
    "mat_incr_append_partitioned": ORDERS_BY_YEAR_SQL,
    "mat_incr_merge_nonkey_partition": MAT_MERGE_MOVED_SQL,
    "run_metrics": RUN_METRICS_SQL,
    "silver_job": SILVER_JOB_CHECK_SQL,
    "mat_table": CLEAN_TRANSACTIONS_CHECKED_SQL,
    "mat_view": CLEAN_TRANSACTIONS_CHECKED_SQL,
    "mat_incr_append": CLEAN_TRANSACTIONS_CHECKED_SQL,
    "mat_incr_merge": MAT_MERGE_SQL,
    "mat_incr_delete_insert": MAT_DELETE_INSERT_SQL,
    "mat_incr_merge_partitioned": MAT_MERGE_PART_SQL,
    "bronze_cdc": BRONZE_CDC_SQL,
    "preview_sql": PREVIEW_SQL,
}
