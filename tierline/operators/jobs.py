"""The main job in one call: path list -> user SQL -> table, with row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from tierline.operators.clean import transform_sql
from tierline.operators.sinks import write_table
from tierline.sources.files import read_sources


def silver_job(spark: SparkSession, paths: Sequence[str], sql: str | Sequence[str], table: str,
               location: str | None = None, mode: str = "append", partition_by: Sequence[str] | None = None,
               view: str = "source_data", fmt: str = "parquet", on_missing: str = "fail") -> dict:
    """Union the files of ``paths``, run read-only ``sql`` over them as ``view``, write
    the result to ``table`` and return ``rows_in`` and ``rows_out``.

    Everything is one write action: the counts are observed while it runs.  It
    runs in a child session (same cluster and catalog), which keeps the
    observations' state and the view away from the caller's session."""
    child = spark.newSession()
    rows_in, rows_out = Observation("rows_in"), Observation("rows_out")
    source = read_sources(child, paths, fmt, on_missing, view=None).observe(rows_in, F.count(F.lit(1)).alias("n"))
    out = transform_sql(child, sql, {view: source}).observe(rows_out, F.count(F.lit(1)).alias("n"))
    write_table(child, out, table, mode, partition_by, location)
    spark.catalog.refreshTable(table)
    return {"rows_in": rows_in.get["n"], "rows_out": rows_out.get["n"]}
