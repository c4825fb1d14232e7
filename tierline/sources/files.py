"""File sources: path lists, direct path SQL, JSON documents, file listing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tierline.operators.clean import check_query

_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]*://", re.IGNORECASE)


def normalize_path(path: str) -> str:
    """Object-store paths go through the s3a connector; bare bucket paths
    (``bucket/prefix``) get the s3a scheme.  Local and other-scheme paths
    (``/abs``, ``file:``, ``hdfs://``, ``gs://``) are returned unchanged."""
    if path.lower().startswith("s3://"):
        return "s3a://" + path[5:]
    if _SCHEME.match(path) or path.startswith("/") or path.startswith("file:"):
        return path
    return "s3a://" + path


#: What may not stand in a SQL identifier, and what may not lead it.
_NOT_IN_NAME = re.compile(r"[^a-z0-9]+")
_DIGIT_LED = re.compile(r"^(?=\d)")


def table_name_for(path: str, catalog: str = "spark_catalog",
                   default_namespace: str = "raw", default_table: str = "table") -> str:
    """``catalog.namespace.table`` of a storage path: its last two parts.

    =================================  ==================
    path                               namespace.table
    =================================  ==================
    ``s3a://b/silver/1a2b3c4d/``       ``silver.t1a2b3c4d``
    ``s3://ns/My-Table``               ``ns.my_table``
    empty, or one part                 the defaults
    =================================  ==================
    """
    parts = [p for p in _SCHEME.sub("", path).split("/") if p]
    named = parts[-2:] if len(parts) > 1 else [default_namespace, default_table]
    clean = (_NOT_IN_NAME.sub("_", p.lower()).strip("_") or "x" for p in named)
    return ".".join([catalog, *(_DIGIT_LED.sub("t", p) for p in clean)])


def read_sources(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
                 on_missing: str = "fail", view: str | None = "source_data",
                 options: dict[str, str] | None = None) -> DataFrame:
    """Read every path and union the frames by column name.

    Columns missing in some source are NULL there (``allowMissingColumns``),
    so sources whose column order or set differs combine safely.  Missing or
    unreadable paths raise by default; ``on_missing='skip'`` drops them and
    fails only when nothing is readable.  The result is registered as a temp
    view when ``view`` is given.
    """
    if on_missing not in ("fail", "skip"):
        raise ValueError("on_missing must be 'fail' or 'skip'")
    frames: list[DataFrame] = []
    for p in paths:
        reader = spark.read.format(fmt).options(**(options or {}))
        try:
            frames.append(reader.load(normalize_path(p)))
        except AnalysisException:
            if on_missing == "fail":
                raise
    if not frames:
        raise FileNotFoundError(f"none of the sources is readable: {list(paths)}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if view:
        out.createOrReplaceTempView(view)
    return out


def path_sql(spark: SparkSession, sql: str, **paths: str) -> DataFrame:
    """Run one read-only query that reads files directly, e.g. ``FROM parquet.`{lineitem}` ``.

    ``{name}`` of a given path is replaced by the normalized path; other braces
    stay.  The file scan still gets filter pushdown and column pruning."""
    for name, path in paths.items():
        sql = sql.replace("{" + name + "}", normalize_path(path))
    return spark.sql(check_query(spark, sql))


def files_of(df: DataFrame) -> DataFrame:
    """Rows and bytes per underlying file of a file-backed DataFrame.

    Uses the hidden ``_metadata`` column, so it works on any file source and
    stays distributed (a partial aggregate per file)."""
    return (df.select(F.col("_metadata.file_name").alias("file_name"),
                      F.col("_metadata.file_size").alias("file_size"))
            .groupBy("file_name")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.max("file_size").alias("file_size")))


def read_json_documents(spark: SparkSession, path: str,
                        schema: str | None = None) -> DataFrame:
    """Document-store style collection exported as JSON lines.

    Without a schema Spark infers a nested one (a sampling pass); give a
    schema in production to skip that pass."""
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    return reader.json(normalize_path(path))
