"""Sinks and materializations: Parquet paths and catalog tables.

Plain Parquet has no transactions, so replacing a table's contents is done
by writing a complete new directory and then pointing the catalog table at it
(``ALTER TABLE ... SET LOCATION``): readers see the old or the new version,
never a half-written one, and a failed write leaves the old data untouched.
The path being read is never overwritten in the same job.  Concurrent writers
to one table are not coordinated (last swap wins).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None,
                  dynamic_partitions: bool = False, compression: str = "snappy") -> None:
    """Parquet write (default overwrite, snappy).  With ``dynamic_partitions``
    an overwrite replaces only the partitions present in ``df``."""
    if mode not in ("overwrite", "append", "error", "errorifexists", "ignore"):
        raise ValueError(f"unsupported mode {mode}")
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if dynamic_partitions:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


@contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def ensure_namespace(spark: SparkSession, table: str, root: str | None = None) -> None:
    if "." not in table:
        return
    ns = table.rsplit(".", 1)[0]
    loc = f" LOCATION '{root.rstrip('/')}/{ns.replace('.', '_')}.db'" if root else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {ns}{loc}")


def write_table(spark: SparkSession, df: DataFrame, table: str, mode: str = "append",
                partition_by: Sequence[str] | None = None, location: str | None = None) -> None:
    """Append / create / overwrite-partitions / replace a catalog table.

    * missing table: create it, external at ``location`` (required then)
    * ``append``: add rows (columns matched by name)
    * ``overwrite``: replace only the partitions present in ``df`` (dynamic)
    * ``replace``: create-or-replace via a new directory + location swap

    An existing table keeps its partition columns; they are read from the
    catalog, and a different ``partition_by`` raises.
    """
    if not spark.catalog.tableExists(table):
        if not location:
            raise ValueError(f"a location is needed to create {table}")
        ensure_namespace(spark, table, location.rsplit("/", 1)[0])
        w = df.write.format("parquet").option("path", location)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.saveAsTable(table)
        return
    _known_partitions(spark, table, partition_by)
    cols = spark.table(table).columns
    if mode == "append":
        df.select(*cols).write.mode("append").insertInto(table)
    elif mode == "overwrite":
        with _conf(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            df.select(*cols).write.mode("overwrite").insertInto(table)
    elif mode == "replace":
        swap_in_version(spark, df, table)
    else:
        raise ValueError(f"unsupported mode {mode}")
    spark.catalog.refreshTable(table)


def _table_location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter(F.col("col_name") == "Location")
    return rows.first()["data_type"]


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    """The table's partition columns, from the catalog."""
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def _known_partitions(spark: SparkSession, table: str, asked: Sequence[str] | None) -> list[str]:
    parts = partition_columns(spark, table)
    if asked and list(asked) != parts:
        raise ValueError(f"{table} is partitioned by {parts}, not by {list(asked)}")
    return parts


#: Partitions named in one DDL statement.
_DDL_PARTITIONS = 500


def _drop_partitions(spark: SparkSession, table: str, specs: Sequence[str]) -> None:
    """Forget partitions, many per statement (external tables keep their files)."""
    for at in range(0, len(specs), _DDL_PARTITIONS):
        part = ", ".join(f"PARTITION ({x})" for x in specs[at:at + _DDL_PARTITIONS])
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {part}")


def _point_partitions(spark: SparkSession, table: str, located: Sequence[tuple[str, str]]) -> None:
    """Register partitions (spec, directory), many per statement."""
    _drop_partitions(spark, table, [spec for spec, _ in located])
    for at in range(0, len(located), _DDL_PARTITIONS):
        part = " ".join(f"PARTITION ({spec}) LOCATION {_text_literal(loc)}" for spec, loc in located[at:at + _DDL_PARTITIONS])
        spark.sql(f"ALTER TABLE {table} ADD {part}")


def _partition_dirs(files: DataFrame, parts: Sequence[str]) -> list[tuple[str, str]]:
    """(spec, directory) of every partition that ``files``, a scan of Parquet, reads:
    one row per partition, which is what the catalog holds, too.

    ``_metadata.file_path`` is a URI; decoded once it is the directory's own name, in
    which values stand escaped.  Specs take the values from there, spelled as Spark
    spells them (an empty string, like NULL, is the default partition)."""
    uris = files.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("d")).distinct()
    return [(_spec_of(d, parts), d) for d in (unquote(r["d"]) for r in uris.collect())]


def _spec_of(directory: str, parts: Sequence[str]) -> str:
    """The partition spec that a ``.../a=1/b=x`` directory (or its end) stands for."""
    pairs = [p.partition("=") for p in directory.rsplit("/", len(parts))[-len(parts):]]
    return ", ".join(f"`{c}`=" + ("null" if v == "__HIVE_DEFAULT_PARTITION__" else _text_literal(unquote(v)))
                     for c, (_, _, v) in zip(parts, pairs))


def _text_literal(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _known_specs(spark: SparkSession, table: str) -> list[str]:
    """Specs of the partitions that the catalog knows (also of empty ones)."""
    parts = partition_columns(spark, table)
    return [_spec_of(r["partition"], parts) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]


def swap_in_version(spark: SparkSession, df: DataFrame, table: str) -> None:
    """Write ``df`` as a complete new version and point ``table`` at it; of a
    partitioned table, partitions that are no more are dropped and all others
    point into the new version.  If ``df`` has other columns or types, the table takes
    them: it is made anew over the new version, with the same partition columns."""
    parts = partition_columns(spark, table)
    old = spark.table(table).schema
    base = _table_location(spark, table).rstrip("/")
    new_loc = f"{base.rsplit('/', 1)[0]}/v-{uuid.uuid4().hex[:12]}"
    if gone := [c for c in parts if c not in df.columns]:
        raise ValueError(f"{table} is partitioned by {gone}, which the new rows lack")
    kinds = {f.name: _ddl_type(f.dataType) for f in df.schema.fields}
    if kinds != {f.name: _ddl_type(f.dataType) for f in old.fields}:
        write_parquet(df, new_loc, "overwrite", parts)
        spark.sql(f"DROP TABLE {table}")               # external: its files stay
        _create_over(spark, df, table, new_loc, parts)
    else:
        write_parquet(df.select(*old.names), new_loc, "overwrite", parts)
        if parts:
            known = _known_specs(spark, table)
            fresh = _partition_dirs(spark.read.schema(old).parquet(new_loc), parts)
            spark.sql(f"ALTER TABLE {table} SET LOCATION {_text_literal(new_loc)}")
            _drop_partitions(spark, table, known)
            _point_partitions(spark, table, fresh)
        else:
            spark.sql(f"ALTER TABLE {table} SET LOCATION {_text_literal(new_loc)}")
    spark.catalog.refreshTable(table)


def _ddl_type(t) -> str:
    """A type's DDL with quoted names, nullable throughout."""
    if isinstance(t, StructType):
        return "struct<" + ", ".join(f"{_quoted(f.name)}: {_ddl_type(f.dataType)}" for f in t.fields) + ">"
    if isinstance(t, ArrayType):
        return f"array<{_ddl_type(t.elementType)}>"
    if isinstance(t, MapType):
        return f"map<{_ddl_type(t.keyType)}, {_ddl_type(t.valueType)}>"
    return t.simpleString()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _create_over(spark: SparkSession, df: DataFrame, table: str, loc: str, parts: Sequence[str] | None) -> None:
    """A table of ``df``'s columns over the files at ``loc``."""
    pcl = f" PARTITIONED BY ({', '.join(map(_quoted, parts))})" if parts else ""
    cols = ", ".join(f"{_quoted(f.name)} {_ddl_type(f.dataType)}" for f in df.schema.fields)
    spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet{pcl} LOCATION {_text_literal(loc)}")
    if parts:
        _point_partitions(spark, table, _partition_dirs(spark.read.schema(df.schema).parquet(loc), parts))


def create_table_version(spark: SparkSession, df: DataFrame, table: str, root: str,
                           partition_by: Sequence[str] | None = None) -> None:
    ensure_namespace(spark, table, root)
    loc = f"{root.rstrip('/')}/{table.replace('.', '/')}/v-{uuid.uuid4().hex[:12]}"
    write_parquet(df, loc, "overwrite", partition_by)
    _create_over(spark, df, table, loc, partition_by)


def check_unique_keys(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when the source has two rows for one key (merge is ambiguous).

    One aggregate job; only the existence of a duplicate reaches the driver."""
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"merge source has duplicate keys on {list(keys)}")


def _anti(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    nk = new.select(*[F.col(k).alias(f"_nk_{k}") for k in keys])
    cond = None
    for k in keys:
        c = old[k].eqNullSafe(nk[f"_nk_{k}"])
        cond = c if cond is None else cond & c
    return old.join(nk, cond, "left_anti")


STRATEGIES = {"append", "merge", "delete_insert", "delete+insert"}


def materialize(spark: SparkSession, df: DataFrame, table: str, kind: str = "table",
                strategy: str = "append", unique_key: Sequence[str] | None = None,
                partition_by: Sequence[str] | None = None,
                root: str | None = None, view_sql: str | None = None) -> DataFrame:
    """Materialize a gold model: ``table`` | ``view`` | ``incremental``.

    incremental strategies: ``append``; ``merge`` on ``unique_key`` (source
    keys must be unique); ``delete_insert`` / ``delete+insert`` (source
    duplicates kept).  The first run creates the table below ``root`` (the
    gold layer's own folder, required then).  Later runs keep the table's
    partition columns, read from the catalog; a batch without rows changes nothing.
    A ``view`` given by its SQL (``view_sql``, over catalog tables or paths) is a view of
    the catalog; one given only as a DataFrame can live in the session alone.
    Returns the materialized relation read back from the catalog.
    """
    if kind == "view" and view_sql:
        ensure_namespace(spark, table, root)
        spark.sql(f"CREATE OR REPLACE VIEW {table} AS {view_sql}")
        return spark.table(table)
    if kind == "view":
        df.createOrReplaceTempView(table.replace(".", "_"))
        return spark.table(table.replace(".", "_"))
    if kind not in ("table", "incremental"):
        raise ValueError(f"unknown materialization {kind}")
    if kind == "incremental" and strategy not in STRATEGIES:
        raise ValueError(f"unknown incremental strategy {strategy}")
    if not spark.catalog.tableExists(table):
        if not root:
            raise ValueError(f"a root folder is needed to create {table}")
        create_table_version(spark, df, table, root, partition_by)
        return spark.table(table)
    parts = _known_partitions(spark, table, partition_by)
    current = spark.table(table)
    if kind == "table":
        swap_in_version(spark, df, table)
        return spark.table(table)
    if strategy == "append":
        df.select(*current.columns).write.mode("append").insertInto(table)
        spark.catalog.refreshTable(table)
        return spark.table(table)
    if not unique_key:
        raise ValueError(f"{strategy} needs unique_key")
    if strategy == "merge":
        check_unique_keys(df, unique_key)
    if parts and set(parts) <= set(unique_key):
        if merge_touched_partitions(spark, df, table, unique_key, parts):
            return spark.table(table)
    merged = _anti(current, df, unique_key).unionByName(df.select(*current.columns))
    swap_in_version(spark, merged, table)
    return spark.table(table)


def materialize_newest(spark: SparkSession, df: DataFrame, table: str, keys: Sequence[str], time_col: str,
                       root: str | None = None) -> DataFrame:
    """Merge rows into ``table`` keeping, per key, the row of the newest ``time_col``
    (NULL is oldest; of equal times, the batch's): an older range that is
    materialized again or late never replaces a newer row."""
    check_unique_keys(df, keys)
    if spark.catalog.tableExists(table):
        have = spark.table(table).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col(time_col).alias("_h_t"))
        same = F.lit(True)
        for k in keys:
            same = same & df[k].eqNullSafe(have[f"_h_{k}"])
        newer = F.col("_h_t") > F.coalesce(df[time_col], F.lit("0001-01-01").cast(df.schema[time_col].dataType))
        df = df.join(have, same & newer, "left_anti")
    return materialize(spark, df, table, "incremental", "merge", keys, root=root)


def observed_write(spark: SparkSession, read, transform, path: str, mode: str = "overwrite",
                   partition_by: Sequence[str] | None = None) -> dict:
    """Read -> transform -> write in one job, counting rows in and out with
    Observations (no extra count() passes over the data).

    ``read(session)`` builds the input in a child session (``newSession``:
    same SparkContext and cluster, separate SQL state).  Spark 4.1 keeps a
    non-serializable observation registry on the session once an
    Observation is used, which later breaks closures that capture the
    session (MLlib transforms); the child session keeps that state away
    from the caller's session."""
    child = spark.newSession()
    o_in, o_out = Observation("rows_in"), Observation("rows_out")
    src = read(child).observe(o_in, F.count(F.lit(1)).alias("rows_in"))
    out = transform(src).observe(o_out, F.count(F.lit(1)).alias("rows_out"))
    write_parquet(out, path, mode, partition_by)
    return {"rows_in": o_in.get["rows_in"], "rows_out": o_out.get["rows_out"]}


def merge_touched_partitions(spark: SparkSession, df: DataFrame, table: str,
                             keys: Sequence[str], partition_by: Sequence[str]) -> bool:
    """Keyed merge that rewrites only the partitions the batch touches.

    Valid when the partition columns are part of the key (a row never moves
    between partitions).  Old rows are read only from touched partitions: the
    batch's least and greatest partition values are scalar-subquery filters on
    the partition columns, which prune the scan at run time, and a LEFT SEMI
    join leaves out what lies between.  They are merged with the batch, written
    as a new version directory, and the touched partitions re-pointed in the
    catalog, many per statement.  Returns False (caller rewrites the table) when
    a partition value is NULL."""
    current = spark.table(table)
    touched = df.select(*partition_by).distinct()
    if touched.filter(" OR ".join(f"`{c}` IS NULL" for c in partition_by)).limit(1).count():
        return False
    old = touched_rows(current, df, partition_by)
    merged = _anti(old, df, keys).unionByName(df.select(*current.columns))
    replace_partitions(spark, merged, table, partition_by)
    return True


def replace_partitions(spark: SparkSession, df: DataFrame, table: str, partition_by: Sequence[str],
                       remove_old: bool = False) -> None:
    """Write ``df`` as new directories and point its partitions at them; all other
    partitions stay.  ``remove_old`` deletes the directories they stood in (only
    for tables without readers of older snapshots)."""
    base = _table_location(spark, table).rstrip("/")
    stage = f"{base.rsplit('/', 1)[0]}/v-{uuid.uuid4().hex[:12]}"
    write_parquet(df.select(*spark.table(table).columns), stage, "overwrite", partition_by)
    staged = spark.read.schema(spark.table(table).schema).parquet(stage)
    fresh = _partition_dirs(staged, partition_by)
    # of the table only the touched partitions' files are listed
    old = _partition_dirs(_touched_files(spark.table(table), staged, partition_by), partition_by) if remove_old and fresh else []
    _point_partitions(spark, table, fresh)
    spark.catalog.refreshTable(table)
    for _, d in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(d)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _touched_files(current: DataFrame, batch: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of ``current`` in the partitions of ``batch`` with their file's path."""
    named = current.select(*partition_by, F.col("_metadata.file_path").alias("path"))
    touched = touched_rows(named, batch, partition_by)
    return touched.select(F.struct(F.col("path").alias("file_path")).alias("_metadata"))


def touched_rows(current: DataFrame, batch: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of ``current`` in the partitions that ``batch`` has rows of."""
    old = current
    for c in partition_by:
        old = old.filter(F.col(c).between(batch.agg(F.min(c)).scalar(), batch.agg(F.max(c)).scalar()))
    return old.join(batch.select(*partition_by).distinct(), list(partition_by), "left_semi")


def apply_change_feed(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str],
                      sequence_col: str, op_col: str, delete_ops: Sequence[str] = ("D",)) -> DataFrame:
    """Apply a CDC feed (insert / update / delete rows with a sequence) to a
    snapshot: the newest change per key wins; a delete removes the key.

    The newest change per key is a ``max(struct(seq, ...))`` partial
    aggregate (a hot key is reduced before the shuffle); the snapshot is then
    anti-joined NULL-safely on the keys and the surviving upserts added.  A
    change without an op is an upsert."""
    data_cols = [c for c in changes.columns if c not in (sequence_col, op_col) and c not in keys]
    newest = (changes.groupBy(*keys)
              .agg(F.max(F.struct(F.col(sequence_col), F.col(op_col), *[F.col(c) for c in data_cols]))
                   .alias("_c"))
              .select(*keys, *[F.col(f"_c.{c}").alias(c) for c in [op_col, *data_cols]]))
    is_delete = F.coalesce(F.col(op_col).isin(*delete_ops), F.lit(False))
    upserts = newest.filter(~is_delete).drop(op_col)
    return _anti(snapshot, newest, keys).unionByName(upserts.select(*snapshot.columns))
