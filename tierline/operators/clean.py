"""Bronze -> silver: user SQL, quality rules, dedup, de-identification."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TRAILING_SEMI = re.compile(r";\s*$")


def check_query(spark: SparkSession, sql: str) -> str:
    """Accept exactly one read-only query (SELECT or WITH ... SELECT).

    The text is analyzed wrapped as a subquery: anything that is not a single
    query (DROP, INSERT, CREATE, a second statement, a bracket escape) fails
    to parse there, and nothing has run yet because ``spark.sql`` executes
    commands eagerly only on the un-wrapped text.  Returns the cleaned text.
    """
    text = _TRAILING_SEMI.sub("", sql.strip())
    spark.sql(f"SELECT * FROM (\n{text}\n) AS checked_query").schema  # analysis only
    return text


def transform_sql(spark: SparkSession, sql: str | Sequence[str],
                  views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run user SQL over named frames.

    ``sql`` may be a list of queries: each but the last can be referred to by
    later ones as ``step_<i>``; the last is the result.  Every query passes
    :func:`check_query` first.  The names exist as temp views only while the
    queries are analyzed; views of the caller with these names are put back."""
    stmts = [sql] if isinstance(sql, str) else list(sql)
    with _named(spark) as name:
        for n, df in (views or {}).items():
            name(n, df)
        out = None
        for i, s in enumerate(stmts):
            out = spark.sql(check_query(spark, s))
            if i < len(stmts) - 1:
                name(f"step_{i}", out)
        return out


@contextmanager
def _named(spark: SparkSession):
    """Temp views for the time of a block; hidden ones come back afterwards."""
    before: dict[str, DataFrame | None] = {}

    def name(n: str, df: DataFrame) -> None:
        if n not in before:
            known = any(x.isTemporary and x.name == n.lower() for x in spark.catalog.listTables())
            before[n] = spark.table(n) if known else None
        df.createOrReplaceTempView(n)

    try:
        yield name
    finally:
        for n, old in before.items():
            if old is None:
                spark.catalog.dropTempView(n)
            else:
                old.createOrReplaceTempView(n)


def standardize(df: DataFrame, upper_trim: Sequence[str] = (),
                lower_trim: Sequence[str] = ()) -> DataFrame:
    """Upper-case + trim identifiers, lower-case + trim status-like text."""
    cols = {c: F.upper(F.trim(F.col(c))) for c in upper_trim}
    cols.update({c: F.lower(F.trim(F.col(c))) for c in lower_trim})
    return df.withColumns(cols)


def quality_flags(df: DataFrame, rules: Mapping[str, Column],
                  flag_col: str = "quality_flag",
                  failed_col: str = "failed_rules") -> DataFrame:
    """Tag rows VALID/INVALID; rows are kept, never dropped.

    ``rules`` maps rule name -> condition that is TRUE when the row breaks the
    rule (NULL counts as passing).  ``failed_rules`` lists broken rule names
    in rule order."""
    names = list(rules)
    # array_except against [NULL] drops the passed rules and keeps order;
    # unlike a lambda filter it stays inside whole-stage codegen
    failed = F.array_except(
        F.array(*[F.when(F.coalesce(rules[n], F.lit(False)), F.lit(n)) for n in names]),
        F.array(F.lit(None).cast("string")))
    return (df.withColumn(failed_col, failed)
              .withColumn(flag_col, F.when(F.size(F.col(failed_col)) == 0, F.lit("VALID"))
                          .otherwise(F.lit("INVALID"))))


def quality_report(bronze: DataFrame, rules: Mapping[str, Column],
                   required: Column) -> DataFrame:
    """Per-rule failed/passed counts plus kept/removed totals, in one scan.

    ``required`` is TRUE for rows usable at all (the others are removed);
    rule counts are over kept rows.  One global aggregate = one partial
    aggregate per task and a single tiny final merge."""
    kept = F.coalesce(required, F.lit(False))
    aggs = [F.count(F.lit(1)).alias("rows_in"),
            F.count_if(kept).alias("rows_kept"),
            F.count_if(~kept).alias("rows_removed")]
    for n, cond in rules.items():
        aggs.append(F.count_if(kept & F.coalesce(cond, F.lit(False))).alias(f"{n}__failed"))
    wide = bronze.agg(*aggs)
    # one row per rule: (rule, failed, passed), plus the totals
    stack = ", ".join(f"'{n}', `{n}__failed`" for n in rules)
    return wide.selectExpr("rows_in", "rows_kept", "rows_removed",
                           f"stack({len(rules)}, {stack}) AS (rule, failed)") \
               .withColumn("passed", F.col("rows_kept") - F.col("failed"))


def dedup_exact(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Exact duplicate removal (hash aggregate with map-side combine)."""
    return df.dropDuplicates(list(subset) if subset else None)


def dedup_latest(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep one row per key: the greatest by ``order_by``, then by every other
    column (so ties are broken deterministically).

    Implemented as ``max(struct(order..., rest...))`` grouped by key, which is
    a partial aggregate: a hot key collapses to one row per task before the
    shuffle instead of being sorted whole in one task as a window would."""
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    packed = F.struct(*[F.col(c) for c in list(order_by) + rest]).alias("_best")
    best = df.groupBy(*keys).agg(F.max(packed).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order_by + rest]) \
               .select(*df.columns)


# Redaction patterns and replacement tokens.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
EMAIL_TOKEN = "[EMAIL]"
PHONE_TOKEN = "[PHONE]"


def deidentify(df: DataFrame, hash_cols: Sequence[str] = (),
               redact_cols: Sequence[str] = (), salt: str = "") -> DataFrame:
    """Replace identifying columns by SHA-256 and mask e-mails / phone
    numbers inside free text (whole texts, JVM regex, no Python)."""
    cols = {c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in hash_cols}
    for c in redact_cols:
        masked = F.regexp_replace(F.col(c), EMAIL_PATTERN, EMAIL_TOKEN)
        cols[c] = F.regexp_replace(masked, PHONE_PATTERN, PHONE_TOKEN)
    return df.withColumns(cols)


def add_audit_columns(df: DataFrame, run_id: str, rule_version: str,
                      processed_at: str) -> DataFrame:
    """Stamp rows with the processing time, the rule version and the run id.

    ``processed_at`` is passed in (never ``current_timestamp``) so reruns are
    reproducible."""
    return df.withColumns({
        "processed_at": F.lit(processed_at).cast("timestamp_ntz"),
        "rule_version": F.lit(rule_version),
        "ingest_run_id": F.lit(run_id),
    })
