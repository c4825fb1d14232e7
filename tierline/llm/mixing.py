"""Mixing sources to target weights (DataFrame operations only).

Every row gets a hash-random key (MD5 of seed and id).  Within a source the
rows are ordered by (key, id, size); the prefix sum of their sizes along that
order is cut at the source's exact budget.  The prefix sums are distributed:

* the first three hex digits of the key split a source into 4096 ranges of
  random, hence even, size - a source holding a third of all rows is 4096
  pieces like any other;
* sizes are summed per (source, range) with map-side combine, and a window over
  at most 4096 rows per source turns them into offsets;
* only the single range that contains a source's cut is ordered row by row;
  every other row is taken or left by comparing its range with the cut's.

So no text and no full table is ever sorted or shuffled.  Targets follow from a
closed form of capped sharing: with r = cap / weight ascending, the common level
is the largest of (total - caps so far) / (weights left), and a source gets
min(level * weight, cap).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierline.llm.frames import inner_name, shielded, stash, unshielded

#: Fixed values of the mix: weights in turn over the sources, share, repeat cap.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: Hex digits of the key that name a range (16 ** 3 ranges per source).
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets per source from rows (source, source_size): one row per source.

    Sources are ranked by code point, null last, and take ``weights`` in turn.
    All targets add up to ``share`` of all sizes; none exceeds ``max_epochs``
    times its source's size and the excess is reshared by weight.  A source of
    size 0 gets target 0.  The windows here see one row per source.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(rank) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    fill = Window.orderBy("__r", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = sizes.withColumn("__w", weight).withColumn("__cap", cap) \
        .withColumn("__r", F.col("__cap") / F.col("__w"))
    level = (F.sum("__cap").over(whole) / float(max_epochs) * share
             - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) \
        / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    filled = ranked.withColumn("__level", level)
    return filled.withColumn("__top", F.max("__level").over(whole)) \
        .select("source", "source_size",
                F.least(F.col("__top") * F.col("__w"), F.col("__cap")).alias("target"))


def mix_sources(docs: DataFrame, size: str | Column, id_col: str = "doc_id",
                source_col: str = "source", seed: str = "mix", weights=WEIGHTS,
                share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """All rows of ``docs`` plus ``size``, ``source_size``, ``target``, ``taken``.

    ``size`` is a column of sizes (its name, or an expression over ``docs``);
    null counts 0.  ``taken`` is how much of the row the mix uses: whole epochs
    of its source plus its part of the last one.  The row at a source's cut is
    taken in part, so taken sizes add up to floor(target).  No row exceeds
    ``max_epochs`` times its size, and reruns agree.

    Null source: a source of its own, ranked last.  Null id: keyed as an empty
    string.  Equal (id, size) rows are interchangeable: each is counted, and at
    the cut the rows of the tie are taken one after another.  Size 0 takes 0.
    Empty input: empty output.  Input columns named like an added one give way.
    """
    size_expr = F.col(size) if isinstance(size, str) else size
    with_size = docs.withColumn("__mix_size_in", F.coalesce(size_expr.cast("long"), F.lit(0)))
    base, names, _ = shielded(with_size)
    n_size = f"in_{len(names) - 1}"
    n_id, n_src = inner_name(names, id_col), inner_name(names, source_col)
    names = names[:-1]
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(n_id).cast("string"), F.lit(""))))
    rows = base.withColumnRenamed(n_size, "size").withColumn("key", key) \
        .withColumn("range", F.conv(F.substring("key", 1, RANGE_DIGITS), 16, 10).cast("int"))

    per_range = stash(rows.groupBy(F.col(n_src).alias("source"), "range")
                      .agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(per_range.groupBy("source").agg(F.sum("range_size").alias("source_size")),
                             weights, share, max_epochs)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs) \
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    along = Window.partitionBy("source").orderBy("range")
    offsets = per_range.withColumn("offset", F.sum("range_size").over(along) - F.col("range_size"))
    # the cut lies in the last range that starts at or before the rest and has anything to take
    cut = offsets.alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))) \
        .filter((F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("range_size"))) \
        .select(F.col("p.source").alias("cut_source"), F.col("range").alias("cut_range"),
                F.col("offset").alias("cut_offset"))
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left") \
        .select("source", "source_size", "target", "epochs", "rest", "cut_range", "cut_offset")
    plan = stash(plan, "mix-plan")  # one row per source: broadcast by its measured size, if small

    decided = rows.join(plan, F.col(n_src).eqNullSafe(F.col("source"))).drop("source")
    far = decided.filter(F.col("cut_range").isNull() | (F.col("range") != F.col("cut_range"))) \
        .withColumn("taken", F.col("size") * (F.col("epochs") + F.when(F.col("range") < F.col("cut_range"), 1)
                                              .otherwise(0)))
    order = Window.partitionBy(n_src, "range").orderBy("key", n_id, "size") \
        .rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("rest") - F.col("cut_offset") - (F.sum("size").over(order) - F.col("size"))
    near = decided.filter(F.col("range") == F.col("cut_range")) \
        .withColumn("taken", F.col("size") * F.col("epochs")
                    + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), room)))
    return unshielded(far.unionByName(near), names, ["size", "source_size", "target", "taken"])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
             [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
      FROM s),
l AS (SELECT *, (sum(cap) OVER () / 2.0::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / (sum(weight) OVER ()
          - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
      FROM w),
t AS (SELECT source, source_size, least(max(level) OVER () * weight, cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs,
             CAST(floor(p.target) AS BIGINT) - p.epochs * p.source_size AS rest,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS ahead
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       size * epochs + greatest(CAST(0 AS BIGINT), least(size, rest - ahead)) AS taken
FROM o
"""


def mix_documents(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document with its size and what the mix takes of it."""
    from tierline.llm.frames import word_count

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") \
        .select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = stash(docs, "mix-sizes")  # words are counted once; the passes after it read three columns
    return mix_sources(sized, "size").select("doc_id", "size", "source_size", "target", "taken")
