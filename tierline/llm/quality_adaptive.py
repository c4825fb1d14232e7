"""Quality rules with adaptive thresholds (DataFrame operations only).

Rates of every document are counted once.  For each (lang, source) group and
each rate a quantile sketch is kept: a log-linear histogram whose bins hold the
integer rate to three significant digits (relative error under 1 %).  Such a
sketch is just rows (group, rate, bin, count), so it is built with map-side
combine, is exactly mergeable by adding counts, and does not depend on the order
of the rows.  Quartiles read from it give the group's fences; a document is kept
if it passes the fixed base rule and lies within the fences of its group.

A group of fewer than ``MIN_GROUP`` documents borrows the sketch merged over its
language, and a language that is smaller still the sketch merged over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierline.llm.frames import stash, words_of

#: Fixed values of the base rule.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
SYMBOLS = "[#*$%&|<>]"
#: Fences: quartile distance factor, least slack per rate, least group size.
SPREAD = 3
MIN_GROUP = 50
#: rate -> (least distance of the upper fence from the third quartile, same for
#: the lower fence from the first quartile or None).  Rates are per mille, word
#: length in hundredths of a character.
SLACK = {"symbol_rate": (100, None), "dup_line_rate": (300, None),
         "repeat_rate": (200, None), "word_length": (300, 200)}


def _repeat_words(words: Column) -> Column:
    """Words covered by a window of five words that the text has twice or more.

    Windows are hashed to 64 bits; a text without an equal pair of windows (one
    hash-set pass) is done.  Otherwise (window, place) pairs are sorted, places
    whose neighbour has the same window are kept in order, and each covers five
    words less what the next one covers: n log n in the length of the text.
    """
    k = WINDOW_WORDS
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (k - 1))
    gram = F.transform(starts, lambda i: F.xxhash64(*[words[i + (j - 1)] for j in range(k)]))

    def covered(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(p):
            return F.array_sort(F.transform(
                F.filter(F.transform(p, lambda x, i: F.struct(
                    x["i"].alias("i"),
                    (F.coalesce(x["g"] == F.get(p, i + 1)["g"], F.lit(False))
                     | F.coalesce(x["g"] == F.get(p, i - 1)["g"], F.lit(False))).alias("twice"))),
                    lambda x: x["twice"]),
                lambda x: x["i"]))

        def length(at):
            return F.aggregate(F.transform(at, lambda x, i: F.least(
                F.lit(k), F.coalesce(F.get(at, i + 1) - x, F.lit(k)))),
                F.lit(0).cast("long"), lambda a, x: a + x)

        # a one-element array binds a value to a name inside an expression
        return _let(pairs, lambda p: _let(places(p), length))

    def counted(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")) \
            .otherwise(covered(grams))

    return F.when(n < k + 1, F.lit(0).cast("long")).otherwise(_let(gram, counted))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Null text counts as empty.  Lines are split at ``\\n``; only lines with a
    word count, and a line equal to an earlier one is a duplicate.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumn("__words", words_of(F.col(text_col))) \
        .withColumn("__lines", lines) \
        .withColumn("n_words", F.size("__words").cast("long")) \
        .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long")) \
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long")) \
        .withColumn("n_lines", F.size("__lines").cast("long")) \
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")) \
        .withColumn("n_repeat_words", _repeat_words(F.col("__words"))) \
        .drop("__words", "__lines")


def rates(counts: DataFrame) -> DataFrame:
    """Integer rates of the counts; null where a text has no word."""
    per = lambda a, b, f: F.when(F.col("n_words") > 0, F.floor(F.col(a) * f / F.col(b)).cast("long"))
    return counts.withColumn("symbol_rate", per("n_symbols", "word_chars", 1000)) \
        .withColumn("dup_line_rate", per("n_dup_lines", "n_lines", 1000)) \
        .withColumn("repeat_rate", per("n_repeat_words", "n_words", 1000)) \
        .withColumn("word_length", per("word_chars", "n_words", 100))


def sketch(rated: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketches: rows (keys, rate, bin, n), one sketch per group and rate."""
    names = list(SLACK)
    long = rated.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(r).alias("rate"), F.col(r).alias("v")) for r in names])).alias("x")) \
        .select(*keys, "x.rate", "x.v").filter(F.col("v").isNotNull())
    unit = F.pow(F.lit(10), F.greatest(F.length(F.col("v").cast("string")) - 3, F.lit(0))).cast("long")
    return long.withColumn("bin", F.col("v") - F.col("v") % unit) \
        .groupBy(*keys, "rate", "bin").agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to coarser ``keys`` (counts of equal bins add up)."""
    return sketches.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, total, q1, q3): lowest bins holding 1/4 and 3/4 of the group."""
    along = Window.partitionBy(*keys, "rate").orderBy("bin")
    group = Window.partitionBy(*keys, "rate")
    ranked = sketches.withColumn("upto", F.sum("n").over(along)).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bin")))
    return ranked.groupBy(*keys, "rate").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))


def fences(rated: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) with ``lo_`` and ``hi_`` columns per rate."""
    fine = stash(sketch(rated.select(F.col(lang).alias("lang"), F.col(source).alias("source"), *SLACK),
                        ["lang", "source"]), "quality-sketch")
    by_group = quartiles(fine, ["lang", "source"])
    by_lang = quartiles(merge_sketches(fine, ["lang"]), ["lang"])
    overall = quartiles(merge_sketches(fine, []), [])
    g, a, o = by_group.alias("g"), by_lang.alias("l"), overall.alias("o")
    joined = g.join(a, F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.rate") == F.col("l.rate"))) \
        .join(o, F.col("g.rate") == F.col("o.rate"))
    pick = lambda q: F.when(F.col("g.total") >= MIN_GROUP, F.col(f"g.{q}")) \
        .when(F.col("l.total") >= MIN_GROUP, F.col(f"l.{q}")).otherwise(F.col(f"o.{q}"))
    picked = joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"),
                           F.col("g.rate").alias("rate"), pick("q1").alias("q1"), pick("q3").alias("q3"))
    spread = SPREAD * (F.col("q3") - F.col("q1"))
    cols = []
    for r, (up, down) in SLACK.items():
        cols.append(F.max(F.when(F.col("rate") == r, F.col("q3") + F.greatest(spread, F.lit(up)))).alias(f"hi_{r}"))
        if down is not None:
            cols.append(F.max(F.when(F.col("rate") == r, F.col("q1") - F.greatest(spread, F.lit(down)))).alias(f"lo_{r}"))
    return picked.groupBy("lang", "source").agg(*cols)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: id, counts, rates, ``base_failed``, ``within`` fences and ``kept``.

    Null or empty text: no words, base rule fails.  Null lang or source: groups
    of their own.  Repeated rows are judged each.  Empty input: empty output.
    Only the four named columns are read, so extra columns cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    rated = stash(rates(text_counts(rows)).drop("text"), "quality-rates")
    limits = stash(fences(rated), "quality-fences")  # one row per group: broadcast by measured size
    joined = rated.alias("d").join(
        limits.alias("f"), F.col("d.lang").eqNullSafe(F.col("f.lang"))
        & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    base_failed = (F.col("n_words") < MIN_WORDS) | \
        (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for r, (_, down) in SLACK.items():
        within = within & F.coalesce(F.col(r) <= F.col(f"hi_{r}"), F.lit(True))
        if down is not None:
            within = within & F.coalesce(F.col(r) >= F.col(f"lo_{r}"), F.lit(True))
    return joined.select("d.*", base_failed.alias("base_failed"), within.alias("within")) \
        .withColumn("kept", ~F.col("base_failed") & F.col("within"))


def quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    out = judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT rid, i, count(*) OVER five AS m, list(word) OVER five AS gram FROM w
      WINDOW five AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE m = 5) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + s) AS n FROM twice, range(0, 5) r(s) GROUP BY rid),
c AS (
  SELECT d.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(list_aggregate(list_concat([''], words), 'string_agg', '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON d.rid = rep.rid),
r AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 1000 // word_chars END AS symbol_rate,
             CASE WHEN n_words > 0 THEN n_dup_lines * 1000 // n_lines END AS dup_line_rate,
             CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words END AS repeat_rate,
             CASE WHEN n_words > 0 THEN word_chars * 100 // n_words END AS word_length
      FROM c),
long AS (SELECT lang, source, 'symbol_rate' AS rate, symbol_rate AS v FROM r UNION ALL
         SELECT lang, source, 'dup_line_rate', dup_line_rate FROM r UNION ALL
         SELECT lang, source, 'repeat_rate', repeat_rate FROM r UNION ALL
         SELECT lang, source, 'word_length', word_length FROM r),
sk AS (SELECT lang, source, rate,
              v - v % CAST(pow(10, greatest(length(CAST(v AS VARCHAR)) - 3, 0)) AS BIGINT) AS bin, count(*) AS n
       FROM long WHERE v IS NOT NULL GROUP BY ALL),
qg AS (SELECT lang, source, rate, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN bin END) AS q1,
              min(CASE WHEN upto * 4 >= total * 3 THEN bin END) AS q3
       FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bin) AS upto,
                    sum(n) OVER (PARTITION BY lang, source, rate) AS total FROM sk) GROUP BY lang, source, rate),
sl AS (SELECT lang, rate, bin, sum(n) AS n FROM sk GROUP BY ALL),
ql AS (SELECT lang, rate, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN bin END) AS q1,
              min(CASE WHEN upto * 4 >= total * 3 THEN bin END) AS q3
       FROM (SELECT *, sum(n) OVER (PARTITION BY lang, rate ORDER BY bin) AS upto,
                    sum(n) OVER (PARTITION BY lang, rate) AS total FROM sl) GROUP BY lang, rate),
so AS (SELECT rate, bin, sum(n) AS n FROM sk GROUP BY ALL),
qo AS (SELECT rate, min(CASE WHEN upto * 4 >= total THEN bin END) AS q1,
              min(CASE WHEN upto * 4 >= total * 3 THEN bin END) AS q3
       FROM (SELECT *, sum(n) OVER (PARTITION BY rate ORDER BY bin) AS upto,
                    sum(n) OVER (PARTITION BY rate) AS total FROM so) GROUP BY rate),
q AS (SELECT qg.lang, qg.source, qg.rate,
             CASE WHEN qg.total >= 50 THEN qg.q1 WHEN ql.total >= 50 THEN ql.q1 ELSE qo.q1 END AS q1,
             CASE WHEN qg.total >= 50 THEN qg.q3 WHEN ql.total >= 50 THEN ql.q3 ELSE qo.q3 END AS q3
      FROM qg JOIN ql ON qg.lang IS NOT DISTINCT FROM ql.lang AND qg.rate = ql.rate
      JOIN qo ON qg.rate = qo.rate),
f AS (SELECT lang, source,
             max(CASE WHEN rate = 'symbol_rate' THEN q3 + greatest(3 * (q3 - q1), 100) END) AS hi_s,
             max(CASE WHEN rate = 'dup_line_rate' THEN q3 + greatest(3 * (q3 - q1), 300) END) AS hi_d,
             max(CASE WHEN rate = 'repeat_rate' THEN q3 + greatest(3 * (q3 - q1), 200) END) AS hi_r,
             max(CASE WHEN rate = 'word_length' THEN q3 + greatest(3 * (q3 - q1), 300) END) AS hi_w,
             max(CASE WHEN rate = 'word_length' THEN q1 - greatest(3 * (q3 - q1), 200) END) AS lo_w
      FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND coalesce(symbol_rate <= hi_s, true) AND coalesce(dup_line_rate <= hi_d, true)
         AND coalesce(repeat_rate <= hi_r, true) AND coalesce(word_length <= hi_w, true)
         AND coalesce(word_length >= lo_w, true) AS kept
FROM r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""
