"""Source divergence audit: how far the sources of a language differ in their words.

Frequencies come from single-pass in-memory indexing:

* each task gathers block postings, (term, lang, source) with documents and
  occurrences, until ``BLOCK_POSTINGS`` of them are in memory, then spills them as a
  term-sorted run and goes on with an empty block;
* runs are dealt to shards by a hash of (term, lang); within a shard Spark's external
  sorter merges the runs (a heap of sorted spills), and one pass over the merged rows
  folds equal keys into frequencies.  A shard holds all sources of its terms, so it can
  decide alone which terms a language keeps.

The distance of two sources is a sum over all kept terms, most of which neither has.
It starts from the distance of the two smoothing floors times the number of terms;
what each source's own terms change follows from its histogram of counts, and terms
that two sources share are corrected in one stream over the postings, whose sums
leave a task as one row per pair of sources.

All arithmetic is exact in 64 bits: the scale is divided in three steps of a thousand.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tierline.llm.frames import stash

#: Postings (term, lang, source) that a task holds before it spills a run.
BLOCK_POSTINGS = 500_000
#: Fixed values of the audit: documents a kept term is in, smoothing, scale, terms reported.
MIN_DOCS, SMOOTH, TOP_TERMS = 30, 5, 50
_THOUSAND = 1000                   # the scale is its third power
#: Bytes of terms after lower-casing A-Z; all others divide.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DOC = 1 << 44                     # a posting in a block: documents * _DOC + occurrences
_RUN = "term binary, lang string, source string, docs long, n long"
_KEPT = "term binary, lang string, sources array<string>, counts array<long>, whole long"


def term_runs(docs: DataFrame) -> DataFrame:
    """Runs of block postings of rows (lang, source, text); each group also gives a row
    with an empty term, so that groups without terms are known."""
    def index(batches):
        block: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2)
            for k, group in enumerate(zip(langs, sources)):
                postings = block.get(group)
                if postings is None:
                    postings = block[group] = {b"": 0}
                before = len(postings)
                raw = texts[k].as_py()
                if raw:
                    get = postings.get
                    for term, n in Counter(raw.translate(_TERM_BYTES).split()).items():
                        postings[term] = get(term, 0) + n + _DOC
                size += len(postings) - before
                if size >= BLOCK_POSTINGS:
                    yield from _spilled(block)
                    block, size = {}, 0
        yield from _spilled(block)

    return docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(index, _RUN)


def _spilled(block: dict):
    """A block as a run, sorted by term, language and source."""
    run = sorted((term, lang, source, v) for (lang, source), postings in block.items() for term, v in postings.items())
    for at in range(0, len(run), 50_000):
        term, lang, source, value = zip(*run[at:at + 50_000])
        value = np.array(value, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(term, pa.binary()), pa.array(lang, pa.string()), pa.array(source, pa.string()),
             pa.array(value // _DOC), pa.array(value % _DOC)], names=["term", "lang", "source", "docs", "n"])


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Rows at which one of the columns differs from the row before (the first is one)."""
    n = table.num_rows
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for c in columns:
        col = table.column(c).combine_chunks()
        out[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out)


def _summed(table: pa.Table) -> pa.Table:
    """One row per (term, lang, source) of a sorted table."""
    if not table.num_rows:
        return table
    first = _changes(table, ["term", "lang", "source"])
    sums = {c: pa.array(np.add.reduceat(table.column(c).to_numpy(), first)) for c in ("docs", "n")}
    head = table.take(pa.array(first))
    return pa.table([head.column("term").combine_chunks(), head.column("lang").combine_chunks(),
                     head.column("source").combine_chunks(), sums["docs"], sums["n"]], names=table.column_names)


def _posted(table: pa.Table, min_docs: int):
    """Postings of the kept terms of complete (term, lang) groups: a row each."""
    if not table.num_rows:
        return
    first = _changes(table, ["term", "lang"])
    ends = np.append(first[1:], table.num_rows)
    marker = pc.equal(table.column("term").combine_chunks().take(pa.array(first)), pa.scalar(b"", pa.binary())) \
        .to_numpy(zero_copy_only=False)
    kept = (np.add.reduceat(table.column("docs").to_numpy(), first) >= min_docs) | marker
    whole = np.add.reduceat(table.column("n").to_numpy(), first)
    rows = np.repeat(kept, ends - first)
    offsets = pa.array(np.concatenate(([0], np.cumsum((ends - first)[kept]))), pa.int32())
    part = table.filter(pa.array(rows))
    head = table.take(pa.array(first[kept]))
    yield pa.RecordBatch.from_arrays(
        [head.column("term").combine_chunks(), head.column("lang").combine_chunks(),
         pa.ListArray.from_arrays(offsets, part.column("source").combine_chunks()),
         pa.ListArray.from_arrays(offsets, part.column("n").combine_chunks()), pa.array(whole[kept])],
        names=["term", "lang", "sources", "counts", "whole"])


def kept_postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per (term, lang) of a kept term: its ``sources`` with their ``counts``, and the
    ``whole`` count; per lang a row of the empty term with all its sources."""
    def fold(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = _summed(pa.concat_tables([held, table]) if held is not None else table)
            if not table.num_rows:
                continue
            cut = int(_changes(table, ["term", "lang"])[-1])
            yield from _posted(table.slice(0, cut), min_docs)
            held = table.slice(cut)                    # the last group may go on: a row per source
        if held is not None:
            yield from _posted(held, min_docs)

    merged = term_runs(docs).repartition("term", "lang").sortWithinPartitions("term", "lang", "source")
    return merged.mapInArrow(fold, _KEPT)


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 (count + 5) / (n + 5 v)) of three columns, exact; null if nothing is kept."""
    below = f"nullif({n} + {SMOOTH} * {v}, 0L)"
    rest, out = f"({count} + {SMOOTH})", "0L"
    for _ in range(3):
        out = f"({out} * {_THOUSAND} + {rest} * {_THOUSAND} div {below})"
        rest = f"({rest} * {_THOUSAND} % {below})"
    return F.expr(f"{out} + 1")


def shares(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same for arrays; ``below`` is n + 5 v."""
    rest, out = count + SMOOTH, np.zeros(len(count), dtype=np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * _THOUSAND, below)
        out = out * _THOUSAND + digit
    return out + 1


def _shared_corrections(kept: DataFrame, places: dict[str, dict[str, int]], below: dict[str, np.ndarray]) -> DataFrame:
    """(lang, i, j, value): what terms that two sources share add to the sum of the
    floors and of what each source's own terms change.  i < j number the sources."""
    told = kept.sparkSession.sparkContext.broadcast((places, below))

    def correct(batches):
        place, under = told.value
        sums: dict[str, Counter] = {}
        for batch in batches:
            by_lang: dict[str, list[int]] = {}
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(k)
            for lang, rows in by_lang.items():
                part = batch.take(pa.array(rows))
                number, b = place[lang], under[lang]
                floor = shares(np.zeros(len(b), dtype=np.int64), b)
                length = pc.list_value_length(part.column("sources")).to_numpy()
                source = np.array([number[s] for s in pc.list_flatten(part.column("sources")).to_pylist()], dtype=np.int64)
                p = shares(pc.list_flatten(part.column("counts")).to_numpy(), b[source])
                row = np.repeat(np.arange(len(rows)), length)
                held = sums.setdefault(lang, Counter())
                for step in range(1, int(length.max(initial=0))):
                    x = np.flatnonzero(row[step:] == row[:-step])
                    y = x + step
                    swap = source[x] > source[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    i, j = source[x], source[y]
                    value = np.abs(p[x] - p[y]) - np.abs(p[x] - floor[j]) - np.abs(p[y] - floor[i]) + np.abs(floor[i] - floor[j])
                    pair, at = np.unique(i * len(b) + j, return_inverse=True)
                    total = np.zeros(len(pair), dtype=np.int64)
                    np.add.at(total, at, value)
                    for key, v in zip(pair.tolist(), total.tolist()):
                        held[key] += v
                if len(held) > BLOCK_POSTINGS:
                    yield _pair_rows(lang, held, len(b))
                    sums[lang] = Counter()
        for lang, held in sums.items():
            yield _pair_rows(lang, held, len(under[lang]))

    return kept.filter(F.size("sources") > 1).select("lang", "sources", "counts") \
        .mapInArrow(correct, "lang string, i long, j long, value long")


def _pair_rows(lang: str, held: Counter, m: int) -> pa.RecordBatch:
    key = np.fromiter(held.keys(), dtype=np.int64, count=len(held))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(key), pa.string()), pa.array(key // m), pa.array(key % m),
         pa.array(np.fromiter(held.values(), dtype=np.int64, count=len(held)))], names=["lang", "i", "j", "value"])


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of the audit.

    Part ``pair``: per source of a language every other one with the distance of their
    kept terms' shares.  Part ``term``: per source its most overused kept terms, to rank
    ``top_terms``.  Null text, lang and source count as empty strings.  A language
    without kept terms has distances 0 and no terms; a language of one source has no
    pairs.  Repeated rows are documents of their own.  Equal values rank by the item's
    UTF-8 bytes.  Empty input: empty output.  Only the three named columns are read.

    The numbers of documents per group come to the driver: a row per (lang, source), of
    which the result holds all pairs.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    posted = stash(kept_postings(rows, min_docs), "postings")
    kept = posted.filter(F.octet_length("term") > 0)
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_n"))
    flat = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("s")) \
        .select("lang", F.col("s.sources").alias("source"), F.col("s.counts").alias("n"))
    histogram = stash(flat.groupBy("lang", "source", "n").agg(F.count("*").alias("k")), "count-histogram")
    known = posted.filter(F.octet_length("term") == 0).select("lang", F.explode("sources").alias("source")).distinct()
    zero = F.lit(0).cast("long")
    groups = known.join(histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("k")).alias("n")),
                        ["lang", "source"], "left").join(langs, "lang", "left") \
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "v", "lang_n")])
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stash(groups.withColumn("place", numbered.cast("long"))
                   .withColumn("floor", F.coalesce(share("0L", "n", "v"), zero)), "groups")

    of = {}
    for r in groups.select("lang", "source", "place", "n", "v").collect():
        of.setdefault(r["lang"], []).append((r["place"], r["source"], r["n"] + SMOOTH * r["v"]))
    places = {lang: {s: p for p, s, _ in g} for lang, g in of.items()}
    below = {lang: np.array([b for _, _, b in sorted(g)], dtype=np.int64) for lang, g in of.items()}

    side = lambda x: groups.select("lang", *[F.col(c).alias(f"{x}_{c}") for c in ("source", "place", "n", "v", "floor")])
    pairs = side("a").join(side("b"), "lang").filter("a_place <> b_place")
    base = pairs.select("lang", F.col("a_place").alias("i"), F.col("b_place").alias("j"),
                        (F.col("a_v") * F.abs(F.col("a_floor") - F.col("b_floor"))).alias("value"))
    counted = histogram.withColumnRenamed("n", "count").withColumnRenamed("source", "a_source")
    own = side("a").join(counted, ["lang", "a_source"]).withColumn("p", share("count", "a_n", "a_v")) \
        .join(side("b"), "lang").filter("a_place <> b_place") \
        .select("lang", F.col("a_place").alias("i"), F.col("b_place").alias("j"),
                (F.col("k") * (F.abs(F.col("p") - F.col("b_floor")) - F.abs(F.col("a_floor") - F.col("b_floor")))).alias("value"))
    turned = lambda df: df.unionByName(df.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    distance = base.unionByName(turned(own)).unionByName(turned(_shared_corrections(kept, places, below))) \
        .groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    named = distance.join(groups.select("lang", F.col("place").alias("i"), "source"), ["lang", "i"]) \
        .join(groups.select("lang", F.col("place").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair_part = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                             F.row_number().over(order).alias("rank"))

    used = kept.select("term", "lang", "whole", F.explode(F.arrays_zip("sources", "counts")).alias("s")) \
        .select("term", "lang", "whole", F.col("s.sources").alias("source"), F.col("s.counts").alias("count")) \
        .filter("count > 0").join(groups.select("lang", "source", "n", "v", "lang_n"), ["lang", "source"])
    more = share("count", "n", "v") - share("whole", "lang_n", "v")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    term_part = used.select("lang", "source", "term", more.alias("value")).filter("value > 0") \
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms) \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pair_part.unionByName(term_part)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gp AS (SELECT x.lang, source, term, n,
              1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY x.lang, source) + 5 * v.v) AS p
       FROM x JOIN v ON x.lang = v.lang),
lq AS (SELECT t.lang, t.term,
              1 + (1000000000::HUGEINT * (t.n + 5)) // (sum(t.n) OVER (PARTITION BY t.lang) + 5 * v.v) AS q
       FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) t JOIN v ON t.lang = v.lang),
pr AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(pa.p - pb.p)), 0) AS BIGINT) AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN gp pa ON pa.lang = a.lang AND pa.source = a.source
       LEFT JOIN gp pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term
       GROUP BY a.lang, a.source, b.source),
te AS (SELECT gp.lang, gp.source, gp.term AS item, CAST(gp.p - lq.q AS BIGINT) AS value
       FROM gp JOIN lq ON gp.lang = lq.lang AND gp.term = lq.term WHERE gp.n > 0 AND gp.p > lq.q),
al AS (SELECT *, 'pair' AS part FROM pr UNION ALL SELECT *, 'term' AS part FROM te),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM al)
SELECT lang, source, part, item, value, rank FROM rk WHERE part = 'pair' OR rank <= 50
"""


def source_divergence(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")
    return divergence(docs)
