"""Ranked lexical search over all documents by bag deduplication.

A score depends on a document only through ``m`` (from its length) and the counts of
the items' terms.  So every document is restricted to the items' vocabulary, and
documents of equal count vector and ``m`` form a class, grouped under a hash that is
then verified to name one vector each.  Classes are scored once; the ten best classes
of an item (by score, then smallest doc_id) are expanded to their members by ascending
doc_id, of which ten a class are enough.

Items are taken in blocks of bounded size; a block's vocabulary and weights go to all
tasks, and within a task a matrix of classes by items is filled from inverted lists of
the items.  No document text is shuffled; of the vectors, one per class and task.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from tierline.llm.frames import stash

#: Fixed values of the score.
TOP, FLAT, SLOPE, SCALE = 10, 25, 75, 1_000_000_000
#: Bytes of items per block; classes scored at once; candidates kept per item before a cut.
BLOCK_BYTES, CLASS_ROWS, KEEP = 4_000_000, 256, 200
#: Bytes of terms after lower-casing A-Z; all others divide.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))
_NO_ID = (1 << 63) - 1


def terms_of(raw: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text, A-Z lower-cased."""
    return raw.translate(_TERM_BYTES).split() if raw else []


def restricted_bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per row (doc_id, text): doc_id, number ``n`` of its terms, and ``bag``: pairs
    (term, count) of the vocabulary, ascending, as 32-bit numbers."""
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def restrict(batches):
        number = told.value.get
        for batch in batches:
            texts, lengths, bags = batch.column(1), [], []
            for k in range(batch.num_rows):
                terms = terms_of(texts[k].as_py())
                counts = Counter(map(number, terms))
                counts.pop(None, None)
                lengths.append(len(terms))
                bags.append(np.array(sorted(counts.items()), dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(restrict, f"doc_id {kind}, n long, bag binary")


def _pairs(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of all entries of some bags."""
    flat = np.frombuffer(b"".join(bags), dtype="<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags]), flat[:, 0], flat[:, 1]


def _document_frequencies(classes: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term, from classes and their numbers of members."""
    def count(batches):
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            row, term, _ = _pairs(batch.column(0).to_pylist())
            np.add.at(held, term, batch.column(1).to_numpy()[row])
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], names=["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    for r in classes.select("bag", "members").mapInArrow(count, "term long, df long") \
            .groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _best_classes(classes: DataFrame, lists: tuple[np.ndarray, np.ndarray, np.ndarray], n_items: int, top: int) -> DataFrame:
    """(item, score, least, class) of each task's best classes per item."""
    told = classes.sparkSession.sparkContext.broadcast(lists)

    def score(batches):
        start, item, weight = told.value
        best: list[list[tuple]] = [[] for _ in range(n_items)]
        bar = np.ones(n_items, dtype=np.int64)
        for batch in batches:
            bags, m = batch.column("bag").to_pylist(), batch.column("m").to_numpy()
            least, name = batch.column("least").to_numpy(), batch.column("class").to_numpy()
            for at in range(0, len(bags), CLASS_ROWS):
                row, term, count = _pairs(bags[at:at + CLASS_ROWS])
                gain = SCALE * count // (1000 * count + 8 * m[at + row])
                k = start[term + 1] - start[term]
                entry = np.repeat(start[term] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
                total = np.zeros((min(CLASS_ROWS, len(bags) - at), n_items), dtype=np.int64)
                np.add.at(total.reshape(-1), np.repeat(row, k) * n_items + item[entry], np.repeat(gain, k) * weight[entry])
                for r, i in zip(*map(np.ndarray.tolist, np.nonzero(total >= bar))):
                    best[i].append((-int(total[r, i]), int(least[at + r]), int(name[at + r])))
                    if len(best[i]) >= KEEP:
                        best[i] = sorted(best[i])[:top]
                        bar[i] = max(1, -best[i][-1][0])
        rows = [(i, -s, f, c) for i, found in enumerate(best) for s, f, c in sorted(found)[:top]]
        for at in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at:at + 100_000])],
                                             names=["item", "score", "least", "class"])

    return classes.select("bag", "m", "least", "class").mapInArrow(score, "item long, score long, least long, class long")


def _search_block(docs: DataFrame, items: list[list[bytes]], top: int) -> DataFrame:
    """(item, rank, doc_id, score) for some items, given by their terms."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    for terms in items:
        for t in terms:
            vocabulary.setdefault(t, len(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()
    bags = stash(restricted_bags(docs, vocabulary), "bags")
    whole = bags.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("l")).first()
    if not whole["n"]:
        return spark.createDataFrame([], f"item long, rank int, doc_id {kind}, score long")
    wide = F.lit(SLOPE).cast("decimal(38,0)") * F.col("n") * F.lit(whole["n"]).cast("decimal(19,0)")
    of_m = (F.lit(FLAT) + F.expr("__wide div __l")).cast("long")
    held = bags.filter(F.octet_length("bag") > 0).withColumn("__wide", wide.cast("decimal(38,0)")) \
        .withColumn("__l", F.lit(whole["l"]).cast("decimal(19,0)")).withColumn("m", of_m)
    seed = 0
    while True:                                            # a hash that names two classes is chosen anew
        named = held.withColumn("class", F.xxhash64(F.lit(seed), "m", "bag")).select("class", "m", "bag", "doc_id")
        classes = stash(named.groupBy("class", "m", "bag").agg(
            F.count("*").alias("members"), F.coalesce(F.min("doc_id").cast("long"), F.lit(_NO_ID)).alias("least")), "classes")
        if classes.groupBy("class").count().filter("count > 1").isEmpty():
            break
        seed += 1

    df = _document_frequencies(classes, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * whole["n"] + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    entries = sorted((vocabulary[t], i, k) for i, terms in enumerate(items) for t, k in Counter(terms).items())
    term, item, times = (np.array(c, dtype=np.int64) for c in zip(*entries))
    start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    found = _best_classes(classes, (start, item, weight[term] * times), len(items), top)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "least", "class")
    winners = stash(found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top)
                    .select("item", "score", "class"), "winners")
    # at most ``top`` classes an item, 8 bytes each: sent to all tasks
    members = named.select("class", "doc_id").join(F.broadcast(winners.select("class").distinct()), "class", "left_semi")
    within = Window.partitionBy("class").orderBy(F.col("doc_id").asc_nulls_last())
    members = members.withColumn("k", F.row_number().over(within)).filter(F.col("k") <= top).drop("k")
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return winners.join(members, "class").withColumn("rank", F.row_number().over(ranked)) \
        .filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """Per row of ``items`` its ``top`` best documents: item_id, rank, doc_id, score.

    doc_id is a whole number.  Equal scores rank by ascending doc_id, null ids last.
    Rows with repeated or null ids are documents of their own and may each be ranked;
    so are repeated items.  Texts that are null or without terms match nothing; an item
    without a match gives no row.  Empty tables: empty output.  Only the named columns
    are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    raw = F.coalesce(F.col(item_text_col).cast("binary"), F.lit("").cast("binary"))
    asked = stash(items.select(F.col(item_col).alias("item_id"), raw.alias("raw")), "items")
    size = asked.agg(F.sum(F.octet_length("raw") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", asked.schema["item_id"].dataType)])
    out = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)) == b).collect()
        listed = [(r["item_id"], terms_of(bytes(r["raw"]))) for r in part]
        listed = [x for x in listed if x[1]]
        if not listed:
            continue
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(listed)], schema)
        got = _search_block(rows, [t for _, t in listed], top).join(names, "item") \
            .select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    if out is None:
        kind = asked.schema["item_id"].dataType.simpleString(), rows.schema["doc_id"].dataType.simpleString()
        out = spark.createDataFrame([], f"item_id {kind[0]}, rank int, doc_id {kind[1]}, score long")
    return out


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d),
i AS (SELECT row_number() OVER () AS iid, item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM benchmark),
q AS (SELECT iid, item_id, term, count(*) AS times FROM (SELECT iid, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, s.n),
m AS (SELECT rid, doc_id, 25 + (75 * CAST(len(terms) AS BIGINT) * s.n) // s.l AS m FROM d, s WHERE len(terms) > 0),
c AS (SELECT iid, item_id, tf.rid, m.doc_id,
             CAST(sum(times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
      FROM q JOIN tf ON q.term = tf.term JOIN w ON w.term = q.term JOIN m ON m.rid = tf.rid GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def search_benchmark(spark, sf_dir: str) -> DataFrame:
    """Contract query: every benchmark item against all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
