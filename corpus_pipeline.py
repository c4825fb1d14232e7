"""From raw documents to token ids: five stages, each around one operator of tierline.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next stage's docs.  All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierline.llm.bpe_queue import encode_documents
from tierline.llm.credential_links import find_secrets, redacted
from tierline.llm.frames import SPACE_CLASS, stash, word_count
from tierline.llm.jaccard_join import keep_representatives
from tierline.llm.lang_unigram import UND, identify_language, vocabulary_path
from tierline.llm.mixing import mix_sources

#: A document is rejected below this posterior of its language.
MIN_LANGUAGE_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that cross to Python at once.  Whole texts are wide rows: with Spark's default of
#: 10,000 a batch holds tens of MB in the JVM and again in the worker.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or no language
    more likely than all others together."""
    _small_batches(spark)
    told = identify_language(docs, vocabulary_path(), keep=COLUMNS)
    return told.filter((F.col("lang_pred") != UND) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by Jaccard 0.8 on five-word shingles."""
    _small_batches(spark)
    return keep_representatives(docs.select(*COLUMNS), k=5, num=80, den=100)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by ``[kind]``; the documents stay."""
    _small_batches(spark)
    found = find_secrets(docs, keep=COLUMNS)
    clean = found.withColumn("text", redacted(F.col("text"), F.col("all_spans")))
    changed = F.size("all_spans") > 0
    return clean.select("doc_id", "text", "lang", "source", F.when(
        changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the sources to their target weights: a document appears once per epoch
    that takes it; the one at a source's cut appears with the words up to the cut."""
    mixed = mix_sources(docs.select(*COLUMNS), word_count(F.col("text"))).filter("taken > 0")
    parts = mixed.withColumn("whole", F.floor(F.col("taken") / F.col("size")).cast("int")) \
        .withColumn("words", (F.col("taken") % F.col("size")).cast("int"))
    copies = parts.withColumn("part", F.explode(F.sequence(
        F.lit(1), F.col("whole") + F.when(F.col("words") > 0, 1).otherwise(0))))
    pieces = F.split("text", SPACE_CLASS + "+", F.col("words") + 1 + F.when(
        F.col("text").rlike("^" + SPACE_CLASS), 1).otherwise(0))
    head = F.expr("substring(text, 1, length(text) - length(rest))")
    cut = copies.withColumn("is_cut", F.col("part") > F.col("whole")) \
        .withColumn("rest", F.when(F.col("is_cut"), F.element_at(pieces, -1))) \
        .withColumn("text", F.when(F.col("is_cut"), F.regexp_replace(head, SPACE_CLASS + "+$", "")).otherwise(F.col("text")))
    return cut.select("doc_id", "text", "lang", "source", F.when(
        F.col("is_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with a check that they decode to its bytes."""
    _small_batches(spark)
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                            keep=["doc_id", "source"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
    ("bpe", bpe),
]

#: Language ID, the join's hashes and BPE are not expressible in SQL; the stages are
#: tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
