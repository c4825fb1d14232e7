"""Language ID by segmentation-marginalised unigrams.

The units are the pieces of a fixed public vocabulary.  Each language has one
probability per piece; a word's probability is the sum over all its segmentations
into pieces, computed by the forward algorithm, and a text's the product over its
words.  The prediction is the language of the largest posterior (equal priors).

Training is EM on Spark: texts are reduced to (lang, word, count) with partial
counts made in the tasks; piece counts start from all occurrences of a piece in
the words and are then replaced by expected counts from forward and backward
sums over all segmentations.  Only the piece counts reach the driver: vocabulary
size times number of languages, whatever the corpus.

Forward sums of many distinct words are computed together: one pass of an
automaton over them finds all arcs (piece occurrences), and the arcs that end at
one place of any word are one array operation.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tierline.llm.frames import held, stash

UND = "und"
EM_ROUNDS = 1
SMOOTH = 0.05              # added to each piece count
UNKNOWN = 1e-8             # probability, in every language, of a character outside the vocabulary
GAIN = np.exp(6.0)         # factor per character that keeps most words' sums near 1
LOW = 1e-250               # words with a sum below are summed in logarithms
LONG_WORD = 64             # longer words are summed one by one, in memory of their length at most
WORD_SUMS = 32_768         # words times languages summed together
CACHE_WORDS = 400_000      # cached words, fewer where they have many languages each
BLOCK_CHARS = 500_000
COUNT_WORDS = 200_000      # distinct words a task counts before it hands them on
START = "▁"           # the vocabulary's mark of a word start

_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    """Runs of letters in lower case."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    out = []
    for w in found:            # numerals that count as word characters divide a run
        out += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return out


class Pieces:
    """The vocabulary's pieces of letters, with or without the start mark."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (sp.id_to_piece(i) for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        own = [p for p in names if p.removeprefix(START).isalpha() or p == START]
        self.id = {p: i for i, p in enumerate(own)}
        self.longest = max(map(len, own))
        self.n = len(own)              # also the id of the unknown character
        self.length = np.array([*map(len, own), 1])
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in self.id.items():
            self.finder.add_word(p, i)
        self.finder.make_automaton()

    def arcs(self, words: list[str]):
        """Arrays (word, start, end, piece) of all piece occurrences, ordered by word
        and end, and word lengths (start mark included)."""
        text = "\n".join([START + w for w in words]) + "\n"       # no piece holds a line end
        lengths = np.array([len(w) + 1 for w in words])
        begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        found = np.fromiter(chain.from_iterable(self.finder.iter(text)), dtype=np.int64).reshape(-1, 2)
        stop, piece = found[:, 0] + 1, found[:, 1]
        alone = np.zeros(len(text), dtype=bool)                    # characters that are pieces themselves
        alone[stop[self.length[piece] == 1] - 1] = True
        alone[begin + lengths] = True                              # the line ends
        other = np.flatnonzero(~alone)
        if len(other):
            at = np.searchsorted(stop, other + 1, side="right")
            stop, piece = np.insert(stop, at, other + 1), np.insert(piece, at, self.n)
        word = np.repeat(np.arange(len(words)), lengths + 1)[stop - 1]
        end = stop - begin[word]
        return (word, end - self.length[piece], end, piece), lengths


def pieces(path: str) -> Pieces:
    """The worker's copy of the vocabulary."""
    return held(("pieces", path), lambda: Pieces(path))


def _by_place(place: np.ndarray):
    """(place, arcs there in word order) for each place, ascending."""
    order = np.argsort(place.astype(np.int16), kind="stable")
    at = np.flatnonzero(np.diff(place[order])) + 1
    return [(int(place[part[0]]), part) for part in np.split(order, at)]


def _sum_per_word(value: np.ndarray, word: np.ndarray):
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    return word[first], np.add.reduceat(value, first, axis=0)


def _forward(arcs, lengths, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums (words, places, columns) from arc weights (arcs, columns), and
    the least sum of each word."""
    w, i, j, _ = arcs
    alpha = np.zeros((len(lengths), int(lengths.max()) + 1, weight.shape[1]))
    alpha[:, 0] = 1.0
    least = np.ones(len(lengths))
    for end, part in _by_place(j):
        words, total = _sum_per_word(alpha[w[part], i[part]] * weight[part], w[part])
        alpha[words, end] = total
        least[words] = np.minimum(least[words], total.min(axis=1))
    return alpha, least


def _backward(arcs, lengths, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, i, j, _ = arcs
    beta = np.zeros((len(lengths), int(lengths.max()) + 1, weight.shape[1]))
    beta[np.arange(len(lengths)), lengths] = 1.0
    least = np.ones(len(lengths))
    for start, part in reversed(_by_place(i)):
        words, total = _sum_per_word(beta[w[part], j[part]] * weight[part], w[part])
        beta[words, start] = total
        least[words] = np.minimum(least[words], total.min(axis=1))
    return beta, least


def _log_sum_per_word(value: np.ndarray, word: np.ndarray):
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    top = np.maximum.reduceat(value, first, axis=0)
    spread = np.repeat(top, np.diff(np.append(first, len(word))), axis=0)
    return word[first], top + np.log(np.add.reduceat(np.exp(value - spread), first, axis=0))


def _log_forward(arcs, lengths, weight: np.ndarray) -> np.ndarray:
    """Logarithms of forward sums from those of arc weights: no length underflows."""
    w, i, j, _ = arcs
    alpha = np.full((len(lengths), int(lengths.max()) + 1, weight.shape[1]), -np.inf)
    alpha[:, 0] = 0.0
    for end, part in _by_place(j):
        words, total = _log_sum_per_word(alpha[w[part], i[part]] + weight[part], w[part])
        alpha[words, end] = total
    return alpha


def _log_backward(arcs, lengths, weight: np.ndarray) -> np.ndarray:
    w, i, j, _ = arcs
    beta = np.full((len(lengths), int(lengths.max()) + 1, weight.shape[1]), -np.inf)
    beta[np.arange(len(lengths)), lengths] = 0.0
    for start, part in reversed(_by_place(i)):
        words, total = _log_sum_per_word(beta[w[part], j[part]] + weight[part], w[part])
        beta[words, start] = total
    return beta


def boosted(prob: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Piece probabilities times GAIN per character."""
    return prob * (GAIN ** vocabulary.length)[:, None]


def word_log_probs(words: list[str], vocabulary: Pieces, prob: np.ndarray, boost: np.ndarray) -> np.ndarray:
    """log P(word | language), (words, languages), over all segmentations."""
    out = np.empty((len(words), prob.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
    step = max(64, WORD_SUMS // max(1, prob.shape[1]))
    for at in range(0, len(short), step):
        part = short[at:at + step]
        arcs, lengths = vocabulary.arcs([words[k] for k in part])
        alpha, least = _forward(arcs, lengths, boost[arcs[3]])
        part, ok = np.array(part), least > LOW
        total = alpha[np.arange(len(part)), lengths][ok]
        out[part[ok]] = np.log(total) - np.log(GAIN) * lengths[ok, None]
        if not ok.all():
            arcs, lengths = vocabulary.arcs([words[k] for k in part[~ok]])
            out[part[~ok]] = _log_forward(arcs, lengths, np.log(prob[arcs[3]]))[np.arange(len(lengths)), lengths]
    for k, word in enumerate(words):
        if len(word) > LONG_WORD:
            out[k] = _long_log_prob(START + word, vocabulary, prob)
    return out


def _long_log_prob(s: str, vocabulary: Pieces, prob: np.ndarray) -> np.ndarray:
    """Forward sum of one long word: a ring of the last places, rescaled at each."""
    size = vocabulary.longest + 1
    ring = np.zeros((size, prob.shape[1]))
    ring[0] = 1.0
    scale = np.zeros(prob.shape[1])
    for j in range(1, len(s) + 1):
        total = np.zeros(prob.shape[1])
        for i in range(max(0, j - vocabulary.longest), j):
            p = vocabulary.id.get(s[i:j])
            if p is None and i == j - 1:
                p = vocabulary.n
            if p is not None:
                total += ring[i % size] * prob[p]
        ring[j % size] = total
        top = ring.max(axis=0)
        ring /= top
        scale += np.log(top)
    return np.log(ring[len(s) % size]) + scale


def _long_occurrences(s: str, vocabulary: Pieces, held: np.ndarray, n: float) -> None:
    """Adds to ``held`` n for each occurrence of a piece in a long word."""
    found = (piece for _, piece in vocabulary.finder.iter(s))
    while len(part := np.fromiter(islice(found, BLOCK_CHARS), dtype=np.int64)):
        held += n * np.bincount(part, minlength=len(held))


def _long_expected(s: str, vocabulary: Pieces, log_prob: list[float], held: np.ndarray, n: float) -> None:
    """Adds to ``held`` n times the expected piece counts of one long word: forward
    and backward sums in logarithms, two numbers a place, arcs found anew."""
    size, longest, find = len(s), vocabulary.longest, vocabulary.id.get

    def arcs(j):
        """(start, piece) of the arcs that end at place j."""
        out = [(i, p) for i in range(max(0, j - longest), j) if (p := find(s[i:j])) is not None]
        return out if out and out[-1][0] == j - 1 else [*out, (j - 1, vocabulary.n)]

    alpha, beta = array("d", [-math.inf]) * (size + 1), array("d", [-math.inf]) * (size + 1)
    alpha[0] = beta[size] = 0.0
    for j in range(1, size + 1):
        terms = [alpha[i] + log_prob[p] for i, p in arcs(j)]
        top = max(terms)
        alpha[j] = top + math.log(sum(math.exp(x - top) for x in terms))
    for j in range(size, 0, -1):             # all arcs that start at j are in beta[j] by now
        for i, p in arcs(j):
            x = beta[j] + log_prob[p]
            held[p] += n * math.exp(alpha[i] + x - alpha[size])
            low, top = sorted((x, beta[i]))
            beta[i] = top + math.log1p(math.exp(low - top))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text); partial counts are made in the tasks."""
    def count(batches):
        held: Counter = Counter()
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if text:
                    held.update((lang, w) for w in words_in(text))
                if len(held) >= COUNT_WORDS:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    partial = docs.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pd.DataFrame:
    return pd.DataFrame([(a, w, n) for (a, w), n in held.items()], columns=["lang", "word", "n"])


def _piece_counts(counted: DataFrame, path: str, model: dict | None) -> pd.DataFrame:
    """Counts per (lang, piece): occurrences without a model, else expected counts."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def expect(batches):
        vocabulary, now = pieces(path), shared.value
        boost = boosted(now["prob"], vocabulary) if now is not None else None

        def shares(words, column):
            """Arcs of words and each arc's share in its word's segmentations."""
            arcs, lengths = vocabulary.arcs(words)
            w, i, j, p = arcs
            weight = boost[p, column][:, None]
            (alpha, a), (beta, b) = _forward(arcs, lengths, weight), _backward(arcs, lengths, weight)
            whole = alpha[np.arange(len(words)), lengths, 0]
            low = np.minimum(a, b) <= LOW
            whole[low] = 1.0                   # told below
            share = alpha[w, i, 0] * weight[:, 0] * beta[w, j, 0] / whole[w]
            if low.any():
                arcs, lengths = vocabulary.arcs([words[k] for k in np.flatnonzero(low)])
                v, i, j, q = arcs
                weight = np.log(now["prob"][q, column])[:, None]
                alpha, beta = _log_forward(arcs, lengths, weight), _log_backward(arcs, lengths, weight)
                whole = alpha[np.arange(len(lengths)), lengths, 0]
                share[low[w]] = np.exp(alpha[v, i, 0] + weight[:, 0] + beta[v, j, 0] - whole[v])
            return w, p, share

        for pdf in batches:
            for lang, g in pdf.groupby("lang", sort=False):
                held = np.zeros(vocabulary.n + 1)
                words, n = g["word"].tolist(), g["n"].to_numpy(dtype=np.float64)
                short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
                for at in range(0, len(short), 8192):
                    part = short[at:at + 8192]
                    if now is None:
                        (w, _, _, p), _ = vocabulary.arcs([words[k] for k in part])
                        share = 1.0
                    else:
                        w, p, share = shares([words[k] for k in part], now["langs"].index(lang))
                    held += np.bincount(p, weights=n[part][w] * share, minlength=vocabulary.n + 1)
                if len(short) < len(words):
                    log_prob = None if now is None else np.log(now["prob"][:, now["langs"].index(lang)]).tolist()
                    for word, times in zip(words, n):
                        if len(word) > LONG_WORD and now is None:
                            _long_occurrences(START + word, vocabulary, held, times)
                        elif len(word) > LONG_WORD:
                            _long_expected(START + word, vocabulary, log_prob, held, times)
                used = np.flatnonzero(held[:-1])
                yield pd.DataFrame({"lang": lang, "piece": used, "c": held[used]})

    return counted.mapInPandas(expect, "lang string, piece int, c double") \
        .groupBy("lang", "piece").agg(F.sum(F.col("c").cast("decimal(30,6)")).cast("double").alias("c")).toPandas()


def fit(labelled: DataFrame, path: str, rounds: int = EM_ROUNDS) -> dict:
    """Model {langs, prob} from rows (lang, text) with a non-null lang.

    Words of any length are learned from.  A language without any word is learned
    with equal piece probabilities.  Sums are decimal, so reruns give the same model.
    """
    rows = labelled.filter("lang IS NOT NULL")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return {"langs": [], "prob": None}
    counted = stash(count_words(rows), "lang-words")
    n = pieces(path).n
    model = None
    for _ in range(rounds + 1):
        counts = _piece_counts(counted, path, model)
        prob = np.full((n + 1, len(langs)), SMOOTH)
        prob[counts["piece"], counts["lang"].map(langs.index).to_numpy(dtype=int)] += counts["c"]
        prob /= prob[:-1].sum(axis=0)
        prob[-1] = UNKNOWN
        model = {"langs": langs, "prob": prob}
    return model


class Scorer:
    """Posterior of texts under a model, with a cache of word probabilities."""

    def __init__(self, model: dict, path: str):
        self.langs, self.prob = model["langs"], model["prob"]
        self.vocabulary = Pieces(path)
        self.boost = boosted(self.prob, self.vocabulary) if self.langs else None
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(self.langs)))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > min(CACHE_WORDS, 25 * CACHE_WORDS // max(1, len(self.langs))):
            self.place, self.table, new = {}, self.table[:0], list(words)
        if new:
            base = len(self.place)
            self.place.update((w, base + k) for k, w in enumerate(new))
            self.table = np.concatenate([
                self.table[:base], word_log_probs(new, self.vocabulary, self.prob, self.boost)])

    def block(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_in(t) if t else [] for t in texts]
        if self.langs:
            self._learn(set().union(*split))
        out = []
        for words in split:
            if not words or not self.langs:
                out.append((UND, 0.0))
                continue
            total = self.table[list(map(self.place.__getitem__, words))].sum(axis=0)
            posterior = np.exp(total - total.max())
            posterior /= posterior.sum()
            best = int(np.argmax(posterior))
            out.append((self.langs[best], float(posterior[best])))
        return out

    def all(self, texts):
        block, size = [], 0
        for t in texts:
            block.append(t)
            size += len(t or "")
            if size >= BLOCK_CHARS:
                yield from self.block(block)
                block, size = [], 0
        yield from self.block(block)


def predict_column(spark, text: Column, model: dict, path: str) -> Column:
    """struct(lang_pred, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        scorer = held(("scorer", name), lambda: Scorer(shared.value, path))
        return pd.DataFrame(list(scorer.all(texts)), columns=["lang_pred", "score"])

    # a filter on the result must not evaluate it once more
    return predict.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3 (null id: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify_language(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) plus ``held_out``, ``lang_pred``, ``score``.

    Learns from the text and non-null language of the rows that are not held out;
    predicts from the text alone.  Null text or a text without a letter: ``und``
    with score 0; so is everything if there is nothing to learn from.  Equal
    posteriors: the first language by code point.  Repeated rows are counted and
    predicted each.  Empty input: empty output.  Input columns named like an
    added one give way.
    """
    labelled = docs.filter(~held_out(F.col(id_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    model = fit(labelled, path)
    added = ["held_out", "lang_pred", "score"]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    guess = predict_column(docs.sparkSession, F.col(text_col), model, path)
    return docs.select(*names, held_out(F.col(id_col)).alias("held_out"), guess.alias("__guess")) \
        .select(*names, "held_out", "__guess.lang_pred", "__guess.score")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify_language(docs, vocabulary_path(), keep=["doc_id"])
