"""Packing token sequences by cutting-stock column generation.

Every document becomes its token ids plus an end id.  Whole sequences of it are
pieces of their own; what is left (the tail, shorter than a sequence) is packed
uncut where that leaves no padding:

* the histogram of tail lengths (at most ``capacity`` numbers, whatever the corpus)
  is the demand of a linear program whose columns are patterns, multisets of lengths
  that fit a sequence, at the price of the padded length;
* a knapsack by dynamic programming under the duals prices columns: one table gives
  the best pattern of every total, and through every length;
* every length may also be laid on *the line* at a small price: its tails then stand
  one after the other and are cut at each multiple of the capacity, without padding.
  These columns are the first basis, so stopping early only means a few more cuts;
* patterns are rounded down, then the left demand takes further patterns as long as
  one fits; what remains goes to the line.

A tail's place follows from its length and its rank among tails of that length by
arithmetic alone.  Ranks need no sort and no shuffle of texts: each task numbers its
tails per length while it encodes, and a prefix sum over (task, length) counts gives
each task's first rank.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tierline.llm.frames import held, stash

CAPACITY = 1024
END_ID = 0
#: Price of laying a tail on the line, and of a sequence shorter than the capacity, in tokens.
LINE_PRICE, SHORT_PRICE = 4.0, 8.0
#: Simplex steps at most; the program also ends when its cost is this near to the tokens.
MAX_PIVOTS, CLOSE = 600, 0.0002
#: Characters encoded before rows are handed on.
BLOCK_CHARS = 500_000
#: A run of white space of this length is split into pre-tokens outside the encoder.
LONG_SPACE = 100_000
#: Rows of the table of first ranks (8 kB each at most) up to which it is sent to all tasks.
SMALL_TASKS = 4096
_RANK_BITS = 44
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)


class TokenEncoder:
    """Token ids as little-endian 32-bit bytes.

    The rank file holds the vocabulary of the ``tokenizers`` file of the same name and
    gives the same ids at a quarter of the time, without a cache that grows with the
    words met; special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).finditer

    def encode(self, text: str) -> bytes:
        if len(text) > LONG_SPACE and _LONG_SPACE.search(text):    # more than the library's own splitting can take
            single = self.coding._encode_single_piece
            return b"".join(array("I", single(m.group())).tobytes() for m in self.split(text))
        return array("I", self.coding.encode_ordinary(text)).tobytes()


def encoder(path: str, pattern: str) -> TokenEncoder:
    return held(("token-encoder", path, pattern), lambda: TokenEncoder(path, pattern))


def encode_tails(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """Per row: doc_id, ``ids`` (binary, end id included), ``n`` tokens, ``task``,
    ``tail`` (n modulo capacity), ``tail_no`` (its number among the task's tails of
    that length) and ``full_no`` (whole sequences the task made before)."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches):
        own, task = encoder(path, pattern), TaskContext.get().partitionId()
        tails, full = [0] * capacity, 0
        for batch in batches:
            at, texts = 0, batch.column(1)
            while at < batch.num_rows:
                block, size = [], 0
                while at + len(block) < batch.num_rows and size < BLOCK_CHARS:
                    block.append(texts[at + len(block)].as_py() or "")
                    size += len(block[-1])
                ids = [own.encode(t) + end for t in block]
                n = [len(x) // 4 for x in ids]
                tail_no, full_no = [], []
                for k in n:
                    tail_no.append(tails[k % capacity])
                    full_no.append(full)
                    tails[k % capacity] += 1
                    full += k // capacity
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)), pa.array(ids, pa.binary()), pa.array(n, pa.int64()),
                     pa.array([task] * len(n), pa.int32()), pa.array([k % capacity for k in n], pa.int32()),
                     pa.array(tail_no, pa.int64()), pa.array(full_no, pa.int64())],
                    names=["doc_id", "ids", "n", "task", "tail", "tail_no", "full_no"])
                at += len(block)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        encode, f"doc_id {kind}, ids binary, n long, task int, tail int, tail_no long, full_no long")


# --- the program -------------------------------------------------------------------

def prices(capacity: int) -> np.ndarray:
    """Price of a sequence by its total: the capacity, or the total at a power of two."""
    price = np.full(capacity + 1, float(capacity))
    for k in range(capacity.bit_length()):
        if 1 << k < capacity:
            price[1 << k] = min(capacity, (1 << k) + SHORT_PRICE)
    price[0] = 0.0
    return price


class Knapsack:
    """Best value of every exact total under item values, and the items behind it."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")

    def solve(self, value: np.ndarray) -> None:
        best = np.full(self.capacity + 1, -np.inf)
        best[0] = 0.0
        last = np.full(self.capacity + 1, -1)
        for total in range(1, self.capacity + 1):
            k = self.upto[total]
            if k:
                got = best[total - self.lengths[:k]] + value[:k]
                at = int(got.argmax())
                best[total], last[total] = got[at], at
        self.best, self.last = best, last

    def items(self, total: int) -> dict[int, int]:
        out: dict[int, int] = {}
        while total > 0:
            at = int(self.last[total])
            out[at] = out.get(at, 0) + 1
            total -= int(self.lengths[at])
        return out


def first_columns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """A triangular first basis: (pattern, length it uses up), longest lengths first.

    Each is a full sequence of one length with one or two others, or the longest others
    a knapsack finds; it is used until one of its lengths is gone, so later patterns do
    without that length and the basic solution is feasible."""
    left = demand.copy()
    place = np.full(capacity + 1, -1)
    place[lengths] = np.arange(len(lengths))
    knapsack, square = Knapsack(lengths, capacity), (lengths / capacity) ** 2
    out, solved, missing = [], False, -1.0

    def find(i):
        nonlocal solved
        room = capacity - int(lengths[i])
        if (j := place[room]) >= 0 and left[j] > 0:
            return [i, int(j)]
        there = np.zeros(room + 1, dtype=bool)
        low = lengths[lengths < room]
        there[low] = left[:len(low)] > 0
        two = np.flatnonzero(there & there[::-1])
        if len(two):
            a, b = place[two], place[room - two]
            k = int(np.minimum(left[a], left[b]).argmax())
            return [i, int(a[k]), int(b[k])]
        for again in (False, True):
            if again or not solved:
                knapsack.solve(np.where(left > 0, square, -np.inf))
                solved = True
            if knapsack.best[room] <= missing:
                return None
            found = knapsack.items(room)
            if all(left[j] > 0 for j in found):
                return [i, *(j for j, k in found.items() for _ in range(k))]
        return None

    for i in range(len(lengths) - 1, -1, -1):
        while left[i] > 0 and (items := find(i)):
            pattern: dict[int, int] = {}
            for j in items:
                pattern[j] = pattern.get(j, 0) + 1
            gone = min(pattern, key=lambda j: left[j] / pattern[j])
            t = left[gone] / pattern[gone]
            for j, k in pattern.items():
                left[j] = max(0.0, left[j] - t * k)
            left[gone] = 0.0
            out.append((pattern, gone))
    return out


def generate_columns(lengths: np.ndarray, demand: np.ndarray, capacity: int):
    """Column generation: (pattern, weight) of the basis reached, and all patterns that
    were ever priced.  A pattern maps positions in ``lengths`` to counts."""
    m = len(lengths)
    price = prices(capacity)
    need = demand + 1e-7 * np.random.Generator(np.random.PCG64(7)).random(m)     # against ties
    basis: list = [None] * m                               # None: the line
    cost, inverse = lengths + LINE_PRICE, np.eye(m)
    pool: dict[tuple, dict[int, int]] = {}

    def enter(pattern, paid, row, column):
        """Puts a column into the basis at a row; sums by einsum, which starts no threads."""
        pivot_row = inverse[row] / column[row]
        touched = np.flatnonzero(np.abs(column) > 1e-12)
        inverse[touched] -= np.outer(column[touched], pivot_row)
        inverse[row] = pivot_row
        basis[row], cost[row] = pattern, paid
        return pivot_row

    for pattern, row in first_columns(lengths, need, capacity):
        column = np.zeros(m)
        column[list(pattern)] = list(pattern.values())
        enter(pattern, capacity, row, column)              # its other lengths are still on the line
        pool[tuple(sorted(pattern.items()))] = pattern
    amount = np.maximum(np.einsum("ij,j->i", inverse, need), 0.0)
    tokens = float((lengths * demand).sum())
    knapsack, steps = Knapsack(lengths, capacity), 0
    while steps < MAX_PIVOTS and float((cost * amount).sum()) > tokens * (1 + CLOSE):
        dual = np.einsum("i,ij->j", cost, inverse)
        knapsack.solve(dual)
        fresh = [knapsack.items(int(t)) for t in np.flatnonzero(knapsack.best - price > 1e-6)[-64:]]
        rest = capacity - lengths
        through = dual + knapsack.best[rest] - capacity
        for at in np.flatnonzero(through > 1e-6):          # the best full sequence through each length
            p = knapsack.items(int(rest[at]))
            p[int(at)] = p.get(int(at), 0) + 1
            fresh.append(p)
        fresh = list({tuple(sorted(p.items())): p for p in fresh}.values())
        if not fresh:
            break                                          # no pattern has a negative reduced cost
        pool.update((tuple(sorted(p.items())), p) for p in fresh)
        matrix = np.zeros((m, len(fresh)))
        for k, p in enumerate(fresh):
            matrix[list(p), k] = list(p.values())
        asked = price[np.einsum("i,ij->j", lengths.astype(np.float64), matrix).round().astype(int)]
        while steps < MAX_PIVOTS:
            reduced = asked - np.einsum("i,ij->j", dual, matrix)
            k = int(reduced.argmin())
            if reduced[k] > -1e-6:
                break
            steps += 1
            rows = list(fresh[k])
            column = (inverse[:, rows] * matrix[rows, k]).sum(axis=1)
            positive = column > 1e-9
            if not positive.any():
                asked[k] = np.inf
                continue
            ratio = np.where(positive, amount / np.where(positive, column, 1.0), np.inf)
            out = int(ratio.argmin())
            step = ratio[out]
            amount = np.maximum(amount - step * column, 0.0)
            amount[out] = step
            dual += reduced[k] * enter(fresh[k], asked[k], out, column)
    chosen = [(p, float(x)) for p, x in zip(basis, amount) if p is not None]
    return chosen, list(pool.values())


def round_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, chosen, pool):
    """Whole numbers of patterns within the demand, and what they leave of it."""
    left = demand.astype(np.int64).copy()
    price = prices(capacity)
    times: dict[tuple, int] = {}

    def take(pattern: dict[int, int], most: float) -> None:
        total = sum(int(lengths[i]) * k for i, k in pattern.items())
        if price[total] - total > LINE_PRICE * sum(pattern.values()) + SHORT_PRICE:
            return                                         # the line pads less
        n = int(min([most, *(left[i] // k for i, k in pattern.items())]))
        if n > 0:
            for i, k in pattern.items():
                left[i] -= n * k
            key = tuple(sorted(pattern.items(), reverse=True))
            times[key] = times.get(key, 0) + n

    for p, x in chosen:
        take(p, math.floor(x + 1e-6))
    for p, x in sorted(chosen, key=lambda c: -(c[1] % 1)):
        take(p, 1)
    for p in pool:
        take(p, math.inf)
    return times, left


@dataclass
class Plan:
    """Where the tail of a length and rank goes: ranges of ranks, sorted."""

    capacity: int
    key: np.ndarray          # length << 44 | first rank
    copies: np.ndarray       # of the length in a sequence; 0: on the line
    first: np.ndarray        # sequence of the range's first rank; on the line: its position
    shift: np.ndarray        # offset of the first copy
    line: int                # sequence at which the line starts

    def place(self, length: np.ndarray, rank: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """(start, length, sequence_id, offset) of the pieces of each tail."""
        at = np.searchsorted(self.key, (length << _RANK_BITS) | rank, side="right") - 1
        t = rank - (self.key[at] & ((1 << _RANK_BITS) - 1))
        copies = np.maximum(self.copies[at], 1)
        on_line = self.copies[at] == 0
        position = self.first[at] + t * length
        sequence = np.where(on_line, self.line + position // self.capacity, self.first[at] + t // copies)
        offset = np.where(on_line, position % self.capacity, self.shift[at] + t % copies * length)
        out = []
        for n, s, o in zip(length.tolist(), sequence.tolist(), offset.tolist()):
            head = min(n, self.capacity - o)
            out.append([(0, head, s, o)] + ([(head, n - head, s + 1, 0)] if head < n else []))
        return out


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for tails per length; entry ``capacity`` counts whole sequences,
    which come first."""
    tails = sorted((r, n) for r, n in histogram.items() if 0 < r < capacity and n > 0)
    lengths = np.array([r for r, _ in tails], dtype=np.int64)
    demand = np.array([n for _, n in tails], dtype=np.float64)
    if len(lengths):
        chosen, pool = generate_columns(lengths, demand, capacity)
        times, left = round_patterns(lengths, demand, capacity, chosen, pool)
    else:
        times, left = {}, np.zeros(0, dtype=np.int64)
    sequence = int(histogram.get(capacity, 0))
    used = np.zeros(len(lengths), dtype=np.int64)
    rows = []
    for pattern, n in times.items():
        offset = 0
        for i, k in pattern:
            rows.append((int(lengths[i]) << _RANK_BITS | int(used[i]), k, sequence, offset))
            used[i] += n * k
            offset += k * int(lengths[i])
        sequence += n
    position = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        if left[i]:
            rows.append((int(lengths[i]) << _RANK_BITS | int(used[i]), 0, position, 0))
            position += int(left[i]) * int(lengths[i])
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return Plan(capacity, table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequence)


# --- on Spark ----------------------------------------------------------------------

def pack_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, ``start`` (tokens of its document before it), ``length``,
    ``ids`` (binary, little-endian 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    ``path`` is a rank file and ``pattern`` its pre-token pattern.
    Pieces of a sequence have no gap; every token lies in exactly one piece; only the
    line's last sequence and the few patterns that do not fill up are padded.  Null
    text: empty, hence one token.  Null or repeated ids and repeated rows are rows of
    their own.  A very long text is many whole sequences and one tail.  Empty input:
    empty output.  Only the two named columns are read.
    """
    spark = docs.sparkSession
    tokens = stash(encode_tails(docs, path, pattern, id_col, text_col, capacity, end_id), "tokens")
    counts = stash(
        tokens.filter("tail > 0").groupBy("task", F.col("tail").alias("r")).agg(F.count("*").alias("c"))
        .unionByName(tokens.groupBy("task").agg(F.sum(F.floor(F.col("n") / capacity)).alias("c"))
                     .select("task", F.lit(capacity).alias("r"), "c")), "tail-counts")
    histogram = {r["r"]: r["c"] for r in counts.groupBy("r").agg(F.sum("c").alias("c")).collect()}
    plan = spark.sparkContext.broadcast(make_plan(histogram, capacity))

    before = F.sum("c").over(Window.partitionBy("r").orderBy("task")) - F.col("c")
    first = stash(counts.withColumn("before", before).groupBy("task").agg(
        F.map_from_entries(F.collect_list(F.struct("r", "before"))).alias("first")), "first-ranks")
    if first.count() <= SMALL_TASKS:
        first = F.broadcast(first)

    @F.pandas_udf("array<struct<start:long,length:long,sequence_id:long,offset:long>>")
    def place(length: pd.Series, rank: pd.Series) -> pd.Series:
        there, out = (length > 0).to_numpy(), np.empty(len(length), dtype=object)
        out[:] = [[] for _ in range(len(length))]
        if there.any():
            placed = plan.value.place(length.to_numpy(dtype=np.int64)[there], rank.to_numpy(dtype=np.int64)[there])
            for k, pieces in zip(np.flatnonzero(there).tolist(), placed):
                out[k] = [{"start": a, "length": b, "sequence_id": c, "offset": d} for a, b, c, d in pieces]
        return pd.Series(out)

    ranked = tokens.join(first, "task").select(
        "doc_id", "ids", "n", "tail", F.floor(F.col("n") / capacity).alias("whole"),
        (F.element_at("first", F.lit(capacity)) + F.col("full_no")).alias("full"),
        F.when(F.col("tail") > 0, F.element_at("first", F.col("tail")) + F.col("tail_no")).otherwise(0).alias("rank"))
    zero = F.lit(0).cast("long")
    wholes = F.when(F.col("whole") > 0, F.transform(F.sequence(zero, F.col("whole") - 1), lambda i: F.struct(
        (i * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"),
        (F.col("full") + i).alias("sequence_id"), zero.alias("offset")))).otherwise(F.array())
    tails = F.transform(place(F.col("tail").cast("long"), F.col("rank")), lambda p: F.struct(
        (F.col("n") - F.col("tail") + p["start"]).alias("start"), p["length"].alias("length"),
        p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset")))
    pieces = ranked.select("doc_id", "ids", "n", F.explode(F.concat(wholes, tails)).alias("p"))
    return pieces.select(
        "doc_id", F.col("p.start").alias("start"), F.col("p.length").alias("length"),
        F.expr("substring(ids, CAST(4 * p.start + 1 AS INT), CAST(4 * p.length AS INT))").alias("ids"),
        F.col("n").alias("doc_tokens"), F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"))


def pack_sequences(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents and the public 50k byte vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
