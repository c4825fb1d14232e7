"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, and decoding.

Merging a piece means: again and again join the neighbouring pair of lowest
rank, the leftmost of equals.  The queue keeps one bucket per merge rank, each
a heap of linked-list places, and a two-level bitmap over the ranks: a leaf bit
says that a bucket has entries, a top bit that a leaf word has any.  Two
find-first-set steps name the next rank.  Entries whose pair has changed since
they were queued are stale; they are skipped when they come up.  n bytes cost
O(n log n), also in a single pre-token of a million bytes.

All pieces of a block of texts that are not known yet share one queue: their
linked lists are not joined to each other, so no pair spans two pieces, and the
bitmap steps are shared.  Spark deals out the texts; each Python worker keeps
the rank table and a bounded two-generation cache of encoded pieces.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tierline.llm.frames import held

#: Ranks per leaf word of the bitmap.
LEAF_BITS = 256
#: Pieces per generation of a worker's cache (two generations are held), the
#: longest piece in characters worth keeping, and characters per block of texts.
CACHE_PIECES = 250_000
CACHE_CHARS = 64
BLOCK_CHARS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Merges the pieces of one rank table; every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = [bytes([b]) for b in range(256)]
        self.pairs = np.full(1 << 16, -1, dtype=np.int64)   # two bytes -> rank
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each (non-empty) piece."""
        get = self.ranks.get
        data = b"".join(pieces)
        n = len(data)
        ends = np.cumsum([len(p) for p in pieces])
        token = list(map(self.single.__getitem__, data))
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        before[starts] = -1
        # ranks of the byte pairs, and a bucket of ascending places for each rank
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        first = np.full(n, -1, dtype=np.int64)
        first[:-1] = self.pairs[raw[:-1] << 8 | raw[1:]]
        first[ends - 1] = -1
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        used, at = np.unique(first[places], return_index=True)
        buckets = {r: b.tolist() for r, b in zip(used.tolist(), np.split(places, at[1:]))} if len(used) else {}
        leaves: dict[int, int] = {}
        for r in buckets:
            leaves[r // LEAF_BITS] = leaves.get(r // LEAF_BITS, 0) | 1 << r % LEAF_BITS
        top = sum(1 << w for w in leaves)
        after, before, pair_rank = after.tolist(), before.tolist(), first.tolist()

        while top:
            w = (top & -top).bit_length() - 1               # find first set: leaf word,
            leaf = leaves[w]
            r = w * LEAF_BITS + (leaf & -leaf).bit_length() - 1    # then rank
            bucket = buckets[r]
            lower = False
            while bucket and not lower:
                i = heappop(bucket)
                if pair_rank[i] != r:
                    continue                                # stale: changed or joined already
                j = after[i]
                k = after[j]
                merged = token[i] + token[j]
                token[i] = merged
                after[i] = k
                pair_rank[j] = -1
                h = before[i]
                if k >= 0:
                    before[k] = i
                    q = get(merged + token[k])
                    if q is None:
                        pair_rank[i] = -1
                    else:
                        pair_rank[i] = q
                        other = buckets.get(q)
                        if other is None:
                            buckets[q] = [i]
                            v = q // LEAF_BITS
                            leaves[v] = leaves.get(v, 0) | 1 << q % LEAF_BITS
                            top |= 1 << v
                        else:
                            heappush(other, i)
                        lower = q < r
                else:
                    pair_rank[i] = -1
                if h >= 0:
                    q = get(token[h] + merged)
                    if q is None:
                        pair_rank[h] = -1
                    elif pair_rank[h] != q:
                        pair_rank[h] = q
                        other = buckets.get(q)
                        if other is None:
                            buckets[q] = [h]
                            v = q // LEAF_BITS
                            leaves[v] = leaves.get(v, 0) | 1 << q % LEAF_BITS
                            top |= 1 << v
                        else:
                            heappush(other, h)
                        lower = lower or q < r
            if not bucket:
                del buckets[r]
                leaf = leaves[w] & ~(1 << r % LEAF_BITS)
                leaves[w] = leaf
                if not leaf:
                    top &= ~(1 << w)

        out, ranks = [], self.ranks
        for i in starts.tolist():
            ids = []
            while i >= 0:
                ids.append(ranks[token[i]])
                i = after[i]
            out.append(tuple(ids))
        return out


class Codec:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.queue = RankQueue(self.ranks)
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.decimal = {r: str(r) for r in self.bytes_of}
        self.split = regex.compile(pattern).findall
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Put all ``pieces`` into the cache; what is too long to keep is returned."""
        if len(self.new) >= CACHE_PIECES:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        unknown, raw = [], []
        for p in pieces:
            if p in new:
                continue
            ids = old.get(p)
            if ids is None:
                b = p.encode("utf-8", "surrogatepass")
                whole = self.ranks.get(b)
                if whole is None:
                    unknown.append(p)
                    raw.append(b)
                    continue
                ids = (whole,)
            new[p] = ids
        if not unknown:
            return {}
        merged = dict(zip(unknown, self.queue.merge(raw)))
        new.update((p, ids) for p, ids in merged.items() if len(p) <= CACHE_CHARS)
        return {p: ids for p, ids in merged.items() if len(p) > CACHE_CHARS}

    def encode_block(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        split = [self.split(t) for t in texts]
        long = self._learn(set(chain.from_iterable(split)))
        if not long:
            look = self.new.__getitem__
        else:
            look = lambda p: long[p] if p in long else self.new[p]
        return [list(chain.from_iterable(map(look, pieces))) for pieces in split]

    def encode_all(self, texts):
        """Token ids of each text (null: none) in order, block by block."""
        block, size = [], 0
        for t in texts:
            block.append(t or "")
            size += len(block[-1])
            if size >= BLOCK_CHARS:
                yield from self.encode_block(block)
                block, size = [], 0
        yield from self.encode_block(block)

    def encode(self, text: str) -> list[int]:
        return self.encode_block([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file."""
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """Token ids of a text column (array<int>; null text: empty array)."""
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series(list(c.encode_all(texts)), dtype=object)
    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of a column of token ids (binary; null: null)."""
    @F.pandas_udf("binary")
    def decode(rows: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([None if r is None else c.decode(r) for r in rows], dtype=object)
    return decode(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` plus ``n_tokens``, ``token_ids`` and ``intact``
    (whether the ids decode to the text's bytes).

    Ids leave the worker block by block, so what it holds is bounded by a block of
    texts (or one text).  Null text: no tokens.  Repeated rows give one row each.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def encode(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = batch.column(len(keep))
            at, n = 0, batch.num_rows
            while at < n:
                block, size = [], 0
                while at + len(block) < n and size < BLOCK_CHARS:
                    t = texts[at + len(block)].as_py() or ""
                    block.append(t)
                    size += len(t)
                ids = c.encode_block(block)
                intact = [c.decode(i) == t.encode("utf-8", "surrogatepass") for i, t in zip(ids, block)]
                arrays = [np.array(i, dtype=np.int32) for i in ids]
                kept = [batch.column(k).slice(at, len(block)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([len(i) for i in arrays], pa.int64()), pa.array(arrays, pa.list_(pa.int32())),
                     pa.array(intact)], names=[*keep, "n_tokens", "token_ids", "intact"])
                at += len(block)

    return docs.select(*keep, F.col(text_col)).mapInArrow(
        encode, f"{fields}, n_tokens long, token_ids array<int>, intact boolean")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Ids and bytes are made and digested in one pass, so that no id list leaves
    the worker.  Null text: no tokens, digests of the empty string.  A very long
    pre-token is merged whole.  Repeated rows give one row each; extra columns
    are not read; an empty input gives an empty output.
    """
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        c = codec(path, pattern)
        rows = []
        for ids in c.encode_all(texts):
            listed = " ".join(map(c.decimal.__getitem__, ids))
            rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                         hashlib.sha256(c.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digests(F.col(text_col)).alias("d")) \
        .select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents and the public 50k byte vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
