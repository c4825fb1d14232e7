"""N-gram Jaccard self-join by size: subsets for light sets, lists for heavy ones.

Texts become sets of hashed word shingles (``shingles.py``); equal sets are
collapsed to one.  Two sets link when den * |A & B| >= num * |A | B|, that is when
they share at least c(|A|, |B|) = ceil(num (|A| + |B|) / (num + den)) members.

* Light sets (size up to a boundary) enumerate all their subsets of the fixed
  sizes c that a partner could need.  Sets sharing a c-subset share c members;
  within such a group every set that links at all links with the smallest one,
  so one minimum per group gives the links and no pair is formed.
* Heavy sets scan inverted lists.  Members are ordered, rare before frequent ones
  and by hash within; linked sets share one of their first n - ceil(num n / den) + 1
  members, so only these are listed.  Members listed more than ``FREQUENT`` times
  count as frequent: a passage shared by many texts is listed only for texts that
  consist of it.  Light sets large enough to meet a heavy one are listed too.
* The boundary is the one of least cost: subsets enumerated against list entries
  scanned, from the histogram of small sizes and the mean length of a list.

Pairs of a list pass exact filters (sizes; places in the order; a bitmap of
parities whose differing bits bound the symmetric difference, first a short one,
then one as wide as the set is large) before their sets are fetched and compared.  To keep groups of copies linear, a first round tries
each list's entries against a few leaders; in the next ones an entry names only the
closest of another component, while a fair part of these pairs links; the last one
compares all entries whose components still differ, with finer bitmaps.  Long lists
are dealt into blocks, pairs of blocks being groups of bounded size; so are the
candidates' sets when they are compared.
Nothing is capped: every pair that can link is compared or already connected.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tierline.llm.components import connected_components
from tierline.llm.frames import FEW_TASKS, dealer, held, stash
from tierline.llm.shingles import mix, shingle_sets

#: Members listed more often are frequent; at most so many of them are told to all
#: tasks (the most frequent ones, 8 bytes each).
FREQUENT, MOST_FREQUENT = 32, 1 << 22
#: Largest size that may be light; list entries per block; leaders per list; set
#: members per block when sets are compared; parity bits.
MAX_LIGHT, LIST_BLOCK, LEADERS, CLUSTER_MEMBERS, BITS = 24, 2048, 4, 1_000_000, 512
#: Rows of an id table up to which it is sent to all tasks instead of shuffling texts.
SMALL_ROWS = 500_000
PAIR_SLICE = 1 << 17
#: Entries name their closest again while at least one of so many of these pairs links.
NAMED_PER_LINK = 4

_BITMAP = BITS // 8


def overlap(a, b, num: int, den: int):
    """Members that sets of sizes a and b must share to link."""
    return -(-num * (a + b) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    """Members of a set of size n that must be listed."""
    return n - -(-num * n // den) + 1


def subset_sizes(n: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a light set of size n enumerates."""
    partners = range(-(-num * n // den), n * den // num + 1)
    return sorted({c for b in partners if (c := overlap(n, b, num, den)) <= n and c <= b})


def subset_count(n: int, num: int, den: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, num, den))


def choose_boundary(sizes: dict[int, int], scan: float, num: int, den: int) -> int:
    """Largest light size of least cost, given sets per size and list entries per scan."""
    listed = {n: k * prefix_length(n, num, den) * scan for n, k in sizes.items()}
    best, least = 0, None
    for x in range(0, MAX_LIGHT + 1):
        low = -(-num * (x + 1) // den)
        cost = sum(k * subset_count(n, num, den) for n, k in sizes.items() if n <= x) \
            + sum(c for n, c in listed.items() if n >= low)
        if least is None or cost < least:
            best, least = x, cost
    return best


def parity_bitmap(members: np.ndarray, bits: int = BITS) -> bytes:
    """Parities of the members' hash classes (``bits`` of them, a power of two)."""
    odd = np.bincount((members.view(np.uint64) >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def wide_bits(n: int) -> int:
    """Bits that keep the parities of a set of n members telling: 2 n or more."""
    return max(BITS, 1 << (2 * n - 1).bit_length())


def differing_bits(a: bytes, b: bytes) -> int:
    """Differing parities of two bitmaps; the longer one is folded to the shorter."""
    bits = 8 * min(len(a), len(b))
    x, y = (np.frombuffer(folded(v, bits), dtype=np.uint64) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def folded(bitmap: bytes, bits: int) -> bytes:
    """The bitmap of so many bits, from a longer one."""
    x = np.frombuffer(bitmap, dtype=np.uint64)
    while len(x) * 64 > bits:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x.tobytes()


def _ordered(members: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Rare members first, by hash within."""
    if not len(frequent):
        return members
    at = np.searchsorted(frequent, members)
    often = frequent[np.minimum(at, len(frequent) - 1)] == members
    return np.concatenate([members[~often], members[often]]) if often.any() else members


def _prefix_counts(texts: Column, k: int, num: int, den: int) -> Column:
    @F.pandas_udf("array<long>")
    def prefixes(ts: pd.Series) -> pd.Series:
        held("shingles", dict)         # lets go of what an earlier operator left in this worker
        return pd.Series([s[:prefix_length(len(s), num, den)] if len(s) else s for s in shingle_sets(ts, k)],
                         dtype=object)
    return prefixes(texts)


_SKETCH = "n int, digest binary, listed array<long>, members array<long>, bitmap binary, wide binary"


def _sketch(spark, texts: Column, k: int, num: int, den: int, frequent: np.ndarray) -> Column:
    """Size, digest, listed members, all members of a small set, and bitmap of each text's set."""
    shared = spark.sparkContext.broadcast(frequent)

    @F.pandas_udf(_SKETCH)
    def sketch(ts: pd.Series) -> pd.DataFrame:
        held("shingles", dict)         # lets go of what an earlier operator left in this worker
        often = shared.value
        rows = []
        for s in shingle_sets(ts, k):
            n = len(s)
            rows.append((n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                         _ordered(s, often)[:prefix_length(n, num, den)] if n else s,
                         s if 0 < n <= MAX_LIGHT else None, parity_bitmap(s),
                         parity_bitmap(s, wide_bits(n)) if wide_bits(n) > BITS else None))
        return pd.DataFrame(rows, columns=["n", "digest", "listed", "members", "bitmap", "wide"])

    return sketch(texts)


def _frequent_members(rows: DataFrame, k: int, num: int, den: int):
    """The frequent members (sorted) and the mean number of entries that a scan of a
    rare member's list meets."""
    counts = stash(rows.select(F.explode(_prefix_counts(F.col("text"), k, num, den)).alias("member"))
                   .groupBy("member").agg(F.count("*").alias("df")).filter("df > 1"), "members")
    often = counts.filter(F.col("df") > FREQUENT)
    found = often.count()
    if found > MOST_FREQUENT:      # the same order must hold everywhere: keep whole classes of frequency
        cut = often.agg(F.percentile("df", F.lit(1 - MOST_FREQUENT / found))).first()[0]
        often = often.filter(F.col("df") > cut)
    member = np.sort(often.select("member").toPandas()["member"].to_numpy(dtype=np.int64))
    scan = counts.filter(F.col("df") <= FREQUENT).agg(
        F.coalesce(F.sum(F.col("df") * F.col("df")) / F.sum("df"), F.lit(1.0))).first()[0]
    return member, float(scan)


def _light_links(sets: DataFrame, boundary: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among sets of at most ``boundary`` members."""
    def enumerate_subsets(batches):
        for pdf in batches:
            sig, size, n_of, sid_of = [], [], [], []
            for sid, n, members in zip(pdf["sid"], pdf["n"], pdf["members"]):
                m = mix(np.asarray(members, dtype=np.int64).view(np.uint64))
                for c in subset_sizes(n, num, den):
                    left_out = np.array(list(combinations(range(n), n - c)), dtype=np.int64).reshape(math.comb(n, c), n - c)
                    sums = m.sum(dtype=np.uint64) - m[left_out].sum(axis=1, dtype=np.uint64)
                    sig.append(mix(sums + np.uint64(c)).view(np.int64))
                    size.append(np.full(len(sums), c))
                    n_of.append(np.full(len(sums), n))
                    sid_of.append(np.full(len(sums), sid))
            if sig:
                yield pd.DataFrame({"sig": np.concatenate(sig), "c": np.concatenate(size),
                                    "n": np.concatenate(n_of), "sid": np.concatenate(sid_of)})

    subsets = sets.filter(F.col("n").between(1, boundary)).select("sid", "n", "members") \
        .mapInPandas(enumerate_subsets, "sig long, c int, n int, sid long")
    least = subsets.groupBy("sig", "c").agg(F.min(F.struct("n", "sid")).alias("first"), F.count("*").alias("k")) \
        .filter("k > 1").select("sig", "c", F.col("first.n").alias("n0"), F.col("first.sid").alias("a"))
    need = F.ceil((F.col("n") + F.col("n0")) * F.lit(num) / F.lit(num + den))
    return subsets.join(least, ["sig", "c"]).filter((F.col("sid") != F.col("a")) & (need <= F.col("c"))) \
        .select("a", F.col("sid").alias("b")).distinct()


def _list_pairs(entries: DataFrame, maps: DataFrame, deal, num: int, den: int, leaders: int | None = None,
                closest: int | None = None) -> DataFrame:
    """Candidate pairs (a, b) of lists: each entry against the first ``leaders`` of
    its list, or against the ``closest`` one of its block (the number deals the
    blocks), or against all; only of differing components.  ``maps`` has the
    entries' bitmaps; ``deal`` puts as many rows as entries into tasks."""
    def meet(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
            key = [held.column(c).to_numpy() for c in ("member", "i", "j")]
            change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in key])) + 1
            if not len(change):
                continue
            yield from _met(held.slice(0, int(change[-1])), num, den, leaders, closest is not None)
            held = held.slice(int(change[-1]))
        if held is not None and held.num_rows:
            yield from _met(held, num, den, leaders, closest is not None)

    block = F.pmod(F.xxhash64("sid", *([] if closest is None else [F.lit(closest)])), F.col("nb")).cast("int")
    entries = deal(entries.join(maps, "sid"))
    dealt = entries.withColumn("nb", F.ceil(F.col("df") / LIST_BLOCK).cast("int")).withColumn("block", block)
    others = F.sequence(F.lit(0), F.col("nb") - 1)
    met = F.transform(others, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    if leaders is not None:        # leaders stand in the first block
        met = F.filter(met, lambda p: p["i"] == 0)
    elif closest is not None:      # no row is sent twice
        met = F.filter(met, lambda p: p["i"] == p["j"])
    cols = ["member", "sid", "n", "pos", "comp", "bitmap", "block"] + ["finer"] * ("finer" in entries.columns)
    spread = dealt.select(*cols, F.explode(met).alias("p")).select(*cols, "p.i", "p.j")
    ordered = deal(spread.repartition("member", "i", "j")).sortWithinPartitions("member", "i", "j", "block", "sid")
    return deal(ordered.mapInArrow(meet, "a long, b long").distinct())


def _met(rows: pa.Table, num: int, den: int, leaders: int | None, closest: bool = False):
    """Filtered pairs of complete lists (or pairs of blocks), as record batches."""
    member, i, j, block, sid, n, pos, comp = (
        rows.column(c).to_numpy() for c in ("member", "i", "j", "block", "sid", "n", "pos", "comp"))
    bitmap = np.frombuffer(b"".join(rows.column("bitmap").to_pylist()), dtype=np.uint64).reshape(-1, _BITMAP // 8)
    finer = None
    if "finer" in rows.column_names:   # null for the small sets, which need none
        finer = np.frombuffer(b"".join(x or bytes(2 * _BITMAP) for x in rows.column("finer").to_pylist()),
                              dtype=np.uint64).reshape(-1, _BITMAP // 4)
    total = len(sid)
    first = np.concatenate(([True], (member[1:] != member[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    start = np.flatnonzero(first)
    stop = np.concatenate((start[1:], [total]))
    group = np.cumsum(first) - 1
    if leaders is None:                # by component: an entry meets those behind its component
        order = np.lexsort((comp, group))
        i, j, block, sid, n, pos, comp, bitmap = (x[order] for x in (i, j, block, sid, n, pos, comp, bitmap))
        finer = None if finer is None else finer[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (comp[1:] != comp[:-1])))
        run = np.cumsum(new) - 1
        behind = np.concatenate((np.flatnonzero(new)[1:], [total]))[run]
        ahead = stop[group] - behind
    else:
        behind = np.arange(total) + 1
        ahead = np.where(np.arange(total) - start[group] < leaders, stop[group] - behind, 0)
    if closest:
        best = np.full(total, np.iinfo(np.int64).max)
    upto = np.cumsum(ahead)
    at = 0
    while at < total:
        base = upto[at] - ahead[at]
        end = max(at + 1, int(np.searchsorted(upto, base + PAIR_SLICE, side="right")))
        k = ahead[at:end]
        a = np.repeat(np.arange(at, end), k)
        b = np.repeat(behind[at:end], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        at = end
        ok = (comp[a] != comp[b]) & ((i[a] == j[a]) | (block[a] != block[b]))
        a, b = a[ok], b[ok]
        na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
        need = overlap(na, nb, num, den)
        ok = (np.minimum(na, nb) >= need) & (np.minimum(na - pos[a], nb - pos[b]) >= need)
        a, b, spare = a[ok], b[ok], (na + nb - 2 * need)[ok]
        over = np.bitwise_count(bitmap[a] ^ bitmap[b]).sum(axis=1).astype(np.int64) - spare
        ok = over <= 0
        if finer is not None:
            a, b, spare = a[ok], b[ok], spare[ok]
            ok = (np.bitwise_count(finer[a] ^ finer[b]).sum(axis=1) <= spare) | (np.minimum(n[a], n[b]) <= BITS // 2)
        if closest:
            far = (over[ok] + (1 << 31)) * total
            np.minimum.at(best, a[ok], far + b[ok])
            np.minimum.at(best, b[ok], far + a[ok])
        elif ok.any():
            yield _pair_batch(sid[a[ok]], sid[b[ok]])
    if closest:
        # every component but the largest of a list names its entries' closest
        size = np.bincount(run)[run]
        largest = np.zeros(len(start), dtype=np.int64)
        np.maximum.at(largest, group, size * total + run)
        named = np.flatnonzero((best != np.iinfo(np.int64).max) & (largest[group] % total != run))
        if len(named):
            yield _pair_batch(sid[named], sid[best[named] % total])


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``SMALL_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _narrowed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose wide bitmaps, too, leave a link possible."""
    @F.pandas_udf("boolean")
    def possible(na: pd.Series, nb: pd.Series, wa: pd.Series, wb: pd.Series) -> pd.Series:
        return pd.Series([x is None or y is None or differing_bits(x, y) <= m + n - 2 * overlap(m, n, num, den)
                          for m, n, x, y in zip(na.tolist(), nb.tolist(), wa, wb)], dtype=bool)

    side = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("wide").alias(f"w_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b") \
        .filter(possible.asNondeterministic()("n_a", "n_b", "w_a", "w_b")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, int]:
    """The pairs that link, thinned within a task to a spanning forest; and the number of all pairs.

    Sets are dealt into blocks of about ``CLUSTER_MEMBERS`` set members, next to
    their smallest partner (a star of a leader and its list is one block); a
    partner whose own star is larger than a block is spread over several.  A pair of
    blocks is a group.  A set goes to the groups that have a pair with it, once to
    each, and is fetched once.
    """
    spark = pairs.sparkSession
    met = stash(pairs, "met")
    named = met.count()
    deal = dealer(named)
    pairs = stash(deal(_narrowed(met, sets, num, den)), "pairs")
    if pairs.isEmpty():
        return spark.createDataFrame([], "a long, b long"), named
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    wanted = stash(deal(deal(ends.groupBy(F.col("a").alias("sid")).agg(F.least(F.min("b"), F.col("sid")).alias("star")))
                        .join(sets.select("sid", "rep", "digest", "n"), "sid")), "wanted")
    total = wanted.agg(F.sum("n")).first()[0]
    blocks = max(1, math.ceil(total / CLUSTER_MEMBERS))
    stars = deal(wanted.groupBy("star").agg(F.ceil(F.sum("n") / CLUSTER_MEMBERS).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("sid"), F.col("parts"))
    place = stash(deal(wanted.join(stars, "star").withColumn(
        "block", F.pmod(F.xxhash64("star", part), F.lit(blocks)).cast("int"))
        .select("sid", "rep", "digest", "block")), "placed")

    of_a = place.select(F.col("sid").alias("a"), F.col("block").alias("x"))
    of_b = place.select(F.col("sid").alias("b"), F.col("block").alias("y"))
    asked = stash(deal(pairs.join(of_a, "a").join(of_b, "b").select(
        F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b")), "asked")
    needed = stash(deal(asked.select("i", "j", F.col("a").alias("sid"))
                        .unionByName(asked.select("i", "j", F.col("b").alias("sid"))).distinct()), "needed")
    asks = deal(needed.groupBy("sid").agg(F.collect_list(F.struct("i", "j")).alias("groups"))).join(place, "sid")
    if needed.count() <= SMALL_ROWS:
        asks = F.broadcast(asks)
    fetched = docs.join(asks, F.col("doc_id").eqNullSafe(F.col("rep")))

    @F.pandas_udf("digest binary, members binary")
    def members(ts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s.tobytes())
                             for s in shingle_sets(ts, k)], columns=["digest", "members"])

    # not to be evaluated once for the filter and once more for the rows
    members = members.asNondeterministic()
    sent = fetched.withColumn("s", members("text")).filter(F.col("s.digest") == F.col("digest")) \
        .select("sid", F.col("s.members").alias("members"), F.explode("groups").alias("p")) \
        .select("p.i", "p.j", F.col("sid").alias("a"), F.lit(-1).cast("long").alias("b"), "members")
    asked = asked.withColumn("members", F.lit(None).cast("binary"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        is_set = (pdf["b"] == -1).to_numpy()
        have = {s: np.frombuffer(m, dtype=np.int64) for s, m in zip(pdf["a"][is_set], pdf["members"][is_set])}
        up: dict[int, int] = {}

        def top(v):
            while up.get(v, v) != v:
                up[v] = up.get(up[v], up[v])
                v = up[v]
            return v

        out = []
        asked_rows = pdf[~is_set]
        for a, b in zip(asked_rows["a"].tolist(), asked_rows["b"].tolist()):
            x, y = have[a], have[b]
            ra, rb = top(a), top(b)
            if ra == rb:
                continue               # connected by links already found
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if den * shared >= num * (len(x) + len(y) - shared):
                up[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found = sent.unionByName(asked).groupBy("i", "j").applyInPandas(compare, "a long, b long")
    if blocks * (blocks + 1) // 2 <= FEW_TASKS:     # no more groups than tasks
        found = found.coalesce(FEW_TASKS)
    return stash(found, "links"), named


def _open_entries(entries: DataFrame, roots: DataFrame, deal) -> DataFrame:
    """The lists with more than one component; ``comp`` is an entry's."""
    comp = entries.drop("comp").join(roots.withColumnRenamed("node", "sid"), "sid", "left") \
        .withColumn("comp", F.coalesce("root", "sid")).drop("root")
    open_lists = deal(comp.groupBy("member").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                      .filter("lo < hi").select("member"))
    return deal(comp.join(open_lists, "member"))


def _finer_maps(sets: DataFrame, entries: DataFrame) -> DataFrame:
    """Bitmaps of the sets in ``entries``, and of twice the bits where a set needs them."""
    @F.pandas_udf("binary")
    def finer(wide: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else folded(w, 2 * BITS) for w in wide], dtype=object)

    return sets.join(entries.select("sid").distinct(), "sid", "left_semi") \
        .select("sid", "bitmap", finer("wide").alias("finer"))


def linked_documents(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ``digest`` of its set, ``n_shingles``, ``root`` (a number of
    its component) and ``component_id`` (smallest doc_id of the component).

    Sets of equal members are one node, so equal texts are linked.  A text without
    words (null, empty, white space) has an empty set and links with nothing: root
    null, component_id its own id.  Null ids take no part in the smallest id;
    component_id is null if a component has no other.  Repeated rows give one row
    each.  Empty input: empty output.  Only the two named columns are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    frequent, scan = _frequent_members(rows, k, num, den)
    sketched = stash(rows.select("doc_id", _sketch(spark, F.col("text"), k, num, den, frequent).alias("s"))
                     .select("doc_id", "s.*"), "sketches")
    sets = stash(sketched.filter("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("listed").alias("listed"),
        F.first("members").alias("members"), F.first("bitmap").alias("bitmap"), F.first("wide").alias("wide"))
        .withColumn("sid", F.monotonically_increasing_id()), "sets")

    small = {r["n"]: r["k"] for r in sets.filter(F.col("n") <= 2 * MAX_LIGHT)
             .groupBy("n").agg(F.count("*").alias("k")).collect()}
    boundary = choose_boundary(small, scan, num, den)
    links = _light_links(sets, boundary, num, den)

    least_listed = -(-num * (boundary + 1) // den)
    entries = sets.filter(F.col("n") >= least_listed) \
        .select("sid", "n", F.posexplode("listed").alias("pos", "member"))
    df = entries.groupBy("member").agg(F.count("*").alias("df")).filter("df > 1")
    entries = stash(entries.join(df, "member"), "entries")
    maps = sets.select("sid", "bitmap")

    deal = dealer(entries.count())
    tried = _list_pairs(entries.withColumn("comp", F.col("sid")), maps, deal, num, den, LEADERS)
    links = stash(links.unionByName(_verified(tried, sets, rows, k, num, den)[0]), "links")
    roots = connected_components(links)
    entries = entries.filter(F.col("df") > LEADERS + 1)        # the leaders met all of a shorter list
    pays = True
    for turn in itertools.count():
        entries = stash(_open_entries(entries, roots, deal), "open")
        if entries.isEmpty():
            break
        deal = dealer(entries.count())
        if pays:
            pairs = _list_pairs(entries, maps, deal, num, den, closest=turn)
        else:
            pairs = _list_pairs(entries, _finer_maps(sets, entries), deal, num, den)
        found, named = _verified(pairs, sets, rows, k, num, den)
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = connected_components(links)
        if not pays:
            break
        pays = NAMED_PER_LINK * found.count() >= max(named, 1)

    named = sets.select("sid", "digest", "rep").join(roots.withColumnRenamed("node", "sid"), "sid", "left") \
        .withColumn("root", F.coalesce("root", "sid"))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root") \
        .select("digest", "root", "component_id")
    return sketched.select("doc_id", "n", "digest").join(named, "digest", "left").select(
        "doc_id", "digest", F.col("n").cast("long").alias("n_shingles"), "root",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of linked ones does.

    It is the one of the smallest id.  Texts without words all stay.  Of rows
    sharing an id, which the id cannot tell apart, and of those without one, the
    digest of the set decides, and one row of each component's first set stays.
    """
    linked = stash(linked_documents(docs, k, num, den, id_col, text_col), "linked")
    unclear = stash(linked.groupBy(F.col("doc_id").alias("unclear_id")).agg(F.count("*").alias("rows"))
                    .filter("rows > 1 OR unclear_id IS NULL").select("unclear_id"), "unclear-ids")
    gone = stash(linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
                 .join(unclear, F.col("gone_id").eqNullSafe(F.col("unclear_id")), "left_anti"), "dropped-ids")
    clear = docs.join(_small(gone), docs[id_col] == gone["gone_id"], "left_anti")
    if unclear.isEmpty():
        return clear
    is_unclear = docs[id_col].eqNullSafe(unclear["unclear_id"])
    clear = clear.join(_small(unclear), is_unclear, "left_anti")

    @F.pandas_udf("binary")
    def digest(ts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in shingle_sets(ts, k)],
                         dtype=object)

    digest = digest.asNondeterministic()
    # of each component the row of smallest (id, digest) stays, if its id is among the unclear ones
    first = linked.filter("root IS NOT NULL").groupBy("root") \
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("f"))
    first = first.select("root", F.col("f.doc_id").alias("first_id"), F.col("f.digest").alias("first_digest")) \
        .join(unclear, F.col("first_id").eqNullSafe(F.col("unclear_id")), "left_semi")
    names = docs.columns
    doubtful = docs.join(_small(unclear), is_unclear, "left_semi") \
        .select(F.struct(*names).alias("row"), docs[id_col].alias("k_id"), digest(F.col(text_col)).alias("k_digest"))
    empty = hashlib.blake2b(b"", digest_size=16).digest()
    wordless = doubtful.filter(F.col("k_digest") == F.lit(empty)).select("row.*")
    chosen = doubtful.join(first, F.col("k_id").eqNullSafe(F.col("first_id")) & (F.col("k_digest") == F.col("first_digest"))) \
        .groupBy("root").agg(F.first("row").alias("row")).select("row.*")
    return clear.unionByName(wordless).unionByName(chosen)


def jaccard_components(spark, sf_dir: str) -> DataFrame:
    """Contract query: three-word shingles, Jaccard 0.9, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked_documents(docs, k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")
