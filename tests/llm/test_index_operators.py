"""Packing, source divergence and lexical search against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierline.llm import lexical_search as ls, sequence_packing as sp, source_divergence as sd
from tierline.llm.bpe_queue import Codec


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers as p
    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


# --- packing -----------------------------------------------------------------------

def _fill(placed):
    """Tokens per sequence of (sequence, offset, length) pieces without gap or overlap."""
    by = collections.defaultdict(list)
    for s, o, n in placed:
        by[s].append((o, n))
    for s, pieces in by.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= sp.CAPACITY
        by[s] = at
    return by


def _padding(fill):
    return sum(0 if n & (n - 1) == 0 else sp.CAPACITY - n for n in fill.values())


@pytest.mark.parametrize("name,draw", [
    ("even", lambda r: r.randint(1, 1023)), ("hot", lambda r: 600 if r.random() < 0.4 else r.randint(300, 1023)),
    ("long", lambda r: r.randint(520, 1023)), ("same", lambda r: 700), ("short", lambda r: r.randint(1, 5)),
    ("halves", lambda r: 512)])
def test_plans_place_every_tail_once_with_little_padding(name, draw):
    r = random.Random(5)
    lengths = [draw(r) for _ in range(4000)]
    plan = sp.make_plan({**collections.Counter(lengths), sp.CAPACITY: 7})
    seen, length, rank = collections.Counter(), [], []
    for n in lengths:
        length.append(n)
        rank.append(seen[n])
        seen[n] += 1
    pieces = plan.place(np.array(length), np.array(rank))
    assert all(sum(p[1] for p in ps) == n and [p[0] for p in ps] == [0, ps[0][1]][:len(ps)] for n, ps in zip(length, pieces))
    fill = _fill([(s, o, n) for ps in pieces for _, n, s, o in ps])
    assert min(fill) >= 7 and _padding(fill) <= 0.002 * sum(lengths) + sp.CAPACITY
    if name == "even":
        assert sum(len(ps) > 1 for ps in pieces) < 0.12 * len(pieces)       # most tails stay whole


def test_columns_are_priced_until_none_helps():
    lengths, demand = np.array([300, 424, 600, 724]), np.array([40.0, 40.0, 40.0, 40.0])
    chosen, _ = sp.generate_columns(lengths, demand, sp.CAPACITY)
    times, left = sp.round_patterns(lengths, demand, sp.CAPACITY, chosen, [])
    assert not left.any()
    assert {tuple(sorted(p)): n for p, n in times.items()} == {((1, 1), (2, 1)): 40, ((0, 1), (3, 1)): 40}
    assert sp.make_plan({}).place(np.array([], dtype=np.int64), np.array([], dtype=np.int64)) == []


def _check_packed(docs, got, path, pattern):
    codec = Codec(path, pattern)
    want = collections.Counter()
    for r in docs.collect():
        ids = codec.encode(r["text"] or "") + [0]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
    rows = got.collect()
    fill = _fill([(r["sequence_id"], r["offset"], r["length"]) for r in rows])
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert sum(fill.values()) == sum(n * k for (_, n, _), k in want.items())
    by = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in rows:
        by[(r["doc_id"], r["doc_tokens"])][r["start"]].append(bytes(r["ids"]))
    single = {k for k, n in collections.Counter((d, n) for d, n, _ in want.elements()).items() if n == 1}
    for (d, n, crc) in want:
        if (d, n) in single:
            parts = by[(d, n)]
            whole = b"".join(parts[s][0] for s in sorted(parts))
            assert len(whole) == 4 * n and zlib.crc32(whole) == crc and all(len(p) == 1 for p in parts.values())
    return fill


def test_packed_pieces_hold_all_tokens_of_odd_documents(spark, odd_docs, clashing, no_docs, ranks):
    fill = _check_packed(odd_docs, sp.pack_documents(odd_docs, *ranks), *ranks)
    assert _padding(fill) < sp.CAPACITY
    assert sp.pack_documents(clashing, *ranks).count() == sp.pack_documents(odd_docs, *ranks).count()
    empty = sp.pack_documents(no_docs, *ranks)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    named = odd_docs.selectExpr("CAST(doc_id AS STRING) AS name", "text AS body")
    assert dict(sp.pack_documents(named, *ranks, id_col="name", text_col="body").dtypes)["doc_id"] == "string"


def test_ids_equal_those_of_the_tokenizers_library(ranks):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = sp.TokenEncoder(*ranks)
    r = random.Random(3)
    pool = "abcxyz ABC \n\t  '  's 're 019 .,;!? äöüßéñ 漢字 🙂 \u00a0\u2003 <|endoftext|> \r\n"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 80))) for _ in range(400)] + ["", " " * 300, "x" * 5000]
    for x in texts:
        assert np.frombuffer(own.encode(x), dtype="<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    long = "a" + "\n" * (sp.LONG_SPACE + 5) + "b  c"
    assert np.frombuffer(own.encode(long), dtype="<u4").tolist() == Codec(*ranks).encode(long)


# --- divergence --------------------------------------------------------------------

def _audit(rows, min_docs, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        found = collections.Counter(word.findall((text or "").translate(lower)))
        n[(lang or "", source or "")] += found
        df[lang or ""].update(found.keys())
    out = []
    share = lambda c, total, v: 1 + 10 ** 9 * (c + 5) // (total + 5 * v)
    for lang in df:
        kept = sorted(t for t, k in df[lang].items() if k >= min_docs)
        v, p, all_n = len(kept), {}, collections.Counter()
        groups = sorted(s for a, s in n if a == lang)
        for s in groups:
            total = sum(n[(lang, s)][t] for t in kept)
            p[s] = {t: share(n[(lang, s)][t], total, v) for t in kept}
            all_n.update({t: n[(lang, s)][t] for t in kept})
        q = {t: share(all_n[t], sum(all_n.values()), v) for t in kept}
        for s in groups:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if n[(lang, s)][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def _words(r, vocabulary, n):
    return " ".join(r.choice(vocabulary) for _ in range(n))


def test_divergence_equals_brute_force(spark, monkeypatch):
    r = random.Random(11)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(8)] + ["Über", "ÜBER", "ñ", "漢字"]
    rows = []
    for i in range(300):
        source = r.choice(["hot"] * 4 + ["b", "c", "Ä", "", None])
        some = vocabulary[:20] if source == "hot" else vocabulary
        rows.append((r.choice(["en", "en", "de", None]), source, _words(r, some, r.randint(0, 30))))
    rows += [("xx", "alone", "one two"), ("yy", "s1", None), ("yy", "s2", "12 34 --"), (None, None, None)] + [rows[0]] * 5
    docs = spark.createDataFrame([(*x, 1, "t") for x in rows], "lang string, source string, text string, value int, term string")
    want = _audit(rows, 9, 4)
    for block in (500_000, 40):                    # one run a task, and many
        monkeypatch.setattr(sd, "BLOCK_POSTINGS", block)
        got = sd.divergence(docs.repartition(5), min_docs=9, top_terms=4)
        assert sorted(map(tuple, got.collect())) == want
    assert {x[2] for x in want} == {"pair", "term"} and ("yy", "s1", "pair", "s2", 0, 1) in want
    assert sd.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    count, n, v = 10 ** 12, 4 * 10 ** 13, 10 ** 7
    want = 1 + 10 ** 9 * (count + 5) // (n + 5 * v)
    assert sd.shares(np.array([count]), np.array([n + 5 * v])).tolist() == [want]
    df = spark.createDataFrame([(count, n, v), (0, 0, 0)], "c long, n long, v long")
    assert [r[0] for r in df.select(sd.share("c", "n", "v")).collect()] == [want, None]


# --- search ------------------------------------------------------------------------

def _ranked(docs, items, top=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(d, collections.Counter(word.findall((t or "").translate(lower)))) for d, t in docs]
    n = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = word.findall((text or "").translate(lower))
        found = []
        for d, b in bags:
            size = sum(b.values())
            if size:
                m = 25 + 75 * size * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m))
                            for t in asked if b[t])
                if score > 0:
                    found.append((-score, d is None, d, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k, d, s) for k, (_, _, d, s) in enumerate(found[:top], 1)]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "ß", "x1y"]
    docs = [(i, _words(r, vocabulary, r.randint(0, 25))) for i in range(300)]
    docs += [(1000 - i, "w1 W2 w3 rare") for i in range(40)]                   # copies, ids descending
    docs += [(2000 + i, "w3, w1; w2 RARE!") for i in range(30)]                # equal bags
    docs += [(None, "w1 w2 w3 rare"), (None, None), (5, "again w5"), (5, "again w5"), (6000, "w7 " * 20_000)]
    items = [(1, "w1 w2 rare rare"), (2, "nothing here"), (3, None), (4, ""), (5, " ".join(vocabulary)), (5, "again"), (None, "Éa w7")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, item long").repartition(6)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string")
    want = _ranked(docs, items)
    assert sorted(map(tuple, ls.search(frame, asked).collect()), key=repr) == want
    monkeypatch.setattr(ls, "BLOCK_BYTES", 60)                                 # items in several blocks
    monkeypatch.setattr(ls, "KEEP", 12)
    monkeypatch.setattr(ls, "CLASS_ROWS", 7)
    assert sorted(map(tuple, ls.search(frame, asked).collect()), key=repr) == want


def test_search_of_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    got = ls.search(no_docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, "--")], "doc_id long, text string")
    assert ls.search(some, items.limit(0)).count() == 0
    assert [tuple(r) for r in ls.search(some, items).collect()] == _ranked([(1, "a b"), (2, "--")], [(1, "a")])


def test_equal_bags_are_one_class(spark):
    rows = spark.createDataFrame([(i, "b a c" if i % 2 else "A, b? c!") for i in range(50)], "doc_id long, text string")
    bags = ls.restricted_bags(rows, {b"a": 0, b"b": 1})
    assert bags.select("n", "bag").distinct().count() == 1
    assert bags.agg(F.max("n")).first()[0] == 3
