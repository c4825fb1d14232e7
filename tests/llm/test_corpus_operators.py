"""Near duplicates, mixing, WARC, quality rules and the pipeline against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tierline.llm import embed_dedup, jaccard_join as jj, mixing, quality_adaptive as qa, warc
from tierline.llm.components import LocalForest, connected_components
from tierline.llm.frames import word_count
from tierline.llm.shingles import shingle_sets
from tierline.session import scratch_path

from llm_helpers import SF_SMALL


class Union:
    def __init__(self):
        self.up = {}

    def top(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


# --- components --------------------------------------------------------------------

def test_components_equal_union_find(spark):
    r = random.Random(0)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] \
        + [(5000, 5000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["root"] for x in connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    u = Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {n: u.top(n) for n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    forest = LocalForest(300)
    forest.join(np.array([a for a, _ in edges[:220]]), np.array([b for _, b in edges[:220]]))
    v = Union()
    for a, b in edges[:220]:
        v.join(a, b)
    assert [int(x) for x in forest.root] == [v.top(i) for i in range(300)]


# --- embeddings --------------------------------------------------------------------

def _vector_truth(rows):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    u, links = Union(), collections.Counter()
    for a, b in itertools.combinations(ok, 2):
        va, vb = np.array(rows[a][1], float), np.array(rows[b][1], float)
        if rows[a][2] == rows[b][2] and len(va) == len(vb) and \
                va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.98:
            links[a] += 1
            links[b] += 1
            u.join(a, b)
    low = {}
    for i, (vid, _, _) in enumerate(rows):
        low[u.top(i)] = min(low.get(u.top(i), vid), vid)
    return sorted((vid, links[i], low[u.top(i)], vid == low[u.top(i)]) for i, (vid, _, _) in enumerate(rows))


@pytest.mark.parametrize("cell, block", [(4000, 4096), (20, 16)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "STRIP", 8)
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for _ in range(60):                                   # groups of near copies of all kinds of closeness
        base = rng.normal(size=8)
        for _ in range(rng.integers(1, 6)):
            rows.append((n, (base + rng.normal(size=8) * rng.choice([0, 0.02, 0.1, 0.25])).tolist(), int(rng.integers(0, 2))))
            n += 1
    chain = [[math.cos(i * 0.15), math.sin(i * 0.15)] + [0.0] * 6 for i in range(20)]     # cos(0.15) > 0.98 > cos(0.3)
    rows += [(n + i, v, 0) for i, v in enumerate(chain)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [1.0, None] + [0.0] * 6, 0), (n + 3, [float("nan")] * 8, 0),
             (n + 4, [float("inf")] + [1.0] * 7, 0), (n + 5, rows[0][1], None), (n + 6, [], 0), (n + 7, [1.0, 0.0], 0),
             (n + 8, [2.0, 0.0], 0), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int") \
        .withColumns({c: F.lit(1) for c in ("node", "m", "v", "dim", "cell")})
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(df).collect())
    want = _vector_truth([(a, v, lab) for a, v, lab in rows])
    assert got == want
    assert embed_dedup.near_duplicates(df.filter("false")).count() == 0


def test_near_vectors_of_extreme_length_and_any_label(spark, monkeypatch):
    """Finite vectors whose squares under- or overflow link by direction like others."""
    monkeypatch.setattr(embed_dedup, "SAMPLE", 3)
    rows = [(0, "a b", [1e-170, 0.0]), (1, "a b", [1e-170, 0.0]), (2, "a b", [1e200, 0.0]), (3, "a b", [0.0, 1.7e308]),
            (4, "a b", [0.0, 5e-324]), (5, "a b", [3.0, 0.001]), (6, "A", [1.0, 0.0]), (7, str(2 ** 40), [1.0, 1.0]),
            (8, str(2 ** 40), [2.0, 2.0]), (9, "a b", [0.0, -0.0]), (10, None, [1.0, 0.0]), (11, "a b", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 5: (3, 0), 3: (1, 3), 4: (1, 3), 6: (0, 6), 7: (1, 7), 8: (1, 7),
                   9: (0, 9), 10: (0, 10), 11: (0, 11)}
    longs = spark.createDataFrame([(7, 2 ** 40, [1.0, 1.0]), (8, 2 ** 40, [2.0, 2.0])],
                                  "vec_id long, label long, embedding array<double>")
    assert sorted(r["n_links"] for r in embed_dedup.near_duplicates(longs).collect()) == [1, 1]


def test_cells_are_fitted_at_every_size(spark):
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(rng.normal(size=(40, 6)))]
    df = spark.createDataFrame(rows, "node long, v array<double>, label int") \
        .withColumn("dim", F.size("v")).withColumn("m", F.lit(1).cast("long"))
    cells = embed_dedup.fit_cells(df)
    assert len(cells[6]) == 2 and embed_dedup.fit_cells(df.filter("false")) == {}
    homes = embed_dedup.assign(df, cells).filter("host").groupBy("cell").count().collect()
    assert sorted(r["cell"] for r in homes) == [0, 1] and sum(r["count"] for r in homes) == 40


# --- Jaccard join ------------------------------------------------------------------

def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _set(t, k):
    w = _words(t)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def _join_truth(rows, k, num, den):
    sets = [_set(t, k) for _, t in rows]
    u = Union()
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            u.join(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[u.top(i)] = min(low.get(u.top(i), d), d)
    return sorted(((d, len(sets[i]), low.get(u.top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def _family_texts():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    boiler = " ".join(r.choice(vocab) for _ in range(60))
    rows, n = [], 0
    for size in (1, 2, 4, 5, 9, 10, 12, 19, 25, 40, 80, 200):
        for _ in range(3):
            base = [r.choice(vocab) for _ in range(size)]
            for _ in range(r.randint(1, 5)):
                w = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                    w[r.randrange(len(w))] = r.choice(vocab)
                if r.random() < 0.2:
                    w = w + [r.choice(vocab)]
                rows.append((n, " ".join(w) if r.random() < 0.9 else " ".join(w).upper()))
                n += 1
    for i in range(40):                                   # unrelated texts sharing a long passage
        rows.append((n + i, boiler + " " + " ".join(r.choice(vocab) for _ in range(r.randint(3, 200)))))
    n = len(rows)
    hub = [r.choice(vocab) for _ in range(120)]           # a large group of near copies, not all linked directly
    for i in range(60):
        w = list(hub)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(120)] = f"x{r.randrange(5)}"
        rows.append((n + i, " ".join(w)))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "A\x0bb C"), (n + 4, "a B c"), (n + 5, "one"), (n + 6, "ONE"),
             (0, rows[0][1]), (n + 7, " ".join(f"z{i}" for i in range(6000))), (n + 8, " ".join(f"z{i}" for i in range(6001)))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, num, small_blocks", [(3, 90, False), (5, 80, False), (3, 80, True)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, k, num, small_blocks):
    if small_blocks:
        for name, v in (("FREQUENT", 4), ("LIST_BLOCK", 8), ("LEADERS", 1), ("CLUSTER_MEMBERS", 300), ("PAIR_SLICE", 50),
                        ("SMALL_ROWS", 3)):
            monkeypatch.setattr(jj, name, v)
    rows = _family_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5) \
        .withColumns({c: F.lit(1) for c in ("sid", "digest", "n", "root", "member", "rep", "g")})
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.linked_documents(df, k, num, 100).collect()),
                 key=repr)
    assert got == _join_truth(rows, k, num, 100)


def _near_copies(m):
    """Edits of one text, about half of the pairs linked at 0.8; and m // 20 farther ones."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(m):
        w = list(base)
        for at in r.sample(range(300), r.randint(2, 5) if i % 20 else 9):
            w[at] = f"e{i}x{at}"
        rows.append((i, " ".join(w)))
    return rows


def test_candidates_of_near_copies_grow_with_their_number(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    plain = jj._met

    def counted(*args):
        for batch in plain(*args):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(jj, "_met", counted)
    count = []
    for m in (40, 160):
        rows, before = _near_copies(m), made.value
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.linked_documents(df, 5, 80, 100).collect())
        assert got == sorted(_join_truth(rows, 5, 80, 100))
        count.append(made.value - before)
    assert 0 < count[1] < 7 * count[0], count


def test_closest_of_another_component_is_named():
    maps = [jj.parity_bitmap(np.arange(n, n + 100, dtype=np.int64) << 20) for n in (0, 1, 2, 4, 5)]
    rows = pa.table({"member": [7] * 5, "i": [0] * 5, "j": [0] * 5, "block": [0] * 5, "sid": [10, 11, 12, 13, 14],
                     "n": [100] * 5, "pos": [0] * 5, "comp": [1, 2, 1, 1, 3], "bitmap": maps})
    pairs = lambda **kw: sorted((a, b) for x in jj._met(rows, 80, 100, None, **kw)
                                for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist()))
    assert pairs(closest=True) == [(10, 11), (13, 14)]
    assert pairs() == [(10, 11), (10, 14), (11, 12), (11, 13), (11, 14), (12, 14), (13, 14)]


def _tasks_of(spark, group, work):
    """Tasks of all stages that ``work()`` ran."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_components_of_few_edges_take_few_tasks(spark):
    """A small graph's rounds do not start a task for each of many shuffle partitions."""
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    r.shuffle(edges)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(edges, "a long, b long").repartition(3)
        got = []
        tasks = _tasks_of(spark, "few-edges", lambda: got.extend(connected_components(df).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
    assert {x["node"]: x["root"] for x in got} == want and len(got) == len(want)
    assert tasks < 1500, tasks


def test_jaccard_of_odd_documents(spark, clashing, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.linked_documents(clashing, 3, 90, 100).collect()),
                 key=repr)
    want = _join_truth(rows, 3, 90, 100)
    assert got == want
    assert jj.linked_documents(no_docs, 3, 90, 100).count() == 0


def test_one_document_of_each_group_stays(spark, clashing, no_docs):
    kept = jj.keep_representatives(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in kept.collect())
    # 1 twice and 2 are one group; texts without words stay; ids that repeat or are missing are told apart by text
    assert ids == sorted([("1", "The c"), ("3", ""), ("4", ""), ("5", " \t\n "), ("6", "Der H"), ("7", "word0"), ("8", "12 34"),
                          ("None", "no id"), ("None", ""), ("9", "xxxxx"), ("9", "other"), ("10", "a b"), ("12", "  pas")])
    assert jj.keep_representatives(no_docs).count() == 0


def test_subset_sizes_and_boundary():
    for num, den in ((90, 100), (80, 100)):
        for n in range(1, 20):
            for b in range(n, 2 * n):
                c = jj.overlap(n, b, num, den)
                if c <= n and den * n >= num * b:
                    assert c in jj.subset_sizes(n, num, den) and c in jj.subset_sizes(b, num, den)
    few = {n: 10 for n in range(1, 25)}
    assert jj.choose_boundary(few, 1.0, 90, 100) <= jj.choose_boundary(few, 1000.0, 90, 100) <= jj.MAX_LIGHT
    assert jj.choose_boundary({}, 1.0, 90, 100) == 0


def test_shingle_hashes_keep_set_sizes():
    r = random.Random(1)
    ts = ["".join(r.choice("aAbBé \n\t\x0b\x1c\x85x") for _ in range(r.randint(0, 40))) for _ in range(600)] + [None, "", " "]
    for k in (3, 5):
        got, want = list(shingle_sets(ts, k)), [_set(t, k) for t in ts]
        assert [len(g) for g in got] == [len(w) for w in want]
        for i, j in itertools.combinations(range(0, len(ts), 7), 2):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


# --- mixing ------------------------------------------------------------------------

def _mix_truth(sizes):
    """Targets by resharing the excess round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
        if not open_:
            return target


def test_mix_reaches_its_targets(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "a", "a", "b", "c", "d", "é", None]), r.choice([0, 1, 5, 40, 300, None])) for i in range(3000)]
    rows += [(1, "a", 5), (1, "a", 5), (None, "b", 7), (3000, "zero", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumns({c: F.lit(9) for c in ("size", "key", "taken")})
    out = mixing.mix_sources(df, "n")
    got = out.collect()
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n or 0
    want = _mix_truth(dict(sizes))
    taken = collections.Counter()
    for x in got:
        assert 0 <= x["taken"] <= 2 * x["size"] and x["source_size"] == sizes[x["source"]]
        assert x["target"] == pytest.approx(want[x["source"]])
        taken[x["source"]] += x["taken"]
    assert len(got) == len(rows) and all(taken[s] == math.floor(want[s] + 1e-6) or abs(taken[s] - want[s]) < 1 for s in sizes)
    again = mixing.mix_sources(df.repartition(11), "n")
    assert out.select("doc_id", "taken").exceptAll(again.select("doc_id", "taken")).count() == 0
    assert mixing.mix_sources(df.filter("false"), "n").count() == 0
    assert {x["taken"] for x in mixing.mix_sources(df.withColumn("n", F.lit(0)), "n").collect()} == {0}


# --- WARC --------------------------------------------------------------------------

def test_warc_round_trip_with_segments_and_revisits(spark):
    r = random.Random(3)
    big = "".join(r.choice("aé😀\r\n\r\nWARC/1.1") for _ in range(60_000))
    rows = [(1, "http://a\r\nX: y", big, 0), (2, "u", big, 0), (3, None, None, 0), (4, "x", "short", 0), (5, "x", "short", 0),
            (None, "y", big, 0), (6, "é", "x" * 100, 0), (7, "é", "x" * 99, 0), (9, "q", "x" * 100, 0), (6, "é", "x" * 100, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = scratch_path(spark, "warc")
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path).collect()
    kinds = sorted((str(x["page_id"]), x["record_type"], str(x["refers_to"])) for x in got)
    assert kinds == sorted([("1", "response", "None"), ("2", "revisit", "1"), ("3", "response", "None"),
                            ("4", "response", "None"), ("5", "response", "None"), ("None", "revisit", "1"),
                            ("6", "response", "None"), ("6", "response", "None"), ("7", "response", "None"), ("9", "revisit", "6")])
    by_id = {p: (h or "").encode() for p, _, h, _ in rows}
    for x in got:
        if x["payload"] is not None:
            assert bytes(x["payload"]) == by_id[x["page_id"]] and x["digest"] == hashlib.sha256(x["payload"]).hexdigest()
    records = warc.read_records(spark, path).collect()
    assert max(len(x["block"]) for x in records) <= warc.SEGMENT_BYTES
    assert sum(x["type"] == "continuation" for x in records) >= 2
    empty = scratch_path(spark, "warc-empty")
    warc.write_warc(df.filter("false"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_damage_is_noticed(spark):
    block = warc._HTTP + warc.chunked(b"payload")
    assert warc.payload_of(block) == b"payload" and warc.unchunked(warc.chunked(b"")) == b""
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.archive_records(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))
    records = warc.page_records(0, 1, "u", b"z" * 200_000, "d", None, "2024-01-01T00:00:00Z")
    assert len(records) > 2 and b"WARC-Segment-Total-Length" in records[-1] and b"continuation" in records[-1]
    path = scratch_path(spark, "warc-gap")
    lost = [r for i, r in enumerate(records) if i != 1]
    spark.createDataFrame([(bytearray(x),) for x in lost], "b binary").selectExpr("CAST(b AS STRING) AS value").coalesce(1) \
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_warc(spark, path).collect()


# --- quality -----------------------------------------------------------------------

def _counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_text_counts_equal_brute_force(spark, clashing):
    r = random.Random(6)
    texts = ["".join(r.choice(["a ", "b ", "c\n", "#", "\t", "é ", "\x0b", "\x85", "a b c d e ", "a a a a a a "])
                     for _ in range(r.randint(0, 40))) for _ in range(800)] + [None, "", " ".join("abcdefgh"[i % 8] for i in range(20_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for x in qa.text_counts(df).collect():
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == \
            _counts(texts[x["doc_id"]]), texts[x["doc_id"]]
    judged = qa.judge_quality(clashing)
    assert judged.count() == clashing.count()
    for x in judged.collect():
        failed = x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"]
        assert x["base_failed"] == failed and not (failed and x["kept"])
    assert qa.judge_quality(clashing.filter("false")).count() == 0


def test_fences_follow_each_group(spark):
    def text(symbols, seed):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(10 ** 6)}" + "#" * (r.random() < symbols) * 3 for _ in range(60))
    rows = [(i, text(0.0, i), "en", "prose") for i in range(60)] + [(100 + i, text(0.9, 100 + i), "en", "code") for i in range(60)]
    rows += [(500, text(0.9, 500), "en", "prose"), (501, text(0.9, 501), "en", "code")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {x["doc_id"]: x["kept"] for x in qa.judge_quality(df).collect()}
    assert not kept[500] and kept[501] and all(kept[i] for i in range(60)) and all(kept[100 + i] for i in range(60))


def test_sketches_merge_exactly(spark):
    df = qa.rates(qa.text_counts(spark.read.parquet(f"{SF_SMALL}/documents.parquet")))
    whole = qa.sketch(df, [])
    merged = qa.merge_sketches(qa.sketch(df, ["lang", "source"]), [])
    assert whole.exceptAll(merged.select(*whole.columns)).count() == 0 == merged.select(*whole.columns).exceptAll(whole).count()


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for df in (mixing.mix_sources(docs, word_count(F.col("text"))), qa.judge_quality(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- pipeline ----------------------------------------------------------------------

def test_stages_take_effect_one_after_another(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "mixture", "bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept_df = kept, stage(spark, kept, SF_SMALL)
        path = scratch_path(spark, f"t-{name}")
        kept_df.write.parquet(path)
        kept = spark.read.parquet(path)
        old = {r["doc_id"]: r for r in before.select("doc_id", "text", "source").collect()}
        new = kept.collect()
        if name != "bpe":
            assert kept.columns == docs.columns
        if name == "language_id":
            gone = set(old) - {r["doc_id"] for r in new}
            assert all(not any(c.isalpha() for c in old[d]["text"] or "") for d in gone) and len(new) >= 0.9 * len(old)
        elif name == "near_duplicates":
            rows = [(d, r["text"]) for d, r in old.items()]
            assert sorted(r["doc_id"] for r in new) == sorted({c if c is not None else d for d, _, c in _join_truth(rows, 5, 80, 100)})
        elif name == "secret_scan":
            from tierline.llm.credential_links import base_spans
            assert {r["doc_id"] for r in new} == set(old) and all(not base_spans(r["text"]) for r in new)
            assert all(r["text"] == old[r["doc_id"]]["text"] or r["n_chars"] == len(r["text"]) for r in new)
        elif name == "mixture":
            sizes, words = collections.Counter(), collections.Counter()
            for r in old.values():
                sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
            for r in new:
                words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
                assert old[r["doc_id"]]["text"].startswith(r["text"])
            for s, target in _mix_truth(dict(sizes)).items():
                assert abs(words[s] - target) < 1.5
        else:
            assert all(r["intact"] and r["n_tokens"] == len(r["token_ids"]) for r in new) and len(new) == before.count()


def test_stages_take_odd_documents(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, SF_SMALL).count() >= 1
        assert stage(spark, no_docs, SF_SMALL).count() == 0
