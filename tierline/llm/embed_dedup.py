"""Near duplicates among embeddings: spherical k-means cells, blocked cosines.

1. Equal vectors of a label are collapsed to one with a multiplicity.
2. Spherical k-means, fitted on a bounded sample, gives each dimension its
   centroids; a vector's cell is its label, dimension and nearest centroid.
3. A pair across two cells is not lost: if cos(u, v) >= t, then |u - v| <=
   r = sqrt(2 - 2 t), so for u in the cell of c and v in that of d,
   v.d - v.c <= r |d - c|.  Each vector is also sent, as a guest, to those cells of
   lower number for which this holds; hosts meet hosts and guests, guests do not
   meet.  Every linked pair is met exactly once: results are exact, and the recall
   against brute force is 1 whatever the sample.
4. A cell is dealt into blocks of about ``BLOCK`` vectors; each pair of blocks is
   one group of bounded size, compared as a matrix product in double precision.
   A group returns link counts and a spanning forest of its links, never pairs.
5. Forest edges go through connected components; one vector per component stays.

The cell of a group of near copies cannot be divided by any centroid; its blocks
still spread it over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tierline.llm.components import LocalForest, connected_components
from tierline.llm.frames import stash

COSINE = 0.98
#: Vectors per cell aimed at, most cells, sample of the fit, vectors per block.
CELL, MAX_CELLS, SAMPLE, BLOCK = 4000, 1024, 20_000, 4096
ROUNDS = 8
SLACK = 1e-9          # rounding of the guest bound
STRIP = 512           # rows of a block multiplied at once


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids (at most k) of unit vectors; the same input gives the same result."""
    k = max(1, min(k, len(vectors)))
    centroids = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, vectors)
        norms = np.linalg.norm(sums, axis=1)
        live = norms > 1e-12
        centroids[live] = sums[live] / norms[live, None]
    return centroids


def fit_cells(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Centroids per dimension, from at most ``SAMPLE`` vectors in hash order.

    The number of cells follows the largest label (vectors / ``CELL``, two at least).  Only
    vectors below a cut of the hash, set from their number, leave the executors.
    """
    top = distinct.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n"))
    sizes = {r["dim"]: r["n"] for r in top.orderBy(F.col("n").desc(), "dim").limit(16).collect()}
    hashed = distinct.select("dim", "v", "node", F.xxhash64("label", "v").alias("h"))
    total = hashed.count()
    if total > 2 * SAMPLE:
        hashed = hashed.filter(F.col("h") < F.lit(int(-2 ** 63 + 2 ** 64 * (1.2 * SAMPLE / total))))
    sample = hashed.toPandas().sort_values(["h", "node"])[:SAMPLE]
    return {int(d): spherical_kmeans(unit(np.array(g["v"].tolist(), dtype=np.float64)),
                                     min(MAX_CELLS, max(2, math.ceil(sizes[d] / CELL))))
            for d, g in sample.groupby("dim") if d in sizes}


def assign(distinct: DataFrame, cells: dict[int, np.ndarray], t: float = COSINE) -> DataFrame:
    """Rows (label, dim, cell, host, node, m, v): one host row per vector and its guests."""
    radius = math.sqrt(2 - 2 * t)

    def place(batches):
        for pdf in batches:
            for dim, g in pdf.groupby("dim", sort=False):
                centroids = cells.get(int(dim))
                if centroids is None or len(centroids) == 1:
                    yield g.assign(cell=0, host=True)
                    continue
                dots = unit(np.array(g["v"].tolist(), dtype=np.float64)) @ centroids.T
                home = np.argmax(dots, axis=1)
                apart = np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2) \
                    if len(centroids) <= 64 else None
                rows, cols = [], []
                for i, h in enumerate(home):
                    if h == 0:
                        continue
                    d = apart[h, :h] if apart is not None else np.linalg.norm(centroids[:h] - centroids[h], axis=1)
                    c = np.flatnonzero(dots[i, h] - dots[i, :h] <= radius * d + SLACK)
                    rows.append(np.full(len(c), i))
                    cols.append(c)
                yield g.assign(cell=home, host=True)
                if rows:
                    yield g.iloc[np.concatenate(rows)].assign(cell=np.concatenate(cols), host=False)

    schema = f"label {dict(distinct.dtypes)['label']}, dim int, node long, m long, v array<double>, cell int, host boolean"
    return distinct.select("label", "dim", "node", "m", "v").mapInPandas(place, schema)


def _meet(pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    """Links among the vectors of one pair of blocks: counts and forest edges."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.sort_values(["block", "host"], ascending=[True, False])
    x = unit(np.array(pdf["v"].tolist(), dtype=np.float64))
    node, m = pdf["node"].to_numpy(), pdf["m"].to_numpy()
    host, block = pdf["host"].to_numpy(bool), pdf["block"].to_numpy()
    n = len(pdf)
    count = np.zeros(n, dtype=np.int64)
    forest = LocalForest(n)
    left = np.flatnonzero(block == i)
    right = np.flatnonzero(block == j)
    for at in range(0, len(left), STRIP):
        rows = left[at:at + STRIP]
        linked = x[rows] @ x[right].T >= t
        linked &= host[rows][:, None] | host[right][None, :]
        if i == j:
            linked &= rows[:, None] < right[None, :]
        if not linked.any():
            continue
        count[rows] += linked @ m[right]
        count[right] += m[rows] @ linked
        a, b = np.nonzero(linked)
        forest.join(rows[a], right[b])
    used = np.flatnonzero(count)
    return pd.DataFrame({"node": node[used], "links": count[used], "root": node[forest.root[used]]})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", t: float = COSINE) -> DataFrame:
    """Per row: vec_id, ``n_links``, ``component_id`` and ``kept``.

    Vectors link when labels are equal and not null and the cosine is at least
    ``t``; labels of any type are compared as text.  Null, empty or zero vectors, vectors with a null or non-finite
    component and those without a label link with nothing: n_links 0, a component
    of their own.  Vectors of different length do not link.  Repeated rows are
    vectors each (they link).  component_id is the smallest id of the component;
    rows without id take no part in that choice.  Empty input: empty output.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) \
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        & F.exists("v", lambda x: x != 0.0)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    # scaled by a power of two: exact, and no square under- or overflows
    peak = F.array_max(F.transform("v", F.abs))
    scale = F.pow(F.lit(2.0), F.least(F.greatest(F.floor(F.log2(peak)), F.lit(-1074)), F.lit(1023)))
    # bound as a lambda variable, the scale is computed once per vector, not once per component
    valid = rows.filter("ok").withColumn("v", F.get(F.transform(
        F.array(scale), lambda s: F.transform("v", lambda x: x / s)), 0))
    distinct = stash(
        valid.groupBy("label", "v").agg(F.count("*").alias("m"), F.min("vec_id").alias("first"))
        .withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    cells = fit_cells(distinct)
    placed = stash(assign(distinct, cells, t), "vector-cells")

    key = ["label", "dim", "cell"]
    blocks = placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    dealt = placed.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(
        F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    met = dealt.select(*key, "host", "node", "m", "v", "block", F.explode(pairs).alias("p")) \
        .select(*key, "host", "node", "m", "v", "block", "p.i", "p.j") \
        .groupBy(*key, "i", "j").applyInPandas(lambda pdf: _meet(pdf, t), "node long, links long, root long")
    met = stash(met, "vector-links")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_node = distinct.join(links, "node", "left").join(roots, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    smallest = of_node.groupBy("root").agg(F.min("first").alias("component"))
    of_node = of_node.join(smallest, "root").select(
        "label", "v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    linked = valid.join(of_node, ["label", "v"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def embedding_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Contract query over all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


#: All rows in SQL: fine at test size only.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND list_sum(list_transform(e, lambda x: x * x)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(low.c, v.vec_id) AS component_id,
       v.vec_id = coalesce(low.c, v.vec_id) AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN low ON v.vec_id = low.a
"""
