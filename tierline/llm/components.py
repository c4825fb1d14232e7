"""Connected components of an edge table by alternating star steps.

Large star: every vertex hands the smallest vertex of its neighbourhood (itself
included) to its larger neighbours.  Small star: it hands the smallest neighbour
to the smaller ones and to itself.  Repeated, every component becomes a star
around its smallest vertex in a logarithmic number of rounds.  A round is two
aggregations with map-side combine and two equi-joins, so a hub is split like any
skewed join key; each round's edges are written to the shared scratch folder and
only their number, and that of the vertices not yet in a star, come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tierline.llm.frames import dealer, stash


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of ``edges`` (columns a, b of type long):
    root is the smallest vertex of the component.  Loops, repeated edges and
    either direction are fine; edges with a null end are left out; no edges give
    no rows."""
    ends = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = stash(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    deal = dealer(now.count())
    while not _stars(now, deal):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = deal(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # one row per edge: rows that repeat need no shuffle of their own
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = deal(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").filter("u <> v").distinct()
        now = stash(deal(small), "cc")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _stars(edges: DataFrame, deal) -> bool:
    """Whether every larger end of the edges (u > v) has one smaller end, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(False).alias("low")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("low")))
    of_node = deal(ends.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("low").alias("low")))
    return of_node.filter("lo < hi OR (lo IS NOT NULL AND low)").agg(F.count("*")).first()[0] == 0


class LocalForest:
    """Union-find over 0..n-1 that takes edges in arrays (used within one task)."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the ends of the edges a[i] - b[i]."""
        root = self.root
        a, b = root[a], root[b]
        while True:
            differ = a != b
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while True:                       # flatten: every vertex points at its root
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up
            a, b = root[a], root[b]
