"""Connected components of an edge table, in rounds of joins and aggregations.

Each round is a large-star and a small-star step: every node links its larger neighbours, then itself
and its smaller ones, to the smallest node it knows.  A node's neighbours are reduced to their minimum
by aggregation before a join hands it back.  The minima are written first: both sides of that join are
then plain shuffles, which adaptive execution splits where a component's centre has most of the edges.
Rounds end when a round changes no edge; each is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.llm.support import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = settle(edges.groupBy("a").agg(F.min("b").alias("least")))
    moved = edges.join(least, "a")
    inner = moved.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return inner.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def connect(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, any order); the root is the smallest node reached.

    Repeated edges and edges of a node with itself or with null add nothing; no edges give no rows.
    """
    turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    now = settle(turned)
    state = _state(now)
    while state[0]:
        now = settle(_small_star(settle(_large_star(now))))
        new = _state(now)
        if new == state:
            break
        state = new
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    leaves = roots.select(F.col("a").alias("node"), "root")
    return leaves.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of an edge table: equal when a round has changed nothing."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes in memory the smallest node that the links ``a, b`` connect it to."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, low = a[apart], b[apart], np.minimum(x, y)[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], low)
        while (root[root] != root).any():
            root = root[root]
