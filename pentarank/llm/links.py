"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pentarank.llm.common import cut


def forest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Smallest index reachable from each of ``size`` nodes over the edges ``left - right``."""
    root = np.arange(size)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge; ``root`` is the component's smallest.

    ``edges`` has two long columns ``a, b``; direction, repeats, loops and NULLs do not
    matter. Each round points nodes at the smallest neighbour: large-star moves the larger
    neighbours of a node, small-star the smaller ones. Rounds are written to the shared
    checkpoint folder. A node with very many neighbours only meets a join whose inputs are
    plain exchanges, which adaptive execution splits; minima are summed up before they move.
    """
    pairs = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    )
    current = cut(pairs.distinct())
    seen = _signature(current)
    while seen[0]:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        lowest = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = cut(
            both.join(lowest, "u")
            .filter("v > u and v <> m")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        lowest = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = (
            large.join(lowest, "hi")
            .select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e"))
            .select(F.col("e.hi").alias("hi"), F.col("e.m").alias("lo"))
            .filter("hi <> lo")
            .distinct()
        )
        current = cut(small)
        now = _signature(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
