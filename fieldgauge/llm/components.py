"""Connected components by alternating large and small stars, each step a join and an aggregate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.session import cut


def hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of a local forest after joining rows ``i`` and ``j``; the root of a tree is its smallest row."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _mark(edges: DataFrame) -> tuple:
    # two independent sums of hashes of the edges: the same table gives the same values
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), h(1), h(2)).first())


def _nearest(edges: DataFrame) -> DataFrame:
    """Per node the smallest node among it and its neighbours, beside each of its edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, component`` for every node of an edge, the component named by its smallest node.

    Hubs are never gathered: a star step takes a minimum per node (summed up before the shuffle) and
    joins it back. Each round is written to the shared folder. Null ends and loops are left out.
    """
    edges = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    edges = cut(edges, "edges")
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        near = _nearest(large)
        small = near.select(F.inline(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        ))).where("u > v").distinct()
        edges = cut(small, "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
