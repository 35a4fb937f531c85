"""Connected components of a graph that no single task could hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import checkpoint


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index that each of n nodes reaches over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def stars(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; root: the smallest node of the component.

    Alternates two steps until nothing changes: each node links its larger neighbours to the smallest one, and
    each node links its smaller neighbours and itself to the smallest one. Minima are aggregated before the
    shuffle and joined back, so a node with very many neighbours is not gathered anywhere."""

    def settle(by: DataFrame, value: str) -> DataFrame:  # smallest neighbour of each node
        return by.groupBy("u").agg(F.min(value).alias("m"))

    edges = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both, "v").select("u", F.least("u", "m").alias("m"))
        edges = checkpoint(both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = settle(edges, "v")
        linked = edges.join(low.hint("merge"), "u")
        edges = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpoint(edges.filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
