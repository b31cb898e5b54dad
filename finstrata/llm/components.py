"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.llm.common import written


def _with_least(pairs: DataFrame) -> DataFrame:
    """``u, v, m``: m is the least neighbour of u. The minimum is combined before the shuffle, and the join back may be split where u is hot."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of *edges* (``a, b``; longs): root is the least node that links lead to.

    Alternating large and small stars: each round hangs a node's larger, then its smaller neighbours on its least one,
    until nothing changes and each component is a star. Rounds grow with the logarithm of a component's length. Each
    round's edges are written to the shared folder. Loops and repeated edges don't matter; null ends are left out.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = written(e, "edges"), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _with_least(large)
        hung = F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(
            F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = written(small.select(F.explode(hung).alias("x")).select("x.u", "x.v").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least row linked to each of *n* rows by pairs (a, b) and by an earlier result *root*."""
    root = np.arange(n) if root is None else root
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]
