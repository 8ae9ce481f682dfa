"""Connected components of a link table, by joins over the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, release


class Forest:
    """Union-find over numbers, smallest member as root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> pa.RecordBatch:
        """Every node that is not a root, with its root."""
        nodes = list(self.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.root(n) for n in nodes], pa.int64())], names=["a", "b"])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around their smallest nodes."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
    yield forest.stars()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def roots(links: DataFrame) -> DataFrame:
    """(a, b): every linked node but the smallest of its component, with that smallest one.

    ``links`` has long columns ``a`` and ``b``.  Each round hangs all larger
    neighbours of a node on its smallest one, then all smaller ones; the rounds end
    when nothing changes, after about the logarithm of the longest path.  Minima
    combine before their shuffle, and the joins are left to skew handling.
    """
    edges = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        lowest = keep(lowest, "lowest", 2 * state[0])
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large, "large", state[0])
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")), "least", state[0])
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, keep(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges", state[0])
        release(old, lowest, large, least)
        state, before = _state(edges), state
        if state == before:
            break
    return edges


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
