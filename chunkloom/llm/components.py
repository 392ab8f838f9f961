"""Connected components: within a task by numpy, across the cluster by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


class Forest:
    """Components of ``n`` local nodes. ``root[i]`` is always the smallest node of i's component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i] for every i."""
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge of ``edges`` (a, b: long): the smallest id it is connected to.

    Each round is two aggregations with map-side combine, each joined back to the edges on a node; a node with very many
    edges makes a large partition on one side of a plain join only, which adaptive execution splits. Rounds grow with the
    logarithm of the components' diameter. Every round is cut off in the shared checkpoint folder. Null ids and loops are
    passed over; without edges the result is empty.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = _mark(e)
    while was[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u").select("u", "v", "m")
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small.where("u <> v").distinct())
        now = _mark(e)
        if now == was:
            break
        was = now
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def _mark(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = e.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")).first()
    return r["n"], r["x"], r["s"]
