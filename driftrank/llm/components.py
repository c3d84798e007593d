"""Connected components by alternating stars, on tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; the root is the least node of its component.

    A round hangs the larger neighbours of each node on the least one (large star), then each node and its
    smaller neighbours on the least of those (small star), until nothing changes. Minima are partial aggregates; the joins with them
    are inner joins that adaptive execution splits at hubs. Each round is a table in the shared folder.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen = None
    for k in count(1):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen or not mark.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = mark
        both = now.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        now = scratch.keep(small.where("u <> v").distinct(), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
    raise AssertionError("not reached")
