"""Projections and set operations on edge tables ``(pos, src, dst)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.functions import arithmetic_hash
from driftrank.operators.scan import with_position


def encode(raw: DataFrame, reverse: bool = False, shuffle_seed: int | None = None) -> DataFrame:
    """Ids rebased to start at 0, optionally transposed and put in a seeded order; ``n`` is the size of the id range.

    The range is a one-row aggregate that every task gets.
    """
    ends = raw.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.min("id").alias("low"), (F.max("id") - F.min("id") + 1).alias("n"))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    moved = raw.crossJoin(F.broadcast(ends)).select("pos", (F.col(a) - F.col("low")).alias("src"), (F.col(b) - F.col("low")).alias("dst"), "n")
    if shuffle_seed is None:
        return moved
    keyed = moved.withColumn("_key", arithmetic_hash(F.col("pos"), shuffle_seed)).withColumnRenamed("pos", "_at")
    return with_position(keyed, ["_key", "_at"]).select("pos", "src", "dst", "n")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("pos", F.col("dst").alias("src"), F.col("src").alias("dst"))


def mirror(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; parallel edges stay, a self-loop gives two."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(*rest, F.inline(ends))


def timestamped(edges: DataFrame, directed: bool) -> DataFrame:
    """``(src, dst, ts)``: ts counts on from 0; in an undirected stream the reverse edge comes right after."""
    if directed:
        return edges.select("src", "dst", F.col("pos").alias("ts"))
    pairs = F.array(
        F.struct("src", "dst", (2 * F.col("pos")).alias("ts")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), (2 * F.col("pos") + 1).alias("ts")),
    )
    return edges.select(F.inline(pairs))


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted neighbour lists, for export. One list is as long as its vertex's degree."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def outside(edges: DataFrame, n: int) -> DataFrame:
    """Edges with an end outside 0 to n - 1; an end that is null counts."""
    inside = F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1)
    return edges.where(~F.coalesce(inside, F.lit(False)))


def multiplicities(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))


def merge_updates(weights: DataFrame, updates: DataFrame, few: bool = False) -> DataFrame:
    """Multiplicities after signed updates; edges that reach none go.

    ``few``: the updates are counted and small enough to be broadcast; then only the edges that they touch are shuffled.
    """
    held = weights.select("src", "dst", "m")
    changes = updates.groupBy("src", "dst").agg(F.sum("sign").cast("long").alias("m"))
    touched = held
    if few:
        keys = F.broadcast(changes.select("src", "dst"))
        touched = held.join(keys, ["src", "dst"], "left_semi")
    merged = touched.unionByName(changes).groupBy("src", "dst").agg(F.sum("m").alias("m")).where("m <> 0")
    return held.join(keys, ["src", "dst"], "left_anti").unionByName(merged) if few else merged


def endpoints(updates: DataFrame) -> DataFrame:
    return updates.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, as a multiset, that one of the two has more often."""
    key = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*key).withColumn("_n", F.lit(-1)))
    return both.groupBy(*key).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")
