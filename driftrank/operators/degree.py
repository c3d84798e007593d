"""Degrees, ranks by degree, and seeded choices of vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.functions import arithmetic_hash
from driftrank.operators.scan import prefix_scan, with_position


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(id, d, in_d)`` of every vertex, parallel edges counted; one aggregate over both ends and the vertices."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    zero = vertices.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"))
    return zero.unionByName(ends).groupBy("id").agg(F.sum("o").alias("d"), F.sum("i").alias("in_d"))


def out_degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    zero = vertices.select("id", F.lit(0).alias("o"))
    return zero.unionByName(edges.select(F.col("src").alias("id"), F.lit(1).alias("o"))).groupBy("id").agg(F.sum("o").alias("d"))


def row_pointers(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(id, row_ptr)`` of the sorted adjacency arrays."""
    return prefix_scan(out_degrees(edges, vertices), "id", "d").select("id", F.col("exclusive").alias("row_ptr"))


def ranked(edges: DataFrame, vertices: DataFrame, by: str = "out") -> DataFrame:
    """``(rank, id, d, in_d)``: from the highest degree, ties by id."""
    column = {"out": "d", "in": "in_d"}[by]
    return with_position(degrees(edges, vertices), [F.desc(column), F.asc("id")]).withColumnRenamed("pos", "rank")


def top_by_degree(edges: DataFrame, vertices: DataFrame, num: int, by: str = "out") -> DataFrame:
    column = {"out": "d", "in": "in_d"}[by]
    return degrees(edges, vertices).orderBy(F.desc(column), F.asc("id")).limit(num)


def choose_by_degree(edges: DataFrame, vertices: DataFrame, num: int, rank_from: int, rank_to: int, by: str = "out", seed: int = 0) -> DataFrame:
    """``num`` vertices of ranks [rank_from, rank_to) that have edges both in and out, without replacement."""
    pool = ranked(edges, vertices, by).where((F.col("rank") >= rank_from) & (F.col("rank") < rank_to) & (F.col("d") > 0) & (F.col("in_d") > 0))
    return pool.orderBy(arithmetic_hash(F.col("id"), seed), "id").limit(num)


def choose_uniform(edges: DataFrame, vertices: DataFrame, num: int, seed: int = 0) -> DataFrame:
    pool = degrees(edges, vertices).where("d > 0 and in_d > 0")
    return pool.orderBy(arithmetic_hash(F.col("id"), seed), "id").limit(num)
