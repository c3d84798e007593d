"""Power iteration: the exact vector, by fixed rounds or to a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.config import ALPHA
from driftrank.plans.push import MAX_ROUNDS, ROUNDS_PER_CUT, Edges, dealt, prepared
from driftrank.storage import cut


def _start(vertices: DataFrame, targets: DataFrame) -> DataFrame:
    return vertices.crossJoin(F.broadcast(targets)).select("target", "id", F.lit(0.0).alias("v"))


def _round(vector: DataFrame, edges: DataFrame, alpha: float, frm: str, to: str) -> DataFrame:
    """Every row keeps its place, with alpha at the target, and gives to the other ends of its edges."""
    home = F.when(F.col("id") == F.col("target"), alpha).otherwise(0.0)
    own = F.struct((-F.col("id") - 1).alias("key"), home.alias("v"))  # a key below 0 meets no edge
    gives = F.struct(F.col("id").alias("key"), F.col("v").alias("v"))
    rows = vector.select("target", "id", F.inline(F.when(F.col("v") != 0, F.array(own, gives)).otherwise(F.array(own))))
    met = rows.join(edges, F.col("key") == F.col(frm), "left").where(f"key < 0 or {to} is not null")
    own = F.col("key") < 0
    return met.groupBy("target", F.when(own, F.col("id")).otherwise(F.col(to)).alias("id")).agg(F.sum(F.when(own, F.col("v")).otherwise(F.col("w") * F.col("v"))).alias("v"))


def power(weights: DataFrame | Edges, vertices: DataFrame, targets: DataFrame, alpha: float = ALPHA, rounds: int | None = None, tol: float = 1e-14, forward: bool = False) -> DataFrame:
    """``(target, id, v)``. Backward: v(u) = sum over u -> x of w v(x) + alpha [target], the value of every
    vertex with respect to the target. Forward: walks that start at the target. Raises where the tolerance is not met."""
    edges = prepared(weights)
    by_head, (frm, to) = edges.by_head(), ("src", "dst") if forward else ("dst", "src")
    vector, n = _start(vertices, targets), 0
    while rounds is None or n < rounds:
        if n >= MAX_ROUNDS and rounds is None:
            raise RuntimeError(f"the vector still moves by more than {tol} after {n} rounds")
        vector = dealt(vector, edges)
        step = ROUNDS_PER_CUT if rounds is None else min(ROUNDS_PER_CUT, rounds - n)
        for _ in range(step):
            vector = _round(vector, by_head, alpha, frm, to)
        vector, n = cut(vector), n + step
        if rounds is None and linf(_round(vector, by_head, alpha, frm, to), vector).first().delta <= tol:
            break
    return vector


def linf(a: DataFrame, b: DataFrame) -> DataFrame:
    """``delta``: the largest absolute difference of two vectors."""
    both = a.select("target", "id", "v").unionByName(b.select("target", "id", (-F.col("v")).alias("v")))
    return both.groupBy("target", "id").agg(F.abs(F.sum("v")).alias("x")).agg(F.max("x").alias("delta"))


def deltas(weights: DataFrame | Edges, vertices: DataFrame, targets: DataFrame, rounds: int, alpha: float = ALPHA) -> DataFrame:
    """``(round, delta)``: how far each round of the backward iteration moved."""
    edges = prepared(weights)
    vector, found = dealt(_start(vertices, targets), edges), None
    for n in range(1, rounds + 1):
        after = cut(_round(vector, edges.by_head(), alpha, "dst", "src"))
        row = linf(after, vector).select(F.lit(n).alias("round"), "delta")
        vector, found = after, row if found is None else found.unionByName(row)
    return cut(found)
