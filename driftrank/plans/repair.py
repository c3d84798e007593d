"""Residual repair: one aggregate for a whole batch of updates, in whatever order they came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.config import ALPHA
from driftrank.functions import repaired_residual


def batch_delta(state: DataFrame, updates: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``(target, id, change, deleted, mass)`` for every tail of an update."""
    heads = updates.join(state.select("target", F.col("id").alias("dst"), "p"), "dst")
    return heads.groupBy("target", F.col("src").alias("id")).agg(
        F.sum("sign").alias("change"),
        F.sum(F.when(F.col("sign") < 0, 1).otherwise(0)).alias("deleted"),
        ((1.0 - alpha) * F.sum(F.col("sign") * F.col("p"))).alias("mass"),
    )


def sparse_repair(state: DataFrame, updates: DataFrame, degree: DataFrame, targets: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``repair`` of a state whose missing rows are 0; ``targets`` and ``updates`` are a user's list and a batch."""
    asked = updates.select("src", "dst", "sign").crossJoin(F.broadcast(targets.select("target")))
    heads = asked.join(state.select("target", F.col("id").alias("dst"), "p"), ["target", "dst"], "left")
    delta = heads.groupBy("target", F.col("src").alias("id")).agg(F.sum("sign").alias("change"), ((1.0 - alpha) * F.sum(F.col("sign") * F.coalesce("p", F.lit(0.0)))).alias("mass"))
    joined = state.join(delta.join(degree.select("id", "d"), "id"), ["target", "id"], "full_outer")
    p, r = (F.coalesce(c, F.lit(0.0)) for c in ("p", "r"))
    fixed = repaired_residual(p, r, F.col("d"), F.col("change"), F.col("mass"), F.col("id") == F.col("target"), alpha)
    out = joined.select("target", "id", p.alias("p"), F.when(F.col("change").isNull(), r).otherwise(fixed).alias("r"))
    return out.where("p <> 0 or r <> 0")


def degree_before(degree_after: DataFrame, updates: DataFrame) -> DataFrame:
    """Degrees ahead of a batch, from those behind it."""
    undone = updates.select(F.col("src").alias("id"), (-F.col("sign")).cast("long").alias("d"))
    return degree_after.select("id", F.col("d").cast("long").alias("d")).unionByName(undone).groupBy("id").agg(F.sum("d").alias("d"))


def repair(state: DataFrame, updates: DataFrame, degree: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The state whose residuals fit the graph after ``updates``; ``degree`` is that before them."""
    delta = batch_delta(state, updates, alpha).join(degree.select("id", "d"), "id")
    fixed = repaired_residual(F.col("p"), F.col("r"), F.col("d"), F.col("change"), F.col("mass"), F.col("id") == F.col("target"), alpha)
    joined = state.join(delta, ["target", "id"], "left")
    return joined.select("target", "id", "p", F.when(F.col("change").isNull(), F.col("r")).otherwise(fixed).alias("r"))
