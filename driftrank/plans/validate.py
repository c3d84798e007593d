"""The error contract: what must hold after every solve and every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.config import ALPHA
from driftrank.operators.edges import differing
from driftrank.plans.power import power


def validate(state: DataFrame, weights: DataFrame, vertices: DataFrame, epsilon: float, alpha: float = ALPHA, tol: float = 1e-14) -> DataFrame:
    """``(n_vertices, n_residual_viol, n_value_viol)`` against the power iteration."""
    exact = power(weights, vertices, state.select("target").distinct(), alpha, tol=tol)
    both = state.join(exact, ["target", "id"], "full_outer")
    wrong = F.abs(F.coalesce(F.col("p"), F.lit(float("inf"))) - F.coalesce(F.col("v"), F.lit(0.0))) > epsilon
    return both.agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.count_if(F.abs("r") > epsilon).alias("n_residual_viol"),
        F.count_if(wrong).alias("n_value_viol"),
    )


def invariant(state: DataFrame, weights: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``(target, id, gap)`` of p + alpha r = sum w p(head) + alpha [target]."""
    given = weights.join(state.select("target", F.col("id").alias("dst"), "p"), "dst").select("target", F.col("src").alias("id"), (-F.col("w") * F.col("p")).alias("x"))
    own = state.select("target", "id", (F.col("p") + alpha * F.col("r") - F.when(F.col("id") == F.col("target"), alpha).otherwise(0.0)).alias("x"))
    return own.unionByName(given).groupBy("target", "id").agg(F.abs(F.sum("x")).alias("gap"))


def window_differences(rebuilt: DataFrame, merged: DataFrame) -> DataFrame:
    """``n_differences`` between the window built anew and the one kept up by updates."""
    return differing(rebuilt.select("src", "dst", "m"), merged.select("src", "dst", "m")).agg(F.count(F.lit(1)).alias("n_differences"))
