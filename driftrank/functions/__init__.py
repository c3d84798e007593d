"""The algebra of push and repair, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_hot(r: Column, epsilon: float, sign: int) -> Column:
    """Whether a residual may be pushed: above epsilon (sign 1), below -epsilon (-1), or either (0); strictly."""
    if sign == 0:
        return F.abs(r) > epsilon
    return r > epsilon if sign > 0 else r < -epsilon


def transition_weight(multiplicity: Column, degree: Column, alpha: float) -> Column:
    """Share of a pushed residual that goes back along an edge; a walk also dies with probability 1 / (degree + 1)."""
    return F.lit(1.0 - alpha) * multiplicity / (degree + F.lit(1.0))


def repaired_residual(p: Column, r: Column, d: Column, change: Column, mass: Column, is_target: Column, alpha: float) -> Column:
    """The residual of a vertex after its out-edges changed, in any order.

    ``change``: net change of degree, ``mass``: (1 - alpha) times the signed sum of the heads' estimates.
    It restores p + alpha r = (1 - alpha) sum p(head) / (d + 1) + alpha [target].
    """
    own = F.when(is_target, F.lit(alpha)).otherwise(F.lit(0.0))
    return (((d + 1.0) * (p + alpha * r - own) + mass) / (d + change + 1.0) + own - p) / alpha


def arithmetic_hash(id_: Column, seed: int) -> Column:
    """A key that any engine computes alike; it stays within 63 bits for ids below 2^31."""
    return (id_ % (1 << 31) * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)
