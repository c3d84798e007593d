"""Positions and running sums over a total order, without a single task that sees all rows.

Rows are dealt by range of the order, so every partition is a stretch of it; counts or sums of the
partitions (one row each) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftrank.storage import cut


def _offsets(totals: DataFrame) -> DataFrame:
    """One row for each partition of a ranged frame: the sum before it."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_all"))


def _ranged(df: DataFrame, order: list) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # numbers from n * 2^33 on in partition n
    local, part = place.bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright(place, 33)
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", part.alias("_part"), local.alias("_local")))


def with_position(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``pos``: 0, 1, 2, ... in the given order, which should be total for a repeatable result."""
    ranged = _ranged(df.drop("pos") if "pos" in df.columns and "pos" not in order else df, order)
    offsets = _offsets(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_sum")))
    joined = ranged.join(F.broadcast(offsets), "_part")
    rest = [c for c in df.columns if c != "pos"]
    return joined.select((F.col("_before") + F.col("_local")).alias("pos"), *rest)


def prefix_scan(df: DataFrame, order: str, value: str) -> DataFrame:
    """``df`` with the running sums of ``value``: ``exclusive``, ``inclusive``, and both from the end."""
    ranged = _ranged(df, [order])
    offsets = _offsets(ranged.groupBy("_part").agg(F.sum(value).alias("_sum")))
    here = F.sum(value).over(Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    return ranged.join(F.broadcast(offsets), "_part").withColumn("inclusive", here).select(
        *df.columns,
        (F.col("inclusive") - F.col(value)).alias("exclusive"),
        "inclusive",
        (F.col("_all") - F.col("inclusive")).alias("back_exclusive"),
        (F.col("_all") - F.col("inclusive") + F.col(value)).alias("back_inclusive"),
    )
