"""Times, latencies and throughputs of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHASES = ("maintain", "repair", "push")
COUNTERS = ("target_count", "k", "rounds_pos", "rounds_neg")
SCHEMA = "batch bigint, target_count bigint, k bigint, rounds_pos int, rounds_neg int, maintain_ms double, repair_ms double, push_ms double, ppr_ms double"


def metrics_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A row a batch; ``ppr_ms`` is repair and push."""
    return spark.createDataFrame(rows, SCHEMA)


def summary(metrics: DataFrame) -> DataFrame:
    """``ppr_latency`` in ms a batch and ``ppr_throughput`` in edges a second; window maintenance and deletes do not count."""
    return metrics.agg(
        F.count(F.lit(1)).alias("batches"),
        (F.sum("ppr_ms") / F.count(F.lit(1))).alias("ppr_latency"),
        (F.sum("k") * 1000.0 / F.sum("ppr_ms")).alias("ppr_throughput"),
        F.avg("maintain_ms").alias("maintain_latency"),
    )


def profile(metrics: DataFrame) -> DataFrame:
    """``(name, batches, total, mean, most)`` of every phase, in ms, and of every counter."""
    named = [F.struct(F.lit(p).alias("name"), F.col(f"{p}_ms").alias("x")) for p in PHASES] + [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in COUNTERS]
    return metrics.select(F.inline(F.array(*named))).groupBy("name").agg(F.count("x").alias("batches"), F.sum("x").alias("total"), F.avg("x").alias("mean"), F.max("x").alias("most"))


def mean_by(runs: DataFrame, *config: str, value: str = "value") -> DataFrame:
    """The mean over target vertices for each configuration."""
    return runs.groupBy(*config).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
