"""Text files: edge lists, vertex lists, logs. Lines count in the order of the files' paths, then of their places in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.operators.scan import with_position

#: The order of lines: Spark deals large files in blocks, and packs blocks of any files into a task, but reads a block in order.
ORDER = ["_file", "_block", "_line"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return spark.read.text(path).select(*place, F.trim("value").alias("value"))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, src, dst)`` of text files with two ids a line; comment lines and empty ones are skipped."""
    parts = F.split("value", r"\s+")
    pairs = _lines(spark, path).where("value <> '' and not startswith(value, '#')").select(*ORDER, F.get(parts, 0).cast("long").alias("src"), F.get(parts, 1).cast("long").alias("dst"))
    return with_position(pairs, ORDER).select("pos", "src", "dst")


def write_edge_list(edges: DataFrame, path: str) -> None:
    """``src dst ts`` a line, in the order of ``ts``."""
    edges.orderBy("ts").select(F.concat_ws(" ", "src", "dst", "ts").alias("value")).write.mode("overwrite").text(path)


def read_timestamped(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst, ts)`` of files that ``write_edge_list`` has written."""
    parts = F.split("value", r"\s+")
    return _lines(spark, path).where("value <> ''").select(*(F.get(parts, k).cast("long").alias(c) for k, c in enumerate(("src", "dst", "ts"))))


def read_vertices(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """``target`` of files with an id a line, lines [start, stop) of all of them."""
    lines = with_position(_lines(spark, path).select(*ORDER, F.col("value").cast("long").alias("target")), ORDER)
    inside = F.col("pos") >= start if stop is None else (F.col("pos") >= start) & (F.col("pos") < stop)
    return lines.where(inside).select("target")


def write_vertices(vertices: DataFrame, path: str, column: str = "id") -> None:
    """An id a line, in the order that ``vertices`` has: that of a sort, if it was sorted."""
    vertices.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def log_values(spark: SparkSession, path: str, keywords: list[str]) -> DataFrame:
    """``(file, keyword, value)``: the last number after each keyword in each log."""
    found = _lines(spark, path).select(*ORDER, "value", F.explode(F.array(*map(F.lit, keywords))).alias("keyword")).select(
        *ORDER, "keyword", F.expr(r"try_cast(nullif(regexp_extract(value, concat('(?:^|\\s)', keyword, '\\s+([-+0-9.eE]+)'), 1), '') as double)").alias("number")
    )
    last = F.max_by("number", F.struct("_block", "_line"))
    return found.where("number is not null").groupBy(F.col("_file").alias("file"), "keyword").agg(last.alias("value"))
