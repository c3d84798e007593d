"""The folder that driver and executors share, and frames kept in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session names none, and driver and executors are one process, a temporary folder is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^]]*])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="driftrank-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs a reread, not a rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, *order: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in ranges of ``order`` and sorted, so that filters and columns reach its scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftrank-table-{uuid.uuid4().hex}"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
