"""Shared pieces of the text operators: table access, scratch tables, word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.storage import shared_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a worker turns into one batch of output; bytes that Spark sends a worker at once, at most.
BATCH_BYTES, ARROW_BYTES = 4 << 20, 8 << 20
#: Shuffle files go as soon as the table that they were for is written.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def scoped(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Settings that hold for the tables written within."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bounded(spark: SparkSession) -> SparkSession:
    """``spark``, which from now on sends Python workers no more than ARROW_BYTES at once, whatever the rows; results are the same."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read more than once.

    ``keep`` writes a frame as Parquet and returns it reread, so a lost executor costs a reread
    and never a recomputation of everything before. ``drop`` deletes the tables named.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = bounded(spark)
        self.root = f"{shared_dir(spark)}/driftrank-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with scoped(self.spark, TIDY):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def unsigned_crc32(data: Column) -> Column:
    return F.crc32(data).cast("long")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with about BATCH_BYTES in ``column``, and a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        upto = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH_BYTES, side="right")))
        yield batch.slice(start, upto - start)
        start = upto


def _replaced(df: DataFrame, **new: str) -> tuple[DataFrame, str]:
    """``df`` without the columns named, and the schema of it with them at the end."""
    df = df.drop(*new)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{k}` {v}" for k, v in new.items())])
    return df, schema


def map_column(df: DataFrame, column: str, new: dict[str, str], function: Callable[[list], list[pa.Array]], keep: bool = False) -> DataFrame:
    """``df`` with ``column`` given up (unless ``keep``) for the columns of ``new`` that ``function`` makes of its values."""
    bounded(df.sparkSession)
    base = df if keep else df.withColumnRenamed(column, "_given")
    given = column if keep else "_given"
    base, schema = _replaced(base, **new)
    if not keep:
        _, schema = _replaced(base.drop("_given"), **new)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for part in batches(whole, given):
                made = function(part.column(given).to_pylist())
                kept = [(f.name, part.column(f.name)) for f in part.schema if keep or f.name != given]
                yield pa.RecordBatch.from_arrays([x for _, x in kept] + made, [n for n, _ in kept] + list(new))

    return base.mapInArrow(run, schema)
