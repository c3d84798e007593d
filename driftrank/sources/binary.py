"""Binary edge streams: ``int32 n``, then pairs of ``int32``, little-endian, in order of arrival.

Reading is a Spark data source whose partitions are byte ranges of the file, so a large file is read in
parallel and never as one value. Files are opened through ``pyarrow.fs``: local ones, HDFS, object stores; for stores that
only Spark reads, ``read_binary`` takes ``whole=True`` (one task a file). Writing encodes ranges of the stream in parallel;
the driver only passes their bytes on, into a file that Spark's file system opens wherever the path points.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER, PAIR = 4, 8
SCHEMA = "pos bigint, src bigint, dst bigint"
CHUNK_PAIRS = 1 << 18


def _opened(path: str) -> tuple:
    """The file system of a path or URL and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path.removeprefix("file://")) if path.startswith(("/", "file://")) else fs.FileSystem.from_uri(path)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, pairs: int):
        self.path, self.pairs = path, pairs

    def partitions(self) -> list[InputPartition]:
        system, path = _opened(self.path)
        total = (system.get_file_info(path).size - HEADER) // PAIR
        return [_Range(at, min(at + self.pairs, total)) for at in range(0, total, self.pairs)] or [_Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, path = _opened(self.path)
        with system.open_input_file(path) as file:
            file.seek(HEADER + PAIR * partition.start)
            at = partition.start
            while at < partition.stop:
                take = min(CHUNK_PAIRS, partition.stop - at)
                ends = np.frombuffer(file.read(take * PAIR), "<i4").reshape(-1, 2).astype(np.int64)
                columns = [np.arange(at, at + len(ends)), ends[:, 0].copy(), ends[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["pos", "src", "dst"])
                at += take


class EdgeStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edgestream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("pairs", 1 << 23)))


def read_header(spark: SparkSession, path: str) -> int:
    """The number of vertices that the file names."""
    head = spark.read.format("binaryFile").load(path).select(F.hex(F.substring("content", 1, 4)).alias("h")).first()
    return int.from_bytes(bytes.fromhex(head.h), "little")


def read_binary(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    if not whole:
        spark.dataSource.register(EdgeStreamSource)
        return spark.read.format("edgestream").load(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                ends = np.frombuffer(content, "<i4", offset=HEADER).reshape(-1, 2)
                for at in range(0, len(ends), CHUNK_PAIRS):
                    part = ends[at : at + CHUNK_PAIRS].astype(np.int64)
                    columns = [np.arange(at, at + len(part)), part[:, 0].copy(), part[:, 1].copy()]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["pos", "src", "dst"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, SCHEMA)


def write_binary(edges: DataFrame, path: str, n: int) -> None:
    """One file, in order of ``pos``. Chunks are encoded where the edges are; the driver holds one of them at a time."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.stack([batch.column(c).to_numpy() for c in ("src", "dst")], axis=1)
            if len(ends) and not 0 <= ends.min() <= ends.max() < 1 << 31:
                raise ValueError("ids must fit 31 bits")
            yield pa.RecordBatch.from_arrays([pa.array([int(batch.column("pos")[0].as_py())]), pa.array([ends.astype("<i4").tobytes()], pa.binary())], ["pos", "bytes"])

    spark = edges.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(int(n).to_bytes(HEADER, "little")))
        for row in edges.orderBy("pos").select("pos", "src", "dst").mapInArrow(encode, "pos bigint, bytes binary").toLocalIterator(prefetchPartitions=True):
            out.write(bytearray(row.bytes))
    finally:
        out.close()


def binary_name(source: str, reverse: bool = False) -> str:
    """The stream's file name: the base name up to ``.txt``, then ``.bin`` or ``_rev.bin``."""
    return os.path.basename(source).split(".txt")[0] + ("_rev.bin" if reverse else ".bin")
