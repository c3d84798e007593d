"""Removal of long repeats by a logarithmic family of sparse suffix arrays, kept as tables.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a smaller document, or before in
the same one). Every window of LENGTH bytes belongs to one suffix: that at the least hash among its GRAM-byte
strings, so equal windows belong to suffixes that begin alike, and about one suffix in 31 is indexed. The
windows of a suffix lie next to each other; they and their bytes are its surroundings.

A ``Family`` is a folder of levels. A batch of documents becomes a suffix array: its suffixes, dealt into buckets by key
(the hash of their first GRAM bytes) and sorted by key and surroundings. It is merge-scanned against every level:
where key and surroundings agree, the suffix is a repeat and is not indexed. Then it becomes level 0, and as long as
there are two levels of a size, a merge scan makes one of twice the size of them. Levels share their buckets, so scans
and merges are sort-merge joins without a shuffle; only a batch's own suffixes are shuffled. A family is opened again by
its folder and takes further batches. Suffixes whose key stands with other surroundings as well share perhaps some of
their windows; only for these the windows themselves are sorted and compared.

The order is that of hashes, not of bytes: it serves equality of LENGTH bytes as well, and full suffix arrays would be 8
to 16 times the input. A key with so many surroundings that it would fill an eighth of a bucket (estimated from the
documents whose hash is a multiple of SHARE; this only chooses where rows go) is dealt by key and surroundings. Each task
first settles what it has seen twice itself, so a passage that a third of all documents share sends about one suffix a
task to its bucket. Hashes are 64 bits for candidates and 128 bits for what is removed.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing by themselves; equal rows with one
doc_id, and null ids, are ordered by hash of the text after the others; texts of any length are hashed in pieces of
about BUFFER bytes; empty tables work; other columns pass through ``cleaned`` and ``stage``, those named like the outputs
of ``cleaned`` are replaced by them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from driftrank.llm.common import TIDY, Scratch, batches as sliced, n_partitions, scoped, table, utf8

LENGTH, GRAM = 100, 40
SPAN = LENGTH - GRAM + 1  # grams in a window
BUFFER = 256 << 10
#: Strings that a task remembers to have seen twice.
SEEN = 1 << 16
#: Batches that the query adds one after another; bytes of a bucket, about; bytes of an entry.
BATCHES, BUCKET_BYTES, ENTRY_BYTES = 4, 64 << 20, 34
SHARE = 64
ENTRY = "key bigint, dig bigint, doc bigint, at int, n smallint, hot boolean, done boolean"
_NAMES = ["key", "dig", "doc", "at", "n"]
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) << _U(1) | _U(1)


class _Powers:
    """Powers of the base and of its inverse, as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = max(n + 1, 2 * BUFFER)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(32)) * _U(0xD6E8FEB86659FD93)
    h = (h ^ h >> _U(29)) * _U(0xBF58476D1CE4E5B9)
    return h ^ h >> _U(32)


class Hashed:
    """Hashes of all substrings of a byte array, by differences of prefix sums."""

    def __init__(self, data: np.ndarray, seed: int):
        self.up, self.down = _Powers.upto(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_codes(seed)[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def grams(self, length: int) -> np.ndarray:
        """Of every substring of that length."""
        n = max(0, len(self.sums) - length)
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def _least_place(values: np.ndarray, span: int) -> np.ndarray:
    """Sliding minimum over ``span`` values, by doubling."""
    width = 1
    while width * 2 <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def suffixes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(key, dig, first window, windows, piece)`` of the indexed suffixes of the pieces between ``bounds``."""
    if len(data) >= 1 << 24:
        raise ValueError("places are held in 24 bits")
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    first, second = Hashed(data, 1), Hashed(data, 2)
    grams = mix(first.grams(GRAM))
    place = np.arange(len(grams), dtype=np.uint64)
    least = (_least_place(grams & ~_U(0xFFFFFF) | place, SPAN) & _U(0xFFFFFF)).astype(np.int64)[:n]
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    inside = np.arange(n) + LENGTH <= bounds[piece + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    owner = least[starts]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    at = starts[new]
    count = np.diff(np.concatenate([new, [len(starts)]]))
    anchor = owner[new]
    around = second.of(at, at + count - 1 + LENGTH)
    dig = mix(around + count.astype(np.uint64) * _U(0x632BE59BD9B4E019) + (anchor - at).astype(np.uint64) * _U(0x9FB21C651E98DF25))
    return grams[anchor], dig, at, count, piece[at]


def repeats(key: np.ndarray, dig: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which entries come after another one of the same key and surroundings."""
    later = np.zeros(len(key), bool)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    shared = np.zeros(len(key), bool)
    shared[1:] |= same
    shared[:-1] |= same
    some = order[shared]
    some = some[np.lexsort((at[some], doc[some], dig[some], key[some]))]
    later[some[1:]] = (key[some[1:]] == key[some[:-1]]) & (dig[some[1:]] == dig[some[:-1]])
    return later


class Seen:
    """The first places of strings that a task has seen twice."""

    def __init__(self) -> None:
        self.columns = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def settle(self, key: np.ndarray, dig: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which entries come after another one of this buffer, or after one that is remembered."""
        done = repeats(key, dig, doc, at)
        keys, digs, docs, ats = self.columns
        if len(keys):
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[place] == key) & (digs[place] == dig)
            done |= hit & ((docs[place] < doc) | (docs[place] == doc) & (ats[place] < at))
        again = np.isin(key, key[done]) & ~done
        if again.any():
            merged = [np.concatenate([x[again], y]) for x, y in zip((key, dig, doc, at), self.columns)]
            _, first = np.unique(merged[0], return_index=True)  # a newer place stands before an older one
            merged = [x[first] for x in merged]
            if len(first) > 2 * SEEN:
                keep = np.sort(np.argsort(first, kind="stable")[:SEEN])
                merged = [x[keep] for x in merged]
            self.columns = merged
        return done


def _batch(columns: list[np.ndarray], hot: np.ndarray, done: np.ndarray) -> pa.RecordBatch:
    """Entries; those that are settled get any key."""
    key, dig, doc, at, n = columns
    key, dig = np.where(done, (doc.astype(np.uint64) * _U(_BASE)) >> _U(48), key), np.where(done, _U(0), dig)
    arrays = [key.view(np.int64), dig.view(np.int64), doc.astype(np.int64), at.astype(np.int32), n.astype(np.int16), hot, done]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [*_NAMES, "hot", "done"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (doc, offset, bytes) of about BUFFER bytes; long texts come in pieces that share LENGTH - 1 bytes.

    A list stays below twice BUFFER and LENGTH, so memory is bounded and ``suffixes`` can hold a place in it in 24 bits.
    """
    held, size = [], 0
    for batch in batches:
        for doc, data in zip(batch.column("doc").to_pylist(), batch.column("data"), strict=True):
            raw = data.as_buffer()
            for start in range(0, max(1, len(raw) - LENGTH + 1), BUFFER):
                piece = raw[start : start + BUFFER + LENGTH - 1]
                if len(piece) >= LENGTH:
                    held.append((doc, start, piece))
                    size += len(piece)
                if size >= BUFFER:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _joined(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for _, _, p in pieces])])
    return data, bounds, np.array([d for d, _, _ in pieces], np.int64), np.array([o for _, o, _ in pieces], np.int64)


def _indexed(rows: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Suffix entries of ``(doc, data)``; ``hot``: sorted keys that are dealt by surroundings as well."""
    seen = Seen()
    for pieces in _pieces(rows):
        data, bounds, docs, offsets = _joined(pieces)
        key, dig, at, count, piece = suffixes(data, bounds)
        is_hot = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
        key = np.where(is_hot, mix(key ^ dig * _U(_BASE)), key)
        columns = [key, dig, docs[piece], at - bounds[piece] + offsets[piece], count]
        yield _batch(columns, is_hot, seen.settle(*columns[:4]))


def _windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An entry for each window that ``(doc, data, spots)`` asks for; a spot is first window * 256 + count."""
    seen = Seen()
    for batch in rows:
        held, size = [], 0
        asked_rows = zip(batch.column("doc").to_pylist(), batch.column("data"), batch.column("spots"), strict=True)
        for k, (doc, data, spots) in enumerate(asked_rows):
            raw, asked = data.as_buffer(), np.asarray(spots.values)
            asked = np.sort(asked)
            at, count = asked >> 8, asked & 255
            for part in np.array_split(np.arange(len(at)), max(1, -(-len(at) * 32 // BUFFER))):  # a long text in stretches
                starts = np.repeat(at[part], count[part]) + np.arange(count[part].sum()) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
                low, high = int(starts.min()), int(starts.max()) + LENGTH
                held.append((doc, low, raw[low:high], starts))
                size += high - low
                if size < BUFFER and (k < batch.num_rows - 1 or part[-1] < len(at) - 1):
                    continue
                data_, bounds, docs, offsets = _joined([x[:3] for x in held])
                lengths = [len(x[3]) for x in held]
                where = np.repeat(np.arange(len(held)), lengths)
                local = np.concatenate([x[3] for x in held]) - offsets[where] + bounds[where]
                key, dig = (mix(Hashed(data_, seed).of(local, local + LENGTH)) for seed in (1, 2))
                columns = [key, dig, docs[where], local - bounds[where] + offsets[where], np.ones(len(local), np.int16)]
                yield _batch(columns, np.zeros(len(local), bool), seen.settle(*columns[:4]))
                held, size = [], 0


def _later(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc, spot)`` of the windows, in order of key, dig, doc and place, that come after an equal one, and of the settled."""
    before = None
    for batch in rows:
        key, dig, doc, at = (batch.column(c).to_numpy() for c in _NAMES[:4])
        done = batch.column("done").to_numpy(zero_copy_only=False)
        later = done.copy()
        open_ = np.flatnonzero(~done)
        if len(open_):
            k, d = key[open_], dig[open_]
            same = np.zeros(len(open_), bool)
            same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
            same[0] = before == (k[0], d[0])
            later[open_] = same
            before = k[-1], d[-1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array((at[later].astype(np.int64) << 8) + 1)], ["doc", "spot"])


SPOT = "shiftleft(cast(at as bigint), 8) + n as spot"
#: Tables that are bucketed by key are joined by key and surroundings as they lie.
AS_THEY_LIE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


class Family:
    """The levels in a folder: tables ``(key, dig, doc, at, n, hot, done)``, bucketed and sorted, that have each (key, dig) once but for done rows.

    The file ``levels.json`` names the tables that count, with their levels. It is replaced after a new table is whole and
    before an old one goes, so a family that broke off is opened as it was after its last whole step. Batches come in the
    order of doc.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 0, hot: list[int] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.exists(self._path(f"{self.root}/levels.json")):
            held = json.loads(spark.read.text(f"{self.root}/levels.json", wholetext=True).first().value)
            self.buckets, self.hot, self.levels = held["buckets"], held["hot"], [(k, name) for k, name in held["levels"]]
            for _, name in self.levels:
                self._register(name)
        else:
            self.buckets, self.hot, self.levels = buckets or n_partitions(spark), sorted(hot or []), []
            self._save()

    def _save(self) -> None:
        out = self._fs.create(self._path(f"{self.root}/levels.json"), True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "hot": self.hot, "levels": self.levels}).encode()))
        out.close()

    def _register(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet CLUSTERED BY (key) SORTED BY (key, dig) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")

    def _write(self, df: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        with scoped(self.spark, TIDY | AS_THEY_LIE):
            df.select(*_NAMES, "hot", "done").write.bucketBy(self.buckets, "key").sortBy("key", "dig").option("compression", "zstd").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _open(self, name: str) -> DataFrame:
        return self.spark.table(name).where("not done")

    def _replace(self, old: list[tuple[int, str]], new: tuple[int, str] | None) -> None:
        self.levels = sorted([x for x in self.levels if x not in old] + ([new] if new else []))
        self._save()
        for _, name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _merge(self, a: tuple[int, str], b: tuple[int, str]) -> None:
        """Two levels in one, by a merge scan; they have no (key, dig) in common."""
        left, right = (self._open(name).select("key", "dig", F.struct("doc", "at", "n", "hot").alias(side)) for (_, name), side in ((a, "l"), (b, "r")))
        both = left.join(right, ["key", "dig"], "full_outer").select("key", "dig", F.coalesce("l", "r").alias("x"))
        name = self._write(both.select("key", "dig", "x.*", F.lit(False).alias("done")))
        self._replace([a, b], (max(a[0], b[0]) + 1, name))

    def add(self, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """Take in ``docs(doc, data)``; returns the repeats that this shows, ``(doc, spot)``."""
        held = self.spark.sparkContext.broadcast(np.array(self.hot, np.int64).view(np.uint64))
        entries = docs.mapInArrow(lambda rows: _indexed(rows, held.value), ENTRY).repartition(self.buckets, "key")
        place = Window.partitionBy("key", "dig").orderBy("doc", "at")
        run = entries.withColumn("done", F.col("done") | (F.row_number().over(place) > 1))
        for _, level in self.levels:  # the merge scans
            known = self._open(level).select("key", "dig", F.lit(True).alias("known"))
            run = run.join(known, ["key", "dig"], "left").withColumn("done", F.col("done") | F.col("known").isNotNull()).drop("known")
        name = self._write(run)
        found = scratch.keep(self.spark.table(name).where("done").selectExpr("doc", SPOT), f"found-{uuid.uuid4().hex}")
        self._replace([], (0, name))
        while pair := next(((a, b) for a, b in zip(self.levels, self.levels[1:]) if a[0] == b[0]), None):
            self._merge(*pair)
        return found

    def undecided(self) -> DataFrame:
        """``(doc, spot)`` of the suffixes whose key stands with several surroundings; makes one level of all."""
        while len(self.levels) > 1:
            self._merge(*self.levels[:2])
        rows = self._open(self.levels[0][1])
        several = rows.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("k > 1 or hot")
        return several.selectExpr("doc", SPOT)

    def close(self, keep: bool = True) -> None:
        """Forget the tables, which stay in the folder; with ``keep=False`` delete them."""
        if not keep:
            self._replace(self.levels, None)
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _spots(rows: DataFrame) -> DataFrame:
    """The spots of each document; no more than it has windows."""
    return rows.groupBy("doc").agg(F.collect_list("spot").alias("spots"))


def hot_keys(docs: DataFrame, buckets: int, rows: int) -> list[int]:
    """Keys with so many surroundings that they would fill an eighth of a bucket, estimated from a share of the documents."""
    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(SHARE)) == 0)
    seen = some.mapInArrow(lambda x: _indexed(x, np.zeros(0, np.uint64)), ENTRY).where("not done").groupBy("key").agg(F.count_distinct("dig").alias("k"))
    return sorted(r.key for r in seen.where(F.col("k") * SHARE > max(SHARE, rows // (8 * buckets))).select("key").collect())


def covered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc, spot)``: windows of ``docs(doc, data)`` that also start earlier; ``doc`` is unique and gives the order."""
    spark = docs.sparkSession
    cuts = [k / BATCHES for k in range(1, BATCHES)]
    facts = docs.agg(F.sum(F.octet_length("data")).alias("size"), F.percentile_approx("doc", cuts).alias("cuts")).first()
    rows = (facts["size"] or 0) // 31
    buckets = min(100_000, max(n_partitions(spark), -(-rows * ENTRY_BYTES // BUCKET_BYTES)))
    family = Family(spark, scratch.path("family"), buckets, hot_keys(docs, buckets, rows))
    edges = [None, *sorted(set(facts.cuts or [])), None]
    found = []
    for low, high in zip(edges, edges[1:]):
        part = docs if low is None else docs.where(F.col("doc") > low)
        found.append(family.add(part if high is None else part.where(F.col("doc") <= high), scratch))
    undecided = scratch.keep(_spots(family.undecided()), "undecided")
    family.close(keep=False)
    asked = docs.join(undecided, "doc").select("doc", "data", "spots")
    count = F.aggregate("spots", F.lit(0).cast("long"), lambda total, x: total + x.bitwiseAND(F.lit(255)))
    windows = undecided.agg(F.sum(count).alias("n")).first().n or 0
    tasks = max(n_partitions(spark), -(-windows * ENTRY_BYTES // BUCKET_BYTES))
    ordered = asked.mapInArrow(_windows, ENTRY).repartition(tasks, "key").sortWithinPartitions(*_NAMES[:4])
    second = scratch.keep(ordered.mapInArrow(_later, "doc bigint, spot bigint"), "windows")
    scratch.drop("undecided", "family")
    for part in found:
        second = second.unionByName(part)
    return second


def kept_bytes(data: bytes, spots: np.ndarray | None) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the runs they form."""
    if spots is None or not len(spots):
        return data, 0, 0
    edges = np.zeros(len(data) + 1, np.int32)
    at, count = spots >> 8, spots & 255
    np.add.at(edges, at, 1)
    np.add.at(edges, at + count - 1 + LENGTH, -1)
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _with_unique_ids(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``docs`` with ``_doc``: the doc_id where ids are unique and set, else a position by id and text, equal rows alike; whether rows may share it."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if odd.isEmpty():
        return docs.withColumn("_doc", F.col("doc_id")), False
    marks = docs.select("doc_id", F.xxhash64(utf8(F.col("text"))).alias("_h")).distinct()
    ordered = marks.repartitionByRange(F.asc_nulls_last("doc_id"), "_h").sortWithinPartitions(F.asc_nulls_last("doc_id"), "_h")
    numbered = scratch.keep(ordered.withColumn("_doc", F.monotonically_increasing_id()), "ids")
    known = numbered.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g"), "_doc")
    joined = docs.withColumn("_h", F.xxhash64(utf8(F.col("text")))).join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")))
    return joined.drop("_h", "_id", "_g"), True


def cleaned(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (the bytes left), ``n_bytes, n_removed, n_spans``.

    ``as_text``: the text itself is replaced by what is left, without characters that a cut goes through.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    own = [c for c in docs.columns if c != "text" and (as_text or c not in new)]
    held = docs.select("doc_id", F.struct(*own).alias("row"), "text")
    rows, shared = _with_unique_ids(held, scratch)
    distinct = rows.select(F.col("_doc").alias("doc"), utf8(F.col("text")).alias("data"))
    if shared:
        distinct = scratch.keep(distinct.dropDuplicates(["doc"]), "distinct")
    found = _spots(covered(distinct, scratch)).select(F.col("doc").alias("_doc"), "spots")
    joined = rows.select("_doc", "row", utf8(F.col("text")).alias("data")).join(found, "_doc", "left").select("row", "data", "spots")

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in arrived:
            for part in sliced(whole, "data"):
                made = [kept_bytes(d.as_py(), np.asarray(s.values) if s.is_valid else None) + (len(d.as_buffer()),) for d, s in zip(part.column("data"), part.column("spots"), strict=True)]
                kept = pa.array([m[0].decode("utf-8", "ignore") for m in made], pa.string()) if as_text else pa.array([m[0] for m in made], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), kept, *(pa.array([m[k] for m in made], pa.int64()) for k in (3, 1, 2))], ["row", *new])

    kinds = [StringType() if as_text else BinaryType(), LongType(), LongType(), LongType()]
    out = joined.mapInArrow(run, StructType([held.schema["row"], *(StructField(k, kind) for k, kind in zip(new, kinds))]))
    return out if as_text else out.select("row.*", *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their repeats, with all their columns. A document of which nothing is left is dropped."""
    rows = cleaned(docs, as_text=True).where("n_removed = 0 or kept <> ''")
    return rows.select(*(F.col("kept").alias(c) if c == "text" else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))
