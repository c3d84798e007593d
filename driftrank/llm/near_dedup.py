"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Sketch: the set of five-word shingles of each text, as 64-bit hashes; BANDS keys of ROWS minima each, and SIGNS
   bytes of single minima. Texts with equal sets are one class, and only classes are compared.
2. Candidates: classes that share a band key. Each bucket first links its members to one of them, the pivot.
3. Verification: SIGNS bytes are compared BATCH by BATCH; a pair goes as soon as the posterior probability that its
   similarity reaches the threshold (uniform prior) is below MISS. What survives is verified on the full sets.
4. The rest: a bucket of three or more whose members are not all connected by then has all its pairs between
   different components compared, in blocks of about BLOCK members and BLOCK_SHINGLES shingles, where a union-find
   skips what has become connected and a pair is looked at only in the first band it shares. Nothing is capped.
5. Components by alternating stars.

Sets are built only for classes that share a bucket. A pair at the threshold shares no band with probability
(1 - 0.75^ROWS)^BANDS = 8e-6, and is pruned with less than SIGNS / BATCH * MISS. A class is named by 64 bits of its
set's hash; a second hash tells whether two sets have one name, and then all are named anew with another seed.

Defined results: texts without words have an empty set, link with nothing and are kept; equal texts link; rows of one
doc_id are one document with several texts; rows without doc_id link with nothing, have no component and are kept;
empty tables work; a text of any length is one set, of 8 bytes a shingle in memory; ``link`` returns its four columns
only, the stage all columns of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.llm.common import BATCH_BYTES, Scratch, table, utf8
from driftrank.llm.components import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 60, 6
SIGNS, BATCH, MISS = 128, 32, 1e-7
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
SEEDS = 5
#: Ids up to which the classes whose sets are needed are broadcast (8 bytes each); beyond, a shuffle join.
BROADCAST_IDS = 500_000
SHINGLES_AT_ONCE = 100_000
_U = np.uint64
_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << _U(1) | _U(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(33)) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ h >> _U(29)) * _U(0xC4CEB9FE1A85EC53)
    return h ^ h >> _U(32)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in split])
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, (w for ws in split for w in ws)), np.uint64, int(counts.sum()))
    n = len(words)
    h = mix(words + _U(1))
    full = h[: max(0, n - SHINGLE + 1)].copy()
    for k in range(1, SHINGLE):
        full = mix(full ^ words[k : n - SHINGLE + 1 + k] + _U(k + 1))
    found, at = [], 0
    for c in counts:
        if c >= SHINGLE:
            found.append(np.unique(full[at : at + c - SHINGLE + 1]))
        elif c:
            whole = h[at]
            for k in range(1, c):
                whole = mix(np.array([whole ^ words[at + k] + _U(k + 1)]))[0]
            found.append(np.array([whole], np.uint64))
        else:
            found.append(np.zeros(0, np.uint64))
        at += c
    return found


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS * ROWS minima of each non-empty set, by rows."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    for k in range(BANDS * ROWS):
        out[k] = np.minimum.reduceat((values * _FACTORS[k] + _SHIFTS[k]) >> _U(32), starts)
    return out.T


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    keys = rows[:, :, 0]
    for k in range(1, ROWS):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + rows[:, :, k])
    return keys


def class_of(found: np.ndarray, seed: int = 0) -> int:
    """A set's class, as a signed 64-bit number."""
    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes(), seed), "big", signed=True)


def least_matches(threshold: float = PERCENT / 100, miss: float = MISS) -> dict[int, int]:
    """Hashes compared -> the fewest matches with which a pair goes on.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), whose tail above t is the
    chance of at most m successes in n + 1 trials of probability t.
    """
    found = {}
    for n in range(BATCH, SIGNS + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        found[n] = m
    return found


def survive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows of signs are not pruned, batch after batch."""
    open_ = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for n, least in least_matches().items():
        part = slice(n - BATCH, n)
        matches[open_] += (a[open_, part] == b[open_, part]).sum(axis=1)
        open_ = open_[matches[open_] >= least]
    alive = np.zeros(len(a), bool)
    alive[open_] = True
    return alive


def linked(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= PERCENT * (a + b - shared)


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    start, size, texts = 0, 0, []
    for k, x in enumerate(batch.column(column)):
        texts.append(x.as_py() or b"")
        size += len(texts[-1])
        if size >= BATCH_BYTES // 4 or k == batch.num_rows - 1:
            yield batch.slice(start, k + 1 - start), texts
            start, size, texts = k + 1, 0, []


def sketches(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``(doc_id, n, c, c2, keys, signs)`` of ``docs(doc_id, text)``: set size, class and another hash, band keys and signs, the last two packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _groups(whole, "data"):
                sets = shingle_sets(texts)
                keys, signs = [b""] * len(sets), [b""] * len(sets)
                some = [k for k, s in enumerate(sets) if len(s)]
                while some:
                    take = max(1, int(np.searchsorted(np.cumsum([len(sets[k]) for k in some]), SHINGLES_AT_ONCE)))
                    now, some = some[:take], some[take:]
                    low = minima([sets[k] for k in now])
                    packed = band_keys(low)
                    for row, k in enumerate(now):
                        keys[k], signs[k] = packed[row].tobytes(), (low[row, :SIGNS] & np.uint32(255)).astype(np.uint8).tobytes()
                numbers = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [class_of(s, seed) for s in sets], [class_of(s, seed + SEEDS) for s in sets])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n", "c", "c2", "keys", "signs"])

    return docs.select("doc_id", utf8(F.col("text")).alias("data")).mapInArrow(run, "doc_id bigint, n bigint, c bigint, c2 bigint, keys binary, signs binary")


def _memberships(classes: DataFrame) -> DataFrame:
    """``(band, key, c)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
                c = np.repeat(batch.column("c").to_numpy(), BANDS)
                band = np.tile(np.arange(BANDS, dtype=np.int16), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(keys), pa.array(c)], ["band", "key", "c"])

    return classes.select("c", "keys").mapInArrow(run, "band smallint, key bigint, c bigint")


def _pruned(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that survive the comparison of signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(s).to_pylist()), np.uint8).reshape(-1, SIGNS) for s in ("sa", "sb"))
            yield batch.filter(pa.array(survive(x, y))).select(["a", "b"])

    left, right = (signs.select(F.col("c").alias(s), F.col("signs").alias(f"s{s}")) for s in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                good.append(linked(int((large[at] == small).sum()), len(a), len(b)))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    left, right = (sets.select(F.col("c").alias(s), F.col("elements").alias(f"s{s}")) for s in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, needed: DataFrame, n_needed: int, seed: int = 0) -> DataFrame:
    """``(c, elements)`` of the classes in ``needed(c, first)``, from the text of their first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for _, texts in _groups(whole, "data"):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s, seed) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "elements"])

    ids = needed.select(F.col("first").alias("doc_id")).distinct()
    some = docs.join(F.broadcast(ids) if n_needed <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    return some.select(utf8(F.col("text")).alias("data")).mapInArrow(run, "c bigint, elements binary")


class _Union:
    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, k) for k, x in enumerate(labels)]

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def roots(self) -> np.ndarray:
        return np.array([self.root(k) for k in range(len(self.up))])


def compare_block(members: pa.Table) -> pa.Table:
    """Links ``(a, b)`` between members of different components: within a block, or between the two sides of a pair of blocks."""
    c, side = members.column("c").to_numpy(), members.column("side").to_numpy()
    band, crossing = int(members.column("band")[0].as_py()), int(members.column("i")[0].as_py()) != int(members.column("j")[0].as_py())
    order = np.argsort(c, kind="stable")
    c, side = c[order], side[order]
    pick = lambda name: [members.column(name)[int(k)].as_py() for k in order]
    signs = np.frombuffer(b"".join(pick("signs")), np.uint8).reshape(-1, SIGNS)
    keys = np.frombuffer(b"".join(pick("keys")), np.int64).reshape(-1, BANDS)
    elements = [np.frombuffer(x, np.uint64) for x in pick("elements")]
    sizes = np.array([len(x) for x in elements])
    flat, local = np.unique(np.concatenate(elements), return_inverse=True)
    offsets = np.cumsum(sizes) - sizes
    union, mark, links = _Union(pick("root")), np.zeros(len(flat), bool), []
    roots = union.roots()
    for x in range(len(c) - 1):
        y = np.arange(x + 1, len(c))
        y = y[(roots[y] != roots[x]) & ((side[y] != side[x]) | (not crossing))]
        if len(y):
            y = y[(keys[y, :band] != keys[x, :band]).all(axis=1)] if band else y
        if len(y):
            y = y[survive(np.broadcast_to(signs[x], (len(y), SIGNS)), signs[y])]
        if not len(y):
            continue
        mine = local[offsets[x] : offsets[x] + sizes[x]]
        mark[mine] = True
        shared = np.array([int(mark[local[offsets[k] : offsets[k] + sizes[k]]].sum()) for k in y])
        mark[mine] = False
        for k in y[100 * shared >= PERCENT * (sizes[x] + sizes[y] - shared)]:
            a, b = union.root(x), union.root(int(k))
            if a != b:
                union.up[max(a, b)] = min(a, b)
                links.append((int(c[x]), int(c[k])))
        roots = union.roots() if links else roots
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _rest(shared: DataFrame, comps: DataFrame, sketch: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that pivots did not show: buckets of three or more with members in different components."""
    shared = shared.where("members > 2").join(sketch.select("c", "n"), "c")
    labelled = shared.join(comps.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    labelled = scratch.keep(labelled, "labelled")
    h = F.xxhash64("c")
    by_root = labelled.groupBy("band", "key", "root").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high")
    )
    buckets = by_root.groupBy("band", "key").agg(
        F.sum("m").alias("m"), F.max("m").alias("most"), F.max_by("root", F.struct("m", "root")).alias("main"),
        F.sum("shingles").alias("shingles"), F.max_by("shingles", F.struct("m", "root")).alias("main_shingles"), F.sum("low").alias("low"), F.sum("high").alias("high")
    ).where("most < m")
    # Buckets with the same members are one, that of the first band. The members of a bucket's largest component need no
    # comparison among themselves: they are placed once for each block of the others.
    blocks = lambda m, size: F.ceil(F.greatest(m / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    kept = buckets.groupBy("m", "low", "high").agg(F.min(F.struct("band", "key", "main", "most", "shingles", "main_shingles")).alias("b")).select(
        "b.band", "b.key", "b.main", blocks(F.col("m") - F.col("b.most"), F.col("b.shingles") - F.col("b.main_shingles")).alias("few"), blocks(F.col("b.most"), F.col("b.main_shingles")).alias("many")
    )
    h = F.xxhash64(F.lit("block"), "c")
    is_main = F.col("root") == F.col("main")
    mine = labelled.join(kept, ["band", "key"]).withColumn("block", F.when(is_main, F.col("few") + F.pmod(h, F.col("many"))).otherwise(F.pmod(h, F.col("few"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(is_main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    placed = mine.select("band", "key", "c", "root", "block", F.explode(others).alias("other")).select(
        "band", "key", "c", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side")
    )
    full = placed.join(sketch.select("c", "signs", "keys"), "c").join(sets, "c")
    full = full.withColumnRenamed("keys", "ks").select("band", "key", "i", "j", "side", "c", "root", "signs", F.col("ks").alias("keys"), "elements")
    return full.groupBy("band", "key", "i", "j").applyInArrow(compare_block, "a bigint, b bigint")


def classes_linked(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, c)`` of every row, and ``(c, component_id)`` of every class with words."""
    for seed in range(SEEDS):
        sketch = scratch.keep(sketches(docs, seed), "sketch")
        every = sketch.where("n > 0 and doc_id is not null").groupBy("c").agg(
            F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.first("signs").alias("signs"), F.first("n").alias("n"), (F.min("c2") == F.max("c2")).alias("one")
        )
        classes = scratch.keep(every, "classes")
        if classes.where("not one").isEmpty():
            break
    else:
        raise RuntimeError("sets share names under every seed")
    rows = scratch.keep(sketch.select("doc_id", "n", "c"), "rows")
    scratch.drop("sketch")
    members = _memberships(classes)
    buckets = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(F.xxhash64("band", "c").alias("h"), "c")).alias("p")).where("members > 1")
    shared = scratch.keep(members.join(buckets.select("band", "key", "members", F.col("p.c").alias("pivot")), ["band", "key"]), "shared")
    ids = shared.select("c").distinct()
    needed = scratch.keep(classes.join(ids, "c", "left_semi"), "needed")
    sets = scratch.keep(_sets(docs.select("doc_id", "text"), needed, needed.count(), seed).join(ids, "c", "left_semi").dropDuplicates(["c"]), "sets")
    pairs = shared.where("c <> pivot").select(F.least("c", "pivot").alias("a"), F.greatest("c", "pivot").alias("b")).distinct()
    # rows of one document are linked whatever their texts
    same = sketch_links(rows)
    edges = scratch.keep(_verified(_pruned(pairs, needed), sets).unionByName(same), "edges")
    comps = components(edges, scratch, "pivots")
    more = scratch.keep(_rest(shared, comps, needed, sets, scratch), "more")
    comps = components(edges.unionByName(more), scratch, "all")
    scratch.drop("shared", "labelled", "needed", "sets", "edges", "more")
    rooted = classes.select("c", "first").join(comps.select(F.col("node").alias("c"), "root"), "c", "left").select("c", F.coalesce("root", "c").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, rooted.join(least, "root").select("c", "component_id")


def sketch_links(rows: DataFrame) -> DataFrame:
    """Links between the classes of rows that have one doc_id; none where ids are unique."""
    some = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("doc_id", "a")
    return rows.where("n > 0").join(some, "doc_id").where("c <> a").select("a", F.col("c").alias("b"))


def link(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs(doc_id, text)``."""
    rows, classes = classes_linked(docs, Scratch(docs.sparkSession, "near"))
    met = rows.join(classes, "c", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return met.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the first document of every component, and every row without an id."""
    found = link(docs.select("doc_id", "text"))
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
