"""URL filters by a cascade of Bloom filters.

A cascade holds a list of keys against the complete universe of keys of a corpus. Level 0 encodes the
listed keys; the unlisted keys that it lets through are encoded by level 1, the listed keys that level 1
lets through by level 2, and so on until a level lets nothing wrong through. The first level that
refuses a key decides: an even level says unlisted, an odd one listed. For keys of the universe that is
exact, and no join with the list is needed.

Building is distributed: bit positions are OR-ed per 64-bit word in a partial aggregate, wrong keys are
found by a map over the distinct keys. A filter has 12 bits for a key of what it encodes; the size of every level is
checked against MAX_BYTES before the driver takes it in and broadcasts it. Lists, or unlisted keys, too many for that are
split by key hash into as many cascades as needed, and the map then runs once for each of them.

Keys are compared as two independent 64-bit hashes. Defined results: a url that is null or has no ``://``
has empty host and path, is fitted by no rule and never listed; a url of any length is taken whole; rules of one
length cannot both fit a url, so no tie is possible; repeated rows give equal rows; empty tables and empty lists work;
columns named like the outputs are replaced, others pass through.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.llm.common import Scratch, table

BITS_PER_KEY, HASHES = 12, 8
MAX_BYTES = 64 << 20
MAX_LEVELS = 60

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(F.lit("second"), key)]


def _positions(h1: np.ndarray, h2: np.ndarray, bits: int, level: int) -> np.ndarray:
    """HASHES bit positions of each key, by rows; every level has its own, or one that lets a key through would again."""
    step = (h2.view(np.uint64) ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
    at = (h1.view(np.uint64) ^ step >> np.uint64(20))[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)
    return ((at >> np.uint64(17)) ^ at) % np.uint64(bits)


@dataclass(frozen=True)
class Cascade:
    """The bitmaps of the levels, as 64-bit words."""

    levels: tuple[np.ndarray, ...]

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        verdict = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for n, words in enumerate(self.levels):
            passed = passes(words, h1[open_], h2[open_], n)
            verdict[open_[~passed]] = n % 2 == 1
            open_ = open_[passed]
        verdict[open_] = len(self.levels) % 2 == 1
        return verdict

    @property
    def n_bytes(self) -> int:
        return sum(x.nbytes for x in self.levels)


def passes(words: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    at = _positions(h1, h2, len(words) * 64, level)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _bitmap(keys: DataFrame, n: int, level: int) -> np.ndarray:
    """The filter over ``keys(h1, h2)``, of which there are ``n``."""
    n_words = max(1, -(-n * BITS_PER_KEY // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _positions(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), n_words * 64, level).ravel()
            words, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = keys.select("h1", "h2").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(n_words, np.uint64)
    found[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return found


def _through(keys: DataFrame, words: np.ndarray, level: int) -> DataFrame:
    """The ``keys(h1, h2)`` that a filter lets through."""
    held = keys.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(held.value, batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), level)))

    return keys.select("h1", "h2").mapInArrow(run, "h1 bigint, h2 bigint")


def build(listed: DataFrame, unlisted: DataFrame, scratch: Scratch, name: str = "cascade") -> list[Cascade]:
    """Cascades over disjoint sets of distinct keys ``(h1, h2)``; key (h1, h2) belongs to that of index h2 mod their number."""
    n, others = listed.count(), unlisted.count()
    # level 0 lets about a key in 300 through, which level 1 encodes
    parts = max(1, -(-2 * max(n, others // 256) * BITS_PER_KEY // 8 // MAX_BYTES))
    while True:
        found = []
        for part in range(parts):
            mine = F.pmod("h2", F.lit(parts)) == part
            cascade = _cascade(listed.where(mine), unlisted.where(mine), scratch, f"{name}-{parts}-{part}")
            if cascade is None:
                break
            found.append(cascade)
        else:
            return found
        parts *= 2


def _cascade(inside: DataFrame, outside: DataFrame, scratch: Scratch, name: str) -> Cascade | None:
    """One cascade, or None where a level would be larger than MAX_BYTES."""
    levels: list[np.ndarray] = []
    size = inside.count()
    for level in range(MAX_LEVELS):
        if size * BITS_PER_KEY // 8 > MAX_BYTES:
            return None
        levels.append(_bitmap(inside, size, level))
        wrong = scratch.keep(_through(outside, levels[-1], level), f"{name}-{level}")
        size = wrong.count()
        if not size:
            return Cascade(tuple(levels))
        inside, outside = wrong, inside
    raise RuntimeError("a cascade over keys that are both listed and unlisted never ends")


def member(df: DataFrame, cascades: Sequence[Cascade], keys: str, out: str) -> DataFrame:
    """``df`` with ``out``: for each of its ``keys``, an array of (h1, h2), whether it is listed. ``keys`` goes."""
    total = sum(c.n_bytes for c in cascades)
    if total > MAX_BYTES and len(cascades) > 1:  # one map for each, so that no worker holds more than one
        for i, cascade in enumerate(cascades):
            df = _member(df, [cascade], len(cascades), i, keys, f"_{out}{i}", keep=True)
        either = F.transform(F.arrays_zip(*(f"_{out}{i}" for i in range(len(cascades)))), lambda x: F.greatest(*(x[f"_{out}{i}"] for i in range(len(cascades)))))
        return df.withColumn(out, either).drop(keys, *(f"_{out}{i}" for i in range(len(cascades))))
    return _member(df, cascades, len(cascades), 0, keys, out, keep=False)


def _member(df: DataFrame, cascades: Sequence[Cascade], parts: int, first: int, keys: str, out: str, keep: bool) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(tuple(cascades))
    rest = [c for c in df.columns if c != out and (keep or c != keys)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields), f"`{out}` array<boolean>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(keys)
            flat = lists.flatten()
            h1, h2 = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            belongs, verdict = h2 % parts, np.zeros(len(h1), bool)
            for i, cascade in enumerate(held.value):
                mine = belongs == first + i
                verdict[mine] = cascade.listed(h1[mine], h2[mine])
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(verdict))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), made], [*rest, out])

    return df.select(*rest, *([] if keep else [keys])).mapInArrow(run, schema)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The strings of all rules that could fit, as an array: host suffixes of the rules' label counts with path prefixes of their lengths."""
    labels = sorted({r[1].count(".") + 1 for r in rules})
    lengths = sorted({len(r[2]) for r in rules})
    made = [
        F.when((F.size(F.split(host, r"\.")) >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n in labels
        for m in lengths
    ]
    return F.array_distinct(F.array_compact(F.array(*made)))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    ``listed(key)``: keys host + path that are blocked where no rule fits. The longest rule that fits wins. Both the
    rules and the list are looked up in cascades over all the keys that the pages have.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url))
    parsed = pages.select(*own, host.alias("host"), path.alias("path"))
    strings = candidates(F.col("host"), F.col("path"), rules)
    universe = parsed.select("host", "path").distinct().select(
        F.explode(F.concat(F.transform(strings, lambda s: F.concat(F.lit("rule "), s)), F.array(F.concat(F.lit("page "), "host", "path")))).alias("key")
    ).distinct()
    given = spark.createDataFrame([(f"rule {h}{p}",) for _, h, p in rules], "key string").unionByName(
        listed.where("key <> ''").select(F.concat(F.lit("page "), "key").alias("key"))
    ).distinct()
    h1, h2 = hashes(F.col("key"))
    both = universe.select("key", F.lit(0).alias("l")).unionByName(given.select("key", F.lit(1).alias("l"))).groupBy("key").agg(F.max("l").alias("l"))
    keys = scratch.keep(both.select(h1.alias("h1"), h2.alias("h2"), "l"), "keys")
    cascades = build(keys.where("l = 1").select("h1", "h2"), keys.where("l = 0").select("h1", "h2"), scratch)

    pair = lambda s: F.struct(*(h.alias(f"h{i}") for i, h in enumerate(hashes(s), 1)))
    asked = F.concat(F.array(F.concat(F.lit("page "), "host", "path")), F.transform("_strings", lambda s: F.concat(F.lit("rule "), s)))
    looked = parsed.withColumn("_strings", strings).withColumn("_keys", F.transform(asked, pair))
    found = member(looked, cascades, "_keys", "_in")
    fits = F.filter("_strings", lambda s, i: F.get("_in", i + 1))
    best = F.aggregate(fits, F.lit(""), lambda a, s: F.when(F.length(s) > F.length(a), s).otherwise(a))
    verdicts = F.create_map(*(F.lit(x) for v, h, p in rules for x in (h + p, v)))
    found = found.withColumn("_best", best)
    return found.select(
        *own,
        "host",
        "path",
        F.when(F.col("_best") != "", F.col("_best")).alias("rule"),
        F.when(F.col("_best") != "", F.element_at(verdicts, F.col("_best"))).when(F.get("_in", F.lit(0)), "block").otherwise("allow").alias("verdict"),
    )


def stand_in_list(pages: DataFrame) -> DataFrame:
    """The tables hold no list of urls, so the query's list is the keys whose MD5 begins with 0, a sixteenth of them."""
    host, path = host_and_path(F.col("url"))
    key = F.concat(host, path)
    return pages.select(key.alias("key")).where(F.md5("key").startswith("0")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, stand_in_list(pages)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT DISTINCT host, path FROM b),
f AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
      FROM m JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2)
SELECT page_id, b.host, b.path, f.rule,
       coalesce(f.verdict, CASE WHEN b.host || b.path <> '' AND md5(b.host || b.path)[1] = '0' THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN f ON b.host = f.host AND b.path = f.path
"""
