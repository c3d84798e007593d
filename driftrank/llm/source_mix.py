"""Mixing sources to target weights.

Each source's documents, in a seeded order, are one stream of words that is packed into blocks of BLOCK words. Sources
weigh 1, 2, 3, 1, 2, 3, ... by code point; a source's share stops at LIMIT times its size and the excess goes to the
others by weight. A target is a number of slots. Every output shard draws the sources of its SHARD_SLOTS slots, which
gives it multinomial counts; the draws are without replacement (the slots of all sources in one row, which the shards take
in a pseudorandom order), so that every source gets its slots over all shards, however few they are. A source's slots
count on from shard to shard, and slot number j takes the block at place j mod n of a pseudorandom permutation of the
source's n blocks, a new one for every n slots. A source has no more than LIMIT slots a block, so no block is taken more
than LIMIT times.

Positions in a stream are sums over blocks of documents (BUCKET_ROWS rows each), so a source that holds a third of all
rows is dealt like any other. Draws and permutations depend on the seed, the shard and the source only, so reruns
agree. The table of sources (a name, a size, a weight) is counted before a task gets it; more than MAX_SOURCES are refused.

Defined results: a null or empty text has no words and is not taken; a text of any length is packed whole, into as many
blocks as it fills; a null source is a source of its own, the last; equal rows are each packed, and rows alike in id and
size stand in the order of the table; empty tables give empty tables; a source without words has a target of 0. The stage
passes all columns through; ``n_chars`` is counted anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftrank.llm.common import WORD, Scratch, batches as sliced, n_partitions, table

BLOCK, SHARD_SLOTS, LIMIT, SEED = 128, 1024, 3, 20
BUCKET_ROWS = 4096
MAX_SOURCES, BROADCAST_SOURCES = 1_000_000, 100_000
_U = np.uint64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted_targets(sources: pd.DataFrame, limit: float = LIMIT) -> pd.Series:
    """Targets of ``sources(weight, size)`` that add up to all sizes, none above ``limit`` times its size."""
    total, cap = float(sources["size"].sum()), limit * sources["size"].astype(float)
    target = pd.Series(0.0, sources.index)
    open_ = cap > 0
    full = pd.Series(False, sources.index)
    while open_.any():
        left = total - cap[full].sum()
        share = left * sources["weight"] / sources["weight"][open_].sum()
        over = open_ & (share > cap)
        if not over.any():
            target[open_] = share[open_]
            break
        full |= over
        open_ &= ~over
    target[full] = cap[full]
    return target


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(size), at ``index``: a Feistel network with cycle walking."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    low = _U((1 << half) - 1)
    keys = np.random.default_rng([seed & 0x7FFFFFFFFFFFFFFF, size]).integers(0, 1 << 63, 4, dtype=np.uint64)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> _U(half), out[todo] & low
        for key in keys:
            h = (right + key) * _U(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((h ^ h >> _U(29)) >> _U(16) & low)
        out[todo] = left << _U(half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


class Draws:
    """How many slots of each shard each source gets; over all shards source ``i`` gets ``wanted[i]``."""

    def __init__(self, wanted: np.ndarray, seed: int = SEED):
        self.ends, self.seed = np.cumsum(wanted), seed
        self.total = int(self.ends[-1])
        self.shards = -(-self.total // SHARD_SLOTS)

    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The sources that get slots of a shard, and how many."""
        mine = np.arange(shard * SHARD_SLOTS, min((shard + 1) * SHARD_SLOTS, self.total))
        return np.unique(np.searchsorted(self.ends, permuted(mine, self.total, self.seed), side="right"), return_counts=True)


def sources_of(sized: DataFrame) -> pd.DataFrame:
    """``(source, rank, weight, size, target, n_blocks, slots)`` of ``sized(source, size)``, in code-point order, null last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.asc_nulls_last("source")).limit(MAX_SOURCES + 1).toPandas()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows["rank"] = np.arange(len(rows), dtype=np.int64)
    rows["weight"] = rows["rank"] % 3 + 1
    rows["target"] = weighted_targets(rows)
    rows["n_blocks"] = -(-rows["size"] // BLOCK)
    per_block = rows["size"] / rows["n_blocks"].where(rows["n_blocks"] > 0, 1)
    slots = (rows["target"] / per_block.where(per_block > 0, 1)).round().astype(np.int64)
    rows["slots"] = np.minimum(slots, LIMIT * rows["n_blocks"])
    return rows


def positions(sized: DataFrame) -> DataFrame:
    """``sized`` with ``start``: where each row's words begin in the stream of its source (``rank``)."""
    n = sized.groupBy("rank").count().agg(F.max("count").alias("m")).first().m or 0
    buckets = max(16, -(-n // BUCKET_ROWS))
    h = F.xxhash64(F.lit(SEED), "doc_id", "size")
    rows = sized.withColumn("_h", h).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    before = Window.partitionBy("rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("rank", "_bucket").agg(F.sum("size").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    here = Window.partitionBy("rank", "_bucket").orderBy("_h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum("size").over(here), F.lit(0)))
    return inside.join(sums, ["rank", "_bucket"]).withColumn("start", F.col("_before") + F.col("_inside")).drop("_h", "_bucket", "_before", "_inside")


def slots(spark: SparkSession, sources: pd.DataFrame, scratch: Scratch) -> DataFrame:
    """``(shard, rank, j, block)``: the block that each slot of the mixture takes."""
    used = sources[sources["slots"] > 0]
    schema = "shard bigint, rank bigint, c bigint"
    if used.empty:
        return spark.createDataFrame([], "shard bigint, rank bigint, j bigint, block bigint")
    draws = Draws(used["slots"].to_numpy())
    held = spark.sparkContext.broadcast((used["rank"].to_numpy(), used["n_blocks"].to_numpy(), draws))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, _, draws = held.value
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                which, count = draws.of(shard)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), shard)), pa.array(ranks[which]), pa.array(count)], ["shard", "rank", "c"])

    drawn = scratch.keep(spark.range(draws.shards).mapInArrow(draw, schema), "draws")
    group = (F.col("shard") / 1024).cast("long")
    within = Window.partitionBy("rank", "_g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("rank").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = drawn.groupBy("rank", group.alias("_g")).agg(F.sum("c").alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    numbered = drawn.withColumn("_g", group).withColumn("_w", F.coalesce(F.sum("c").over(within), F.lit(0))).join(sums, ["rank", "_g"])
    first = numbered.select("shard", "rank", "c", (F.col("_w") + F.col("_b")).alias("first"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, blocks, _ = held.value
        for batch in batches:
            shard, rank, count, start = (batch.column(k).to_numpy() for k in range(4))
            for k in range(len(shard)):
                size = int(blocks[np.searchsorted(ranks, rank[k])])
                j = start[k] + np.arange(count[k])
                block = np.empty(len(j), np.int64)
                for epoch in np.unique(j // size):
                    mine = j // size == epoch
                    block[mine] = permuted(j[mine] % size, size, SEED * 1_000_003 + int(rank[k]) * 7 + int(epoch))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), shard[k])), pa.array(np.full(len(j), rank[k])), pa.array(j), pa.array(block)], ["shard", "rank", "j", "block"])

    # dealt by shard, or adaptive execution would put the few rows of all shards into one task
    return first.repartition(min(draws.shards, n_partitions(spark)), "shard").mapInArrow(take, "shard bigint, rank bigint, j bigint, block bigint")


def pieces(placed: DataFrame) -> DataFrame:
    """``(rank, block, doc_id, row, skip, words)``: the words of each document that lie in each block, from its word ``skip`` on."""
    last = (F.col("start") + F.col("size") - 1) / BLOCK
    every = placed.where("size > 0").select("rank", "doc_id", "row", "start", "size", F.explode(F.sequence((F.col("start") / BLOCK).cast("long"), last.cast("long"))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * BLOCK)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return every.select("rank", "block", "doc_id", "row", (low - F.col("start")).alias("skip"), (high - low).alias("words"))


def mixture(held: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    """For ``held(row, doc_id, source, text)``: the rows ``(doc_id, row, rank, size)``, the pieces taken with how often (``times``), the sources."""
    spark = held.sparkSession
    sized = scratch.keep(held.select("doc_id", "source", n_words(F.col("text")).alias("size"), "row"), "sized")
    sources = sources_of(sized)
    names = spark.createDataFrame(pa.table({"_source": pa.array(sources["source"], pa.string(), from_pandas=True), "rank": pa.array(sources["rank"], pa.int64())}))
    ranked = sized.join(F.broadcast(names) if len(sources) <= BROADCAST_SOURCES else names, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "row", "rank", "size")
    taken = slots(spark, sources, scratch).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    return ranked, pieces(positions(ranked)).join(taken, ["rank", "block"]), sources


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    rows, taken, sources = mixture(docs, scratch)
    words = taken.select("doc_id", "row", "rank", (F.col("words") * F.col("times")).alias("taken"), F.lit(0).cast("long").alias("size"))
    every = words.unionByName(rows.withColumn("taken", F.lit(0).cast("long")))
    summed = every.groupBy("doc_id", "row", "rank").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    facts = spark.createDataFrame(pa.table({"rank": pa.array(sources["rank"], pa.int64()), "source_size": pa.array(sources["size"], pa.int64()), "target": pa.array(sources["target"], pa.float64())}))
    return summed.join(F.broadcast(facts) if len(sources) <= BROADCAST_SOURCES else facts, "rank").select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document that the mixture takes, with the words taken, as often as they are, and all its columns."""
    scratch = Scratch(spark, "mixed")
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("rest")
    held = scratch.keep(docs.select("doc_id", "source", "text", rest, F.monotonically_increasing_id().alias("row")), "docs")
    _, taken, _ = mixture(held, scratch)
    spans = taken.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("skip", "words", "times"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                texts = [take_words(text or "", [(s["skip"], s["words"], s["times"]) for s in spans]) for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], ["rest", "text"])

    out = held.join(spans, "row").select("rest", "text", "spans").mapInArrow(run, StructType([held.schema["rest"], held.schema["text"]]))
    return out.select(*("text" if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`") for c in docs.columns))


def take_words(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The words of each span (first word, words, times), with the white space between them; spans that follow on each other stay together in each round."""
    words = [m.span() for m in re.finditer(WORD, text)]
    rounds = []
    for turn in range(max((t for _, _, t in spans), default=0)):
        parts, run = [], None
        for skip, count, times in spans:
            if times <= turn:
                continue
            if run and run[1] == skip:
                run[1] = skip + count
            else:
                run = [skip, skip + count]
                parts.append(run)
        rounds += [text[words[a][0] : words[b - 1][1]] for a, b in parts]
    return "\n".join(rounds)
