"""Sharding by a k-d tree over document metadata.

A node that is to give k shards is split where its weight divides k//2 : k - k//2, along the dimension in
which it is widest (its range as a share of the whole table's), until every leaf is one shard of the target
size. All nodes of a level are split together. A cut is found by refining histograms: an aggregate of at most
BINS rows a node leaves each task, the bin that holds the cut is divided again until a boundary is within
TOLERANCE of the wanted weight, or the bin is a single place. Ties in a dimension are broken by a hash, so a value that
holds a third of all rows is divided as well; where equal rows fill more than a cut can bear, they are numbered and
divided too. The driver keeps one cut a node (as many as shards), never rows. Values of a text dimension count by their
place among all distinct values in code-point order, whatever they have in common.

Only DataFrame functions. The text is read once, for its size and CRC; everything else runs on a narrow table in
the shared folder. The law that holds is ``bytes``: sizes near equal, up to a document.

Defined results: a null text weighs 16 bytes and has the CRC of no bytes; a text of any length is one row, whose shard is
over its target by it; null metadata come first in their dimension; equal rows have places of their own where it matters;
an empty table has no shards; a table of fewer rows than shards leaves shards empty; columns that clash with the outputs
are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftrank.llm.common import Scratch, table, unsigned_crc32, utf8
from driftrank.operators.scan import with_position

ROW_BYTES = 16
BINS = 4096
TOLERANCE = 0.001  # of a shard's target, at each cut
COORDINATE_BITS, TIE_BITS = 26, 22
#: Nodes up to which a level's cuts stand in the expression, and up to which they are broadcast (5 numbers each); distinct values up to which ranks are.
LITERAL_NODES, BROADCAST_NODES, BROADCAST_VALUES = 256, 100_000, 100_000
#: Levels between two tables of the nodes; copies of a row that are numbered at once.
KEPT_LEVELS, COPIES = 2, 4096
SLOT_BLOCK = 20_000


def from_count(value: Column) -> Column:
    """A count on a logarithmic scale; null is 0."""
    scaled = F.log2(F.greatest(value, F.lit(0)).cast("double") + 2.0) * float(1 << COORDINATE_BITS - 6)
    return F.coalesce(scaled.cast("long"), F.lit(0).cast("long"))


#: The dimensions of ``documents``: how their values become coordinates, counts below 2^COORDINATE_BITS; RANK: by their place among the distinct values.
RANK = "rank"
DIMENSIONS: dict[str, object] = {"source": RANK, "lang": RANK, "n_chars": from_count}


@dataclass
class Level:
    """The cuts of one level: (node, right child, dimension, cut)."""

    cuts: list[tuple[int, int, int, int]] = field(default_factory=list)


def ranks_of(docs: DataFrame, dimensions: Mapping[str, object], scratch: Scratch) -> dict[str, DataFrame]:
    """For each text dimension ``(_value, _rank)`` of its distinct values, from 1 on."""
    found = {}
    for c, kind in dimensions.items():
        if kind == RANK:
            values = docs.select(F.col(c).cast("string").alias("_value")).where("_value is not null").distinct()
            values = scratch.keep(values, f"values-{c}")
            few = values.count() <= BROADCAST_VALUES
            placed = values.select("_value", F.row_number().over(Window.orderBy("_value")).cast("long").alias("_rank")) if few else with_position(values, ["_value"]).select("_value", (F.col("pos") + 1).alias("_rank"))
            ranks = scratch.keep(placed, f"ranks-{c}")
            found[c] = F.broadcast(ranks) if few else ranks
    return found


def coordinates(docs: DataFrame, ranks: Mapping[str, DataFrame], dimensions: Mapping[str, object] = DIMENSIONS, text: str = "text", key: str = "doc_id", keep: Column | None = None) -> DataFrame:
    """``(key, size, text_crc32, c0, c1, ..., tie)`` of every row, with ``keep`` in place of the first three where it is given."""
    body = utf8(F.col(text))
    rows = docs.select(
        F.col(key).alias("_key"),
        *([] if keep is None else [keep.alias("_kept")]),
        *(F.col(c).alias(f"_d{i}") for i, c in enumerate(dimensions)),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        unsigned_crc32(body).alias("text_crc32"),
    )
    made = []
    for i, (c, kind) in enumerate(dimensions.items()):
        if kind == RANK:
            rows = rows.join(ranks[c], F.col(f"_d{i}").cast("string") == F.col("_value"), "left").withColumn(f"_d{i}", F.coalesce("_rank", F.lit(0).cast("long"))).drop("_value", "_rank")
            made.append(F.col(f"_d{i}").alias(f"c{i}"))
        else:
            made.append(kind(F.col(f"_d{i}")).alias(f"c{i}"))
    own = [F.col("_key").alias(key), F.col("size"), F.col("text_crc32")] if keep is None else [F.col("_kept")]
    return rows.select(*own, *made, _tie("_key", "text_crc32", "size").alias("tie"))


def _tie(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << TIE_BITS)).cast("long")


def numbered(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` of ``coordinates`` in which equal ones have ties of their own."""
    own = [c for c in rows.columns if c != "tie"]
    counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    stretches = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    copies = stretches.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + COPIES) - 1)))
    return copies.select(*own, F.when(F.col("_copy") == 0, _tie(key, "text_crc32", "size")).otherwise(_tie(key, "text_crc32", "size", "_copy")).alias("tie"))


def _place(n: int, dimension: Column) -> Column:
    """A row's place along a dimension, ties included."""
    chosen = F.lit(None).cast("long")
    for i in reversed(range(n)):
        chosen = F.when(dimension == i, F.col(f"c{i}")).otherwise(chosen)
    return F.shiftleft(chosen, TIE_BITS).bitwiseOR(F.col("tie"))


def _with_table(rows: DataFrame, listed: list[tuple], schema: str, how: str = "inner") -> DataFrame:
    """``rows`` with the numbers that a list has for their nodes: from the expression itself, or by a join, broadcast up to BROADCAST_NODES."""
    columns = [x.split() for x in schema.split(", ")]
    show = lambda x: f"{x!r}D" if isinstance(x, float) else f"{x}L"
    if len(listed) <= LITERAL_NODES:
        nodes = ", ".join(show(row[0]) for row in listed)
        place = f"array_position(array({nodes}), node)"
        found = rows.withColumn("_at_node", F.expr(place))
        found = found if how == "left" else found.where("_at_node > 0")
        value = lambda k, kind: f"cast(get(array({', '.join(show(row[k]) for row in listed)}), cast(_at_node as int) - 1) as {kind})"
        return found.withColumns({name: F.expr(value(k, kind)) for k, (name, kind) in enumerate(columns) if k}).drop("_at_node")
    names = ", ".join(x[0] for x in columns)
    casts = ", ".join("cast({} as {}) as {}".format(*x, x[0]) for x in columns)
    values = ", ".join("(" + ", ".join(map(show, row)) + ")" for row in listed)
    small = rows.sparkSession.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
    return rows.join(F.broadcast(small) if len(listed) <= BROADCAST_NODES else small, "node", how)


def apply_level(rows: DataFrame, level: Level, n: int) -> DataFrame:
    """``rows`` with ``node`` moved to the child that each row falls in."""
    if not level.cuts:
        return rows
    own = [c for c in rows.columns if c != "node"]
    joined = _with_table(rows, level.cuts, "node bigint, _right bigint, _dim int, _cut bigint", "left")
    return joined.select(*own, F.when(_place(n, F.col("_dim")) >= F.col("_cut"), F.col("_right")).otherwise(F.col("node")).alias("node"))


def apply_tree(rows: DataFrame, levels: list[Level], n: int) -> DataFrame:
    """``rows`` of ``coordinates`` with ``shard``; a narrow map."""
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    for level in levels:
        rows = apply_level(rows, level, n)
    return rows.withColumn("shard", F.col("node").cast("int")).drop("node")


def _cuts(rows: DataFrame, nodes: dict[int, int], n: int, spans: list[float], target: float) -> tuple[Level, float]:
    """The cuts of all nodes that give more than one shard, and how far the worst is off, as a share of a shard."""
    ranges = rows.groupBy("node").agg(F.sum("size").alias("w"), *(f(f"c{i}").alias(f"{f.__name__}{i}") for i in range(n) for f in (F.min, F.max))).collect()
    open_: dict[int, dict] = {}
    for r in ranges:
        k = nodes.get(r.node, 1)
        if k > 1:
            widths = [(r[f"max{i}"] - r[f"min{i}"]) / spans[i] if spans[i] else 0.0 for i in range(n)]
            dim = max(range(n), key=lambda i: (widths[i], -i))
            low, high = r[f"min{dim}"] << TIE_BITS, (r[f"max{dim}"] + 1 << TIE_BITS) - 1
            open_[r.node] = {"dim": dim, "low": low, "high": high, "before": 0, "want": r.w * (k // 2) / k, "half": k // 2}
    level, worst = Level(), 0.0
    while open_:
        listed = [(node, x["dim"], x["low"], x["high"], max(1, -(-(x["high"] - x["low"] + 1) // BINS)), float(x["want"]), x["before"]) for node, x in open_.items()]
        met = _with_table(rows, listed, "node bigint, _dim int, _low bigint, _high bigint, _step bigint, _want double, _before bigint")
        met = met.withColumn("_at", _place(n, F.col("_dim"))).where("_at between _low and _high")
        bins = met.groupBy("node", F.expr("(_at - _low) div _step").alias("bin"), "_want", "_before").agg(F.sum("size").alias("w"))
        order = Window.partitionBy("node").orderBy("bin")
        sums = bins.withColumn("upto", F.sum("w").over(order) + F.col("_before"))
        # the bin in which the wanted weight is reached
        crossing = sums.where((F.col("upto") >= F.col("_want")) & (F.col("upto") - F.col("w") < F.col("_want")))
        for r in crossing.select("node", "bin", "w", "upto").collect():
            x = open_[r.node]
            step = max(1, -(-(x["high"] - x["low"] + 1) // BINS))
            start = x["low"] + r.bin * step
            below, above = x["want"] - (r.upto - r.w), r.upto - x["want"]
            if step == 1 or min(below, above) <= TOLERANCE * target:
                worst = max(worst, min(below, above) / target)
                cut = start if below < above else start + step
                level.cuts.append((r.node, r.node + x["half"], x["dim"], cut))
                del open_[r.node]
            else:
                x["low"], x["high"], x["before"] = start, min(x["high"], start + step - 1), r.upto - r.w
    return level, worst


def fit(rows: DataFrame, n: int, scratch: Scratch, num_shards: int | None = None, target_bytes: int | None = None) -> tuple[list[Level], float]:
    """The tree for so many shards, or for leaves of the target size, and how far its worst cut is off."""
    whole = rows.agg(F.sum("size").alias("w"), *(f(f"c{i}").alias(f"{f.__name__}{i}") for i in range(n) for f in (F.min, F.max))).first()
    if whole.w is None:
        return [], 0.0
    k = num_shards or max(1, -(-whole.w // target_bytes))
    spans = [float(whole[f"max{i}"] - whole[f"min{i}"]) for i in range(n)]
    nodes, levels, worst = {0: k}, [], 0.0
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    while any(x > 1 for x in nodes.values()):
        level, off = _cuts(rows, nodes, n, spans, whole.w / k)
        levels.append(level)
        worst = max(worst, off)
        rows = apply_level(rows, level, n)
        if len(levels) % KEPT_LEVELS == 0:  # or every level would work out all levels before it
            rows = scratch.keep(rows, f"nodes-{uuid.uuid4().hex}")
        split = {node for node, *_ in level.cuts}
        nodes = {child: size for node, size in nodes.items() if node in split for child, size in ((node, size // 2), (node + size // 2, size - size // 2))}
    return levels, worst


def with_slots(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard, by hash of the key.

    A shard is numbered in blocks, whose counts give the offsets, so no task sorts a whole shard.
    """
    counted = rows.groupBy("shard").count().agg(F.max("count").alias("m")).first().m or 0
    blocks = max(8, -(-counted // SLOT_BLOCK))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit("slot"), key, "text_crc32"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = Window.partitionBy("shard", "_block").orderBy(key, "text_crc32", "size")
    numbered = rows.withColumn("_here", F.row_number().over(here) - 1)
    return numbered.join(offsets, ["shard", "_block"]).withColumn("slot", (F.col("_here") + F.col("_offset")).cast("long")).drop("_block", "_here", "_offset")


@dataclass
class Tree:
    """What ``split`` needs to deal other rows alike."""

    levels: list[Level]
    ranks: Mapping[str, DataFrame]
    dimensions: Mapping[str, object]


def grow(docs: DataFrame, scratch: Scratch, num_shards: int | None = None, target_bytes: int | None = None, dimensions: Mapping[str, object] = DIMENSIONS) -> tuple[DataFrame, Tree]:
    """``coordinates`` of ``docs`` as a table, and the tree over them."""
    ranks = ranks_of(docs, dimensions, scratch)
    rows = scratch.keep(coordinates(docs, ranks, dimensions), "rows")
    levels, worst = fit(rows, len(dimensions), scratch, num_shards, target_bytes)
    if worst > TOLERANCE:  # equal rows, or a long text
        rows = scratch.keep(numbered(rows), "numbered")
        levels, _ = fit(rows, len(dimensions), scratch, num_shards, target_bytes)
    return rows, Tree(levels, ranks, dimensions)


def assign(docs: DataFrame, num_shards: int | None = None, target_bytes: int | None = None, dimensions: Mapping[str, object] = DIMENSIONS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row."""
    scratch = Scratch(docs.sparkSession, "kd")
    rows, tree = grow(docs, scratch, num_shards, target_bytes, dimensions)
    placed = scratch.keep(apply_tree(rows, tree.levels, len(dimensions)).select("doc_id", "size", "text_crc32", "shard"), "placed")
    return with_slots(placed)


def split(docs: DataFrame, tree: Tree) -> DataFrame:
    """``docs`` with ``shard`` by a fitted tree, texts and all, without a shuffle: for writing shards. Equal rows stay together."""
    own = F.struct(*(c for c in docs.columns if c != "shard"))
    rows = coordinates(docs, tree.ranks, tree.dimensions, keep=own)
    return apply_tree(rows, tree.levels, len(tree.dimensions)).select("_kept.*", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents"), num_shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
