"""Chat formatting by cumulative-snapshot collapse.

Logs often hold a conversation again and again, each time with a few turns more. Every turn gets the hash of all turns
up to it (running sums of two hashes of place, role and text, in halves that cannot overflow). A conversation goes if its
whole hash is the prefix hash of a longer one, or if an equal one has a smaller id; anti-joins leave the maximal
conversations, and only their turns are rendered, a row a turn, so a conversation of any length is never one value.

Turns are numbered and summed in blocks of BLOCK turn numbers whose counts and sums give the offsets, so one very long
conversation is dealt over many tasks. Prefixes are made distinct before the joins, so a first turn that a third of all
conversations share is one row. All of it is DataFrame functions.

Defined results: turns are ordered by turn, role, text (nulls first); a null role renders as ``unknown``, a null text as
an empty one, and either differs from the empty string when conversations are compared; turns without a conv_id form one
conversation, which is none of those with an empty id; texts and conversations of any length are rendered whole; equal rows are turns of their own; an empty table gives an empty one; extra columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftrank.llm.common import Scratch, table

BLOCK = 64
BEGIN, MIDDLE, STOP = "<|im_start|>", "\n", "<|im_end|>\n"
HALF = 0xFFFFFFFF
#: The halves of both hashes, and the block of turns without a number.
HASHES = ("lo", "hi", "lo2", "hi2")
NO_TURN = -(1 << 62)


def _offsets(blocks: DataFrame, *sums: str) -> DataFrame:
    """Running sums before each block of a conversation, and over all of it."""
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_c")
    return blocks.select("_c", "_b", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums), *(F.sum(s).over(whole).alias(f"{s}_all") for s in sums))


def rolling(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, seq, role, text, n, *HASHES)``: place from 0, length of the conversation, hashes up to here."""
    rows = turns.select("conv_id", "turn", "role", "text", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_c"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(NO_TURN)).alias("_b"))
    here = Window.partitionBy("_c", "_b").orderBy("turn", "role", "text")
    counts = _offsets(rows.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("k")), "k")
    placed = rows.withColumn("_r", F.row_number().over(here)).join(counts, ["_c", "_b"]).withColumn("seq", F.col("_r") + F.col("k_before") - 1)
    of = ["seq", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    halves = [h for x in (F.xxhash64(*of), F.xxhash64(F.lit("again"), *of)) for h in (x.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(x, 32))]
    hashed = scratch.keep(placed.select("conv_id", "_c", "_b", "seq", "role", "text", F.col("k_all").alias("n"), *(h.alias(name) for name, h in zip(HASHES, halves))), "turns")
    sums = _offsets(hashed.groupBy("_c", "_b").agg(*(F.sum(h).alias(h) for h in HASHES)), *HASHES)
    upto = Window.partitionBy("_c", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.withColumns({f"_{h}": F.sum(h).over(upto) for h in HASHES})
    return local.join(sums, ["_c", "_b"]).select("conv_id", "_c", "seq", "role", "text", "n", *((F.col(f"_{h}") + F.col(f"{h}_before")).alias(h) for h in HASHES))


def maximal(rolled: DataFrame) -> DataFrame:
    """``_c`` of the conversations that prefix no longer one, the smallest id of equal ones."""
    ends = rolled.where("seq = n - 1").select("_c", "conv_id", "n", *HASHES)
    first = ends.groupBy("n", *HASHES).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "_c")).alias("first"))
    prefixes = rolled.where("seq < n - 1").select((F.col("seq") + 1).alias("n"), *HASHES).distinct()
    return first.join(prefixes, ["n", *HASHES], "left_anti").select("first._c")


def render(rolled: DataFrame) -> DataFrame:
    """``(conv_id, seq, n_turns, role, segment, trainable)``: segments in order of seq are the conversation; replies of the assistant are trained on."""
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    segment = F.concat(F.lit(BEGIN), role, F.lit(MIDDLE), F.coalesce(F.col("text"), F.lit("")), F.lit(STOP))
    return rolled.select("conv_id", "seq", F.col("n").alias("n_turns"), role.alias("role"), segment.alias("segment"), (role == "assistant").alias("trainable"))


def collapse(turns: DataFrame) -> DataFrame:
    """The rendered turns of the maximal conversations of ``turns(conv_id, turn, role, text)``."""
    scratch = Scratch(turns.sparkSession, "chat")
    rolled = scratch.keep(rolling(turns, scratch), "rolled")
    return render(rolled.join(maximal(rolled), "_c", "left_semi"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS l FROM conversations GROUP BY 1),
k AS (SELECT l, min(conv_id) AS conv_id FROM c GROUP BY l),
m AS (SELECT conv_id, len(l) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM c d WHERE len(d.l) > len(k.l) AND d.l[1:len(k.l)] = k.l))
SELECT t.conv_id, row_number() OVER (PARTITION BY t.conv_id ORDER BY turn, role, text) - 1 AS seq, m.n AS n_turns, coalesce(role, 'unknown') AS role,
       '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS segment, coalesce(role = 'assistant', false) AS trainable
FROM conversations t JOIN m ON t.conv_id = m.conv_id
"""
