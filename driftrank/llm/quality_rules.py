"""Quality rules as a bitmask ledger.

Every rule is evaluated once over a whole text. The ledger keeps the measurements and one ``bigint``
whose bit *i* says that rule *i* failed. A policy is a versioned mask over those bits, so a new policy,
an ablation or a report is bitwise arithmetic on the ledger and never touches a text again.

Everything here is DataFrame functions: one narrow scan, no shuffle. The five-word windows of a text are
hashed into a ``bigint`` array; only a text that has a repeated window pays for the sort that finds which
words are covered.

Defined results: a null or empty text has no words, fails ``few_words`` and nothing else; texts of any
length are measured whole; repeated rows get equal rows; an empty table gives an empty ledger; columns
that clash with the ledger's own are replaced by them, other extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.llm.common import SPACE, WORD, table

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rule -> predicate of failure over the measurements. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 5 * word_chars",
    "repeated_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "short_words": "n_words >= 10 and word_chars < 2 * n_words",
    "long_words": "n_words >= 10 and word_chars > 20 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Version -> the rules it enforces. Versions are only ever added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "strict": tuple(RULES),
}
DEFAULT_POLICY = "v1"


def policy_mask(version: str, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> int:
    return sum(BIT[name] for name in policies[version])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column for each of MEASURES."""
    own = [c for c in docs.columns if c not in MEASURES and not c.startswith("_q_")]
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(
        *own,
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_q_words"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)).alias("_q_lines"),
        (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
    )
    df = df.select(
        *own,
        "n_symbols",
        "word_chars",
        F.size("_q_words").cast("long").alias("n_words"),
        F.size("_q_lines").cast("long").alias("n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_q_words", lambda w: F.xxhash64(w)).alias("_q_hash"),
    )
    h = F.col("_q_hash")
    df = df.withColumn(
        "_q_grams",
        F.when(
            F.size(h) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))),
        ),
    )
    grams = F.col("_q_grams")
    df = df.withColumn(
        "_q_sorted",
        F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    )
    rows = F.col("_q_sorted")
    same = lambda x, k: F.coalesce(F.get(rows, k)["g"] == x["g"], F.lit(False))
    df = df.withColumn("_q_at", F.sort_array(F.transform(F.filter(rows, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    at = F.col("_q_at")
    covered = F.aggregate(
        F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long")),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines")
    # Generated columns: no filter on a measurement is pushed below them, where it would work out the arrays anew for each use.
    return df.select(*own, F.inline(F.array(found)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``measure`` plus ``failed``: the bits of the rules that failed."""
    own = [c for c in docs.columns if c != "failed"]
    bits: Column = F.lit(0).cast("long")
    for name, predicate in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(predicate), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measure(docs.select(*own), text).withColumn("failed", bits)


def apply_policy(entries: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """``entries`` with ``kept``: no rule of the policy failed. Needs only the column ``failed``."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0)


def ablations(entries: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that the policy would keep without it.

    One pass with a partial aggregate on ``failed & mask`` (at most 2^rules groups leave a task), then arithmetic on those.
    """
    mask = policy_mask(version)
    groups = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[version]))
    return (
        groups.select("bits", "n", F.explode(names).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.lit(policy_mask("base")).cast("long")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"), "kept", "failed", "n_lines",
    )


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy does to the whole table."""
    return ablations(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the default policy keeps."""
    return apply_policy(ledger(docs)).where("kept").select(*docs.columns)


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
k AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS gram FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM k),
a AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d WHERE c > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM a GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN r ON w.doc_id IS NOT DISTINCT FROM r.doc_id),
f AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END
     + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END
     + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
     + CASE WHEN n_words >= 10 AND word_chars < 2 * n_words THEN 16 ELSE 0 END
     + CASE WHEN n_words >= 10 AND word_chars > 20 * n_words THEN 32 ELSE 0 END AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       (failed & 15) = 0 AS kept, failed::BIGINT AS failed, n_lines
FROM f
"""

ABLATION_SQL = (
    ORACLE_SQL.rstrip()
    .removesuffix("FROM f")
    .rpartition("SELECT doc_id")[0]
    + """, b AS (SELECT failed & 15 AS bits FROM f),
rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8))
SELECT rule, (sum(CASE WHEN bits & bit <> 0 THEN 1 ELSE 0 END))::BIGINT AS failed, (sum(CASE WHEN bits = bit THEN 1 ELSE 0 END))::BIGINT AS failed_alone,
       (sum(CASE WHEN bits = bit OR bits = 0 THEN 1 ELSE 0 END))::BIGINT AS kept_without
FROM b, rules GROUP BY rule"""
)
