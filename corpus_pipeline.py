"""The corpus pipeline: quality rules, near-duplicates, repeats, source mixing, encoding.

Each stage takes all that the one before it kept, as a table in the shared folder, and its decisions take effect: rows
go, texts shrink, the mixture takes words as often as it draws them. All stages but the last return the columns of
``documents``; the last returns ids, counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftrank.llm import near_dedup, prefix_bpe, quality_rules, source_mix, suffix_family
from driftrank.llm.common import Scratch, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_dedup", near_dedup.stage),
    ("suffix_dedup", suffix_family.stage),
    ("source_mix", source_mix.stage),
    ("byte_bpe", prefix_bpe.stage),
]

#: The mixture's draws, and ids by a vocabulary file, are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
