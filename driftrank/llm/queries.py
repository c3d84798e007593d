"""The registered queries of the text operators, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from driftrank.llm import quality_rules

#: Query -> the module whose ``query`` it is; ``ORACLE_SQL`` there is its SQL, if it has one.
MODULES = {
    "op1_kd_shards": "kd_shards",
    "op2_transport_stream": "transport_stream",
    "op3_source_mix": "source_mix",
    "op4_prefix_bpe": "prefix_bpe",
    "op5_near_dedup": "near_dedup",
    "op6_context_mixing": "context_mixing",
    "op7_suffix_family": "suffix_family",
    "op8_quality_ledger": "quality_rules",
    "op9_chat_snapshots": "chat_snapshots",
    "op10_url_cascade": "url_cascade",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: import_module(f"driftrank.llm.{module}").query for name, module in MODULES.items()}
    return found | {"quality_ablations": quality_rules.ablation_query}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"driftrank.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql} | {"quality_ablations": quality_rules.ABLATION_SQL}
