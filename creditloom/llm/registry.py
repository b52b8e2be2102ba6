"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditloom.llm import (conversation_repair, decontaminate, packing, prefix_trie, quality_rules, quality_trees,
                            quotient_filter, secret_scan, setsketch, substring_dedup, token_store, toxicity, twins, virtual_slots)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _on_documents(function: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: function(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": lambda spark, d: decontaminate.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_best_fit_packing": _on_documents(packing.pack),
    "op3_quality_trees": lambda spark, d: quality_trees.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_virtual_slots": _on_documents(virtual_slots.digest),
    "op5_quality_rules": _on_documents(quality_rules.digest),
    "op6_substring_dedup": _on_documents(substring_dedup.digest),
    "op7_near_duplicates": _on_documents(setsketch.digest),
    "op8_secret_scan": _on_documents(secret_scan.digest),
    "op9_toxicity": lambda spark, d: toxicity.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_training_order": _on_documents(token_store.digest),
    "op11_quotient_filter_dedup": _on_documents(quotient_filter.digest),
    "op12_prefix_trie": lambda spark, d: prefix_trie.trie(table(spark, d, "conversations")),
    "op13_conversation_repair": lambda spark, d: conversation_repair.digest(table(spark, d, "conversations")),
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": twins.DECONTAMINATE,
    "op5_quality_rules": quality_rules.sql(),
    "op6_substring_dedup": twins.SUBSTRING_DEDUP,
    "op7_near_duplicates": twins.NEAR_DUPLICATES,
    "op11_quotient_filter_dedup": twins.EXACT_DEDUP,
    "op12_prefix_trie": twins.PREFIX_TRIE,
}
