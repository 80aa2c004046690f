"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chosen_path, containment, grace, importance, jpeg, language, pieces, run_index, style_tree, toxicity, turn_trie, url_cascade
from .steps import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.url_digest(table(spark, sf_dir, "pages"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.page_digest(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digest(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_digest(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_digest(jpeg.media(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_digest(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.repeat_digest(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace.copies_digest(table(spark, sf_dir, "documents"))


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampling_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_url_filter, op2_html_text, op3_toxicity, op4_pieces, op5_token_counts, op6_near_dedup, op7_media, op8_decontamination, op9_language, op10_suffix_dedup, op11_exact_dedup, op12_turn_trie, op13_importance_resampling)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_cascade.url_sql(), "op11_exact_dedup": grace.copies_sql(), "op12_turn_trie": turn_trie.trie_sql(), "op13_importance_resampling": importance.resampling_sql()}
