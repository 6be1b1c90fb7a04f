"""Catalog of the training-data queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import (
    chat, divergence, edit_counts, embedding_links, exact_dedup, ngram_join, packing, piece_codec, quality, sharding,
    spelling, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        packing.op1_pack_windows, ngram_join.op2_ngram_join, quality.op3_quality_outliers, warc.op4_warc_bundles,
        chat.op5_chat_trees, sharding.op6_jump_shards, exact_dedup.op7_exact_dedup, toxicity.op8_toxicity,
        edit_counts.op9_edit_counts, piece_codec.op10_piece_codec,
        divergence.op11_source_divergence, embedding_links.op12_embedding_links, spelling.op13_spelling_variants)
}
ORACLES: dict[str, str] = {
    "op4_warc_bundles": warc.ORACLE, "op5_chat_trees": chat.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_source_divergence": divergence.ORACLE, "op12_embedding_links": embedding_links.ORACLE}
