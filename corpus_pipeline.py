"""From documents to packed training sequences, in stages that are written one after another.

Each stage takes all that the one before kept. The first four return the columns of
documents; the last returns the pieces of packed sequences with their token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketlens import session
from marketlens.llm import exact_dedup, ngram_join, packing, quality, toxicity
from marketlens.llm.common import documents, saved

TOKENIZER = "word_bpe_49k.json"


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on the labelled rows scores below the threshold."""
    model = toxicity.fit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.keep_good(docs)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text that is equal but for the case of A to Z."""
    return exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, session.scratch_dir(spark, "digest-index")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, in the order of doc_id."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), order=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("quality rules", poor_out),
    ("exact dedup", copies_out),
    ("n-gram Jaccard join", near_copies_out),
    ("packing", packed),
]
#: The stages learn a model and compare sets of shingles, which SQL cannot say.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
