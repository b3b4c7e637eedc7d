"""Corpus pipeline: documents to packed training sequences.

Quality classifier, exact deduplication, near deduplication and best-fit packing, each
over everything its predecessor kept.  All stages but the last return the columns of
``documents``; the last returns the pieces of the kept documents with their place.

Null and empty texts go through every stage like others: the classifier decides on them,
equal ones collapse to one, and one that stays is packed as its end id alone.  Extra
columns pass through untouched.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spotframe.llm import best_fit, dart_minhash, exact_dedup, quality_fm
from spotframe.session import ship_library, stage


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    ship_library(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_fm.keep_good(docs, quality_fm.fit(docs, labels))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each exact text."""
    return exact_dedup.drop_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    ship_library(spark)
    return dart_minhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    ship_library(spark)
    return best_fit.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("best_fit_packing", pack),
]

# a trained classifier, MinHash classes and a tokenizer are beyond SQL; the tests hold run()
# against a plain re-computation
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
