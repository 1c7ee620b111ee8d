"""The corpus pipeline: five text operators, each on what its predecessor kept."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lynceus.llm import decontamination, exact_dedup, jaccard_join, language_id, packing
from lynceus.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Chunks that a packing task keeps in mind: fewer than op4 has, for the executors' heaps are full after the stages before.
REMEMBERED = 100_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that are ``und`` (no letter, no text) go."""
    profiles = language_id.train_profiles(docs.where("lang is null or lang <> 'und'"))
    if not profiles:  # nothing to tell languages by: texts with letters stay all the same
        profiles = {"unknown": np.zeros(language_id.DIMENSIONS, np.float32)}
    return language_id.predict_language(docs, profiles).where("lang_pred <> 'und'").select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.exact_dedup(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard_join.near_dedup(docs).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens, each with its ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, remembered=REMEMBERED)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

#: Packing needs the tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
