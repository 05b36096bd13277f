"""From documents to packed training sequences: five stages, each one of the llm operators.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns
of documents. Each is written as Parquet and read again as the next one's documents. Nulls,
empty and repeated texts, empty tables and extra columns are as the operators define them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lanternfold.llm import exact_dedup, jaccard, mixing, packing, quality
from lanternfold.llm.common import stage, table

TOKENIZER = "word_bpe_49k.json"


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays."""
    return jaccard.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to twice; every document stays at least once."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length with their ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", accept_quality),
    ("exact dedup", drop_copies),
    ("near duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A fitted classifier and set similarity over all pairs have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        frame = stage(function(spark, frame, sf_dir), f"stage-{name.replace(' ', '-')}")
    return frame
