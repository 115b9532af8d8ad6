"""From raw documents to token ids: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakeworks.llm import bpe, exact_dedup, fertility, mixing, simhash
from lakeworks.llm.common import written
from lakeworks.llm.numbering import number_as_stored
from lakeworks.queries.registry import Tables
from lakeworks.session import tune

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bands of their script."""
    tune(spark)
    return fertility.passing(docs, RANKS, PATTERN, PIECES)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    tune(spark)
    return exact_dedup.without_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    tune(spark)
    return simhash.without_near_duplicates(docs, shingle=4, most=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that keeps every source near its target weight."""
    tune(spark)
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and ``position``: its place in the mix."""
    tune(spark)
    return bpe.encode(number_as_stored(docs, ["doc_id", "text"], "position"), RANKS, PATTERN, more=["position"])


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

ORACLE_SQL = None  # SQL cannot express the fingerprints, the components or the merges


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
