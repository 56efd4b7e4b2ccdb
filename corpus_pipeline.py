"""Corpus pipeline: quality classifier, SimHash near-dedup, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first
three return the columns of documents; the last returns the packed token pieces. Null texts
count as empty, and a stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import packing, quality, simhash, suffixes
from lexloom.llm.base import stage, table
from lexloom.llm.entries import byte_bpe
from lexloom.sources.staging import forget_shuffles


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones among docs."""
    forget_shuffles(spark)
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    forget_shuffles(spark)
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that start more than once."""
    forget_shuffles(spark)
    return suffixes.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 1024 tokens."""
    forget_shuffles(spark)
    return packing.pack_documents(docs, byte_bpe())


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Models, hashes and tokenizers have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
