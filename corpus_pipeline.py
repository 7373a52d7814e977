"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arrayloom.llm import exact_dedup, language_id, mixing, ngram_join, packing
from arrayloom.llm.common import read_table, shared_dir


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told: null text or text without a letter."""
    return language_id.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: rows with a doc_id first, then the longest, then the least doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard 0.8 or more; the least doc_id of each group stays."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents by rates fitted to the targets for quality domains."""
    return mixing.mixed(docs, mixing.domain_labels(read_table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of at most 2,048 tokens, with its sequence and offset; repeated documents are packed as often as they come."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the Jaccard components at this size, the fit or the genetic packing; tests/llm compare
#: the stages with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
