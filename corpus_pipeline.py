"""A pipeline over a corpus: each stage reads what the one before it has written.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``sf_dir`` gives the
labels that the toxicity stage learns from; nothing else is read but ``docs``.

Defined cases: a null or empty text fails the quality rules; a null doc_id is kept and stays null; rows of one doc_id are
rows of their own, and of equal texts one row stays whatever their ids; a null source is the host ''; texts of any length
are taken whole; without labels nothing is toxic; no documents give no pieces; other columns, whatever their names, stay
until the last stage, which has its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from batchwright.llm import exact_dedup, near_dedup, packing, quality, toxicity
from batchwright.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that are too frequent on their host."""
    return quality.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_ordinary(docs, toxicity.train(docs, labels, ~toxicity.held_out()))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    return exact_dedup.keep_first_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("packing", packed)]

#: SQL can't express rolling hashes, compression, Bayesian pruning or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
