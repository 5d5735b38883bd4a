"""A training corpus from raw documents: quality rules, language identification, near duplicates, packing.

Each stage takes the table that the one before it wrote and returns the rows it keeps, with the columns of
``documents``; the last returns the pieces of the packed training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioground.llm import jaccard, language, packing, quality, tokens
from folioground.llm.base import staged


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the rules learned from ``labels`` keep."""
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, rules)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language.keep_known(docs, language.fit(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.75 or more."""
    return jaccard.one_of_each(docs)


def training_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    pieces = packing.pack(docs, tokens.vocabulary_path(), end=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", good_documents),
    ("language identification", known_languages),
    ("near duplicates", distinct_documents),
    ("packing", training_sequences),
]

#: The learned stages and the tokenizer have no SQL form. A test compares the near duplicates and the packing of ``run`` with
#: brute force; the two learned stages are not compared so.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
