"""From raw documents to packed sequences: quality classifier, quality rules, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardflow.llm import host_rules, near_dup, packing, quality_classifier
from hazardflow.llm.storage import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, predicts to be good."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose host is not rejected."""
    return host_rules.kept_documents(docs)


# Similarity of near duplicates, in hundredths.
SIMILAR = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.one_of_each(docs, percent=SIMILAR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [("quality", quality), ("rules", rules), ("near_duplicates", near_duplicates), ("packing", pack)]

# SQL cannot train the classifier; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
