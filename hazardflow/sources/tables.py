"""Training tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardflow import schemas
from hazardflow.functions.decisions import sequence_valid


def read_training_events(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Ten feature columns, severity and id; Parquet is preferred, CSV files need a header.

    CSV columns are found by name in any order. A field that is no number is null; a missing column is an error.
    """
    if fmt != "csv":
        return spark.read.schema(schemas.TRAINING_EVENT).format(fmt).load(path)
    texts = spark.read.option("header", "true").csv(path)
    return texts.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schemas.TRAINING_EVENT])


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of 24 x 15 readings with a label, from Parquet; other shapes are marked by ``valid``."""
    rows = spark.read.schema(schemas.SEQUENCE).parquet(path)
    return rows.withColumn("valid", sequence_valid(F.col("seq")))
