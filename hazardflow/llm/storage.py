"""Intermediate tables in the folder that all executors share, and helpers around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardflow.session import shared_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    The copy cuts the lineage: a lost executor costs the tasks in flight, never the work done before.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
