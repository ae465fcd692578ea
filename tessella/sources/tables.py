"""Readers for the named Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, read by Spark so that any of its file systems will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
