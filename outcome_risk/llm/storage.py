"""Intermediate tables of these operators in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outcome_risk.storage import new_path, write_table

__all__ = ["new_path", "read_parts", "write_parts", "write_table"]


def write_parts(df: DataFrame, label: str, kind: str) -> str:
    """Write rows of several kinds in one job, a folder for each value of ``kind``."""
    path = new_path(df.sparkSession, label)
    df.write.partitionBy(kind).parquet(path)
    return path


def read_parts(spark: SparkSession, df: DataFrame, path: str, kind: str, value: str) -> DataFrame:
    """The rows of one kind; a kind without rows has no folder, and then the result is empty."""
    return spark.read.schema(df.schema).parquet(path).filter(f"{kind} = '{value}'").drop(kind)
