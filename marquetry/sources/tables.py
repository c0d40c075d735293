"""Parquet tables by name, read with the columns a query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class MissingColumns(ValueError):
    """A table lacks columns the operator cannot do without."""


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """``folder/name.parquet``, narrowed to ``columns`` (all when none are named)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return require(df, name, columns).select(*columns) if columns else df


def require(df: DataFrame, name: str, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Refuse a source before any job runs when a mapped column is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise MissingColumns(f"{name} lacks {', '.join(absent)}")
    return df
