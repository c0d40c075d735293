"""Registration of queries written in the neutral SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquetry.plans.dialect import duck_text, spark_query, tables_of
from marquetry.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, text: str) -> Query:
    """A query over the parquet tables its text names; Catalyst prunes and pushes down as usual."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(spark_query(text), **{t: table(spark, folder, t) for t in tables_of(text)})

    run.__name__ = name
    return run


def register(texts: dict[str, str]) -> tuple[dict[str, Query], dict[str, str]]:
    """(queries, DuckDB twins) of neutral texts by name."""
    return {n: query(n, t) for n, t in texts.items()}, {n: duck_text(t) for n, t in texts.items()}
