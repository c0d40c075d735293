"""Problems 1 and 6: keys that hold most rows, and nested payloads as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.operators.json_flatten import Child, flatten
from marquetry.operators.tree_aggregate import tree_aggregate
from marquetry.sources.tables import table

#: A key is reported as hot from this share of its table's rows.
HOT_KEY_SHARE = 0.01

PAYLOAD_CHILDREN = [
    Child("show", "person_castcredits", "show", "column", within="_embedded"),
    Child("recording", "release", "recording", "media", within="media"),
    Child("section", "audiobook", "sections", "owner"),
]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of credit.person and ext_id.value that hold at least 1 % of all rows of their table."""
    sources = {"credit.person": table(spark, folder, "credit", "person").select(F.col("person").cast("string").alias("hot_key")), "ext_id.value": table(spark, folder, "ext_id", "value").select(F.col("value").alias("hot_key"))}
    parts = []
    for field, rows in sources.items():
        counts = tree_aggregate(rows, ["hot_key"], {"n": ("count", "*")})
        size = rows.agg(F.count(F.lit(1)).alias("size"))  # one row, from the files' footers
        big = counts.crossJoin(F.broadcast(size)).where((F.col("n") >= F.col("size") * HOT_KEY_SHARE) & (F.col("hot_key") != ""))
        parts.append(big.select(F.lit(field).alias("field"), "hot_key"))
    return parts[0].unionByName(parts[1])


def p1_credits_per_person(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, first and last sight and highest position of every person; null is one of them."""
    credit = table(spark, folder, "credit", "person", "seen_at", "loaded_at", "credit_pos")
    return tree_aggregate(credit, ["person"], {"n_rows": ("count", "*"), "n_placed": ("count", "credit_pos"), "first_seen": ("min", "seen_at"), "last_loaded": ("max", "loaded_at"), "max_pos": ("max", "credit_pos")})


def p1_items_per_value(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every ext_id.value and its distinct items.

    The distinct pairs (value, pk) are one shuffle on both columns, which no single value can fill.
    """
    pairs = tree_aggregate(table(spark, folder, "ext_id", "value", "pk"), ["value", "pk"], {"n": ("count", "*")})
    return tree_aggregate(pairs, ["value"], {"n_rows": ("sum", "n"), "n_items": ("count", "pk")})


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Shows, recordings and sections nested in api_payload.body, beside their parents."""
    return flatten(table(spark, folder, "api_payload", "payload_id", "endpoint", "request_key", "body"), PAYLOAD_CHILDREN)


QUERIES = {"p1_found": p1_found, "p1_credits_per_person": p1_credits_per_person, "p1_items_per_value": p1_items_per_value, "p6_found": p6_found}

ORACLE = {
    "p1_found": """
        SELECT 'credit.person' AS field, CAST(person AS VARCHAR) AS hot_key FROM credit WHERE person IS NOT NULL
        GROUP BY person HAVING count(*) >= 0.01 * (SELECT count(*) FROM credit)
        UNION ALL
        SELECT 'ext_id.value', value FROM ext_id WHERE value <> ''
        GROUP BY value HAVING count(*) >= 0.01 * (SELECT count(*) FROM ext_id)""",
    "p1_credits_per_person": """
        SELECT person, count(*) AS n_rows, count(credit_pos) AS n_placed, min(seen_at) AS first_seen, max(loaded_at) AS last_loaded, max(credit_pos) AS max_pos
        FROM credit GROUP BY person""",
    "p1_items_per_value": """
        SELECT value, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT pk) AS n_items FROM ext_id GROUP BY value""",
}
