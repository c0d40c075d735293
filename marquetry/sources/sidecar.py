"""Entity sidecars: resolved entities beside a library, one JSON record a line, and their reverse index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.scalars import column
from marquetry.sources.store import Files

SCHEMA = "entity_id string, role string, kind string, name string, aliases array<string>, external_ids map<string,string>, works array<string>"
POINTER = "CURRENT"


def save(entities: DataFrame, folder: str) -> None:
    """Write the entities as a new version and make it the current one in one step; null fields are left out."""
    files = Files(entities.sparkSession)
    before = files.read(f"{folder}/{POINTER}")
    version = f"v{int((before or 'v0')[1:]) + 1}"
    files.delete(f"{folder}/{version}")  # of a save that was cut off
    entities.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.option("ignoreNullFields", "true").json(f"{folder}/{version}")
    files.replace(f"{folder}/{POINTER}", version)
    if before:
        files.delete(f"{folder}/{before}")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The current entities; none where nothing was saved. Lines that are no JSON are skipped."""
    version = Files(spark).read(f"{folder}/{POINTER}")
    if not version:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(f"{folder}/{version}")


def index(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((role, field, value, entity_id), (role, norm, entity_id)): entities by identifier and by any of their names.

    Of several entities with one identifier the largest id stands, as when they are indexed in order.
    """
    ids = entities.select("role", "entity_id", F.explode("external_ids").alias("field", "value")).where("trim(value) <> ''")
    by_id = ids.groupBy("role", "field", "value").agg(F.max("entity_id").alias("entity_id"))
    names = entities.select("role", "entity_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    by_name = names.select("role", column("norm_entity_name", x="n").alias("norm"), "entity_id").where("norm <> ''").distinct()
    return by_id, by_name


def by_external_id(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, entity_id) of ``asked`` (key, role, field, value)."""
    return asked.join(index(entities)[0], ["role", "field", "value"]).select("key", "entity_id")


def by_name(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, entity_id) of ``asked`` (key, role, name): every entity of the role with that name or alias."""
    return asked.select("key", "role", column("norm_entity_name", x="name").alias("norm")).join(index(entities)[1], ["role", "norm"]).select("key", "entity_id")
