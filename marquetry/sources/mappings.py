"""Identity mappings: asserted clusters of identifiers, loaded from TOML files and applied by joins.

A file has one table array per role; each entry's keys are id fields and their values name one entity.
``name`` is a label only, ``score`` (0..1, 1 by default) says how sure the entry is.
"""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.scalars import column
from marquetry.operators.clusters import mapping_clusters

# Roles a mapping file may hold, and id fields whose values are whole numbers.
ROLES = ("artist", "album", "track", "label", "channel")
WHOLE = ("tmdb_movie", "tmdb_tv", "tmdb_person", "tvdb", "tvmaze", "anilist_id", "mal_id", "anidb_id", "bandcamp_band_id", "audiodb_artist_id", "metal_archives_band", "metal_archives_artist", "metal_archives_label", "anilist_staff_id", "anilist_studio_id", "mal_person_id", "mal_studio_id", "librivox_id", "apple_podcast_id", "discogs_artist", "discogs_release")
SCHEMA = "role string, entry bigint, name string, score double, field string, value string"


def read_file(path: str) -> list[tuple[str, str | None, float, dict[str, str]]]:
    """(role, name, score, identifiers) of a TOML file; none when it is absent or can't be read, and of unknown roles."""
    try:
        found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return []
    out = []
    for role in ROLES:
        for entry in found.get(role, []) if isinstance(found.get(role), list) else []:
            ids = {k: str(v) for k, v in entry.items() if k not in ("name", "score") and isinstance(v, (str, int)) and str(v).strip()}
            if ids:
                out.append((role, entry.get("name"), min(max(float(entry.get("score", 1.0)), 0.0), 1.0), ids))
    return out


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """Mapping rows of files in order (the package's first, the user's after), one per identifier; files are small."""
    entries = [e for path in paths for e in read_file(path)]
    rows = [(role, n, name, score, field, value) for n, (role, name, score, ids) in enumerate(entries) for field, value in ids.items()]
    return _normal(spark.createDataFrame(rows, SCHEMA))


def _normal(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", column("url_norm", x="value")).where("value <> ''")


def added(mappings: DataFrame, role: str, identifiers: dict[str, str], name: str | None = None, score: float = 1.0) -> DataFrame:
    """``mappings`` and one more entry, asserted at run time; it isn't written anywhere, so loading again drops it."""
    spark = mappings.sparkSession
    entry = mappings.agg(F.coalesce(F.max("entry") + 1, F.lit(0)).alias("entry"))
    rows = spark.createDataFrame([(role, name, min(max(score, 0.0), 1.0), f, str(v)) for f, v in identifiers.items()], "role string, name string, score double, field string, value string")
    return mappings.unionByName(_normal(rows.crossJoin(entry)).select(*mappings.columns))  # one row on a side


def merged(mappings: DataFrame) -> DataFrame:
    """Mapping rows whose ``entry`` is the least entry they are linked to: entries that share an identifier are one.

    A merged entry has the first entry's score and the first name that isn't null.
    """
    members = mappings.select("role", "entry", F.concat_ws("|", "field", "value").alias("identifier"))
    joined = mappings.join(mapping_clusters(members), ["role", "entry"])
    firsts = joined.groupBy("role", "cluster").agg(F.min_by("score", "entry").alias("score"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("entry"))).alias("name"))
    ids = joined.select("role", "cluster", "field", "value").distinct()
    return ids.join(firsts, ["role", "cluster"]).withColumnRenamed("cluster", "entry").select(*mappings.columns)


def lookup(mappings: DataFrame, ids: DataFrame, min_score: float = 0.0) -> DataFrame:
    """(key, entry) of ``ids`` (key, role, field, value): the entry that the first known identifier names.

    Fields are asked in the order of their names; entries below ``min_score`` are left alone.
    """
    asked = ids.select("key", "role", "field", column("url_norm", x="value").alias("value"))
    hits = asked.join(mappings.select("role", "entry", "score", "field", "value"), ["role", "field", "value"])
    first = hits.groupBy("key").agg(F.min(F.struct("field", "entry", "score")).alias("h"))
    return first.where(F.col("h.score") >= min_score).select("key", "h.entry")


def whole(field: Column, value: Column) -> Column:
    """The value of an id field whose values are whole numbers as such a number, any other as it stands."""
    number = F.regexp_replace(value, r"^0+(?=\d)", "")
    return F.when(field.isin(*WHOLE) & F.rlike(value, F.lit(r"^\d+$")), number).otherwise(value)


def applied(mappings: DataFrame, ids: DataFrame, min_score: float = 0.0) -> DataFrame:
    """(key, field, value, mapped): ``ids`` and what their mapping entry adds; own identifiers win.

    Keys without an entry come back unchanged.
    """
    found = lookup(mappings, ids, min_score)
    extra = found.join(mappings.select("entry", "field", "value"), "entry").select("key", "field", whole(F.col("field"), F.col("value")).alias("value"), F.lit(1).alias("rank"))
    both = ids.select("key", "field", "value", F.lit(0).alias("rank")).unionByName(extra)
    best = both.groupBy("key", "field").agg(F.min(F.struct("rank", "value")).alias("b"))
    return best.select("key", "field", "b.value", (F.col("b.rank") == 1).alias("mapped"))
