"""Catalogue items out of raw answers, through the sources' adapters.

The DuckDB twins read the same answers with their own JSON paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.sources import adapters
from marquetry.sources.tables import table

_SOURCES = {(s.name, s.kind): s for s in adapters.CATALOGUES}


def _answers(spark: SparkSession, folder: str, endpoint: str) -> DataFrame:
    rows = table(spark, folder, "api_payload", "payload_id", "endpoint", "body")
    return rows.where(F.lower(F.trim("endpoint")) == endpoint).select(F.col("payload_id").alias("query_id"), "body").distinct()


def q_catalog_tracks(spark: SparkSession, folder: str) -> DataFrame:
    got = adapters.items(_answers(spark, folder, "release"), _SOURCES["musicbrainz", "track"])
    return got.select("query_id", F.element_at("ext_ids", "musicbrainz").alias("recording"), F.element_at("ext_ids", "musicbrainz_track").alias("track"), "title", "position", "runtime_min")


def q_catalog_audiobooks(spark: SparkSession, folder: str) -> DataFrame:
    got = adapters.items(_answers(spark, folder, "audiobook"), _SOURCES["librivox", "audiobook"])
    return got.select("query_id", "place", F.element_at("ext_ids", "librivox").alias("librivox"), "title", "runtime_min")


def q_catalog_chapters(spark: SparkSession, folder: str) -> DataFrame:
    got = adapters.items(_answers(spark, folder, "audiobook"), _SOURCES["librivox", "chapter"])
    return got.select("query_id", "place", F.element_at("ext_ids", "librivox_section").alias("section"), "title", "position", "runtime_min")


def q_provider_audiobooks(spark: SparkSession, folder: str) -> DataFrame:
    """The first record of every answer as a candidate."""
    provider = next(p for p in adapters.PROVIDERS if p.name == "librivox")
    got = adapters.candidates(_answers(spark, folder, "audiobook"), provider)
    return got.select("query_id", "confidence", "title", "artist", "medium", "language", F.element_at("ids", "librivox_id").alias("librivox"))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_READ = "(SELECT DISTINCT payload_id AS query_id, TRY_CAST(body AS JSON) AS j FROM api_payload WHERE lower(trim(endpoint)) = '{e}' AND TRY_CAST(body AS JSON) IS NOT NULL)"
_TEXT = "nullif(trim(json_extract_string({r}, '{p}'), ' '), '')"


def _text(record: str, path: str) -> str:
    return _TEXT.replace("{r}", record).replace("{p}", path)


def _listed(path: str, of: str = "j") -> str:
    """Records of a list, or of a lone object."""
    x = f"json_extract({of}, '{path}')"
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] END"


def _rows(endpoint: str, path: str) -> str:
    return f"SELECT query_id, r, i - 1 AS place FROM (SELECT query_id, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM (SELECT query_id, list_filter({_listed(path)}, lambda x: json_type(x) = 'OBJECT') AS l FROM {_READ.replace('{e}', endpoint)}) a) b"


_MINUTES = "CASE WHEN round(TRY_CAST({x} AS DOUBLE) / {n}, 2) > 0 THEN round(TRY_CAST({x} AS DOUBLE) / {n}, 2) END"


def _minutes(x: str, n: int) -> str:
    return _MINUTES.replace("{x}", x).replace("{n}", str(n))


def _id(x: str) -> str:
    return f"nullif({x}, '0')"


ORACLE = {
    "catalog_tracks": f"""
        SELECT query_id, {_id(_text("t", "$.recording.id"))} AS recording, {_id(_text("t", "$.id"))} AS track, coalesce({_text("t", "$.title")}, {_text("t", "$.recording.title")}) AS title, TRY_CAST({_text("t", "$.position")} AS INT) AS position, {_minutes(f"coalesce({_text('t', '$.length')}, {_text('t', '$.recording.length')})", 60000)} AS runtime_min
        FROM (SELECT query_id, unnest({_listed("$.tracks", "m")}) AS t FROM (SELECT query_id, unnest({_listed("$.media")}) AS m FROM {_READ.replace("{e}", "release")}) y) x WHERE json_type(t) = 'OBJECT'""",
    "catalog_audiobooks": f"""
        SELECT query_id, CAST(place AS INT) AS place, {_id(_text("r", "$.id"))} AS librivox, {_text("r", "$.title")} AS title, {_minutes(_text("r", "$.totaltimesecs"), 60)} AS runtime_min FROM ({_rows("audiobook", "$.books")}) b""",
    "catalog_chapters": f"""
        SELECT query_id, CAST(place AS INT) AS place, {_id(_text("r", "$.id"))} AS section, {_text("r", "$.title")} AS title, TRY_CAST({_text("r", "$.section_number")} AS INT) AS position, {_minutes(_text("r", "$.playtime"), 60)} AS runtime_min FROM ({_rows("audiobook", "$.books[0].sections")}) b""",
    "provider_audiobooks": f"""
        SELECT query_id, CAST(0.8 AS DOUBLE) AS confidence, {_text("r", "$.title")} AS title, {_text("r", "$.authors[0].last_name")} AS artist, 'audiobook' AS medium, {_text("r", "$.language")} AS language, {_id(_text("r", "$.id"))} AS librivox FROM ({_rows("audiobook", "$.books")}) b
        WHERE {_text("r", "$.title")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) = 1""",
}
