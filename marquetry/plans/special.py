"""Queries that need more than SQL: UDFs, folds, page parsing, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.text import fuzzy_ratio, norm_name
from marquetry.operators import clusters
from marquetry.plans.dialect import duck_text
from marquetry.operators.skew import hot_split_join
from marquetry.plans.credits import ROLE_WORDS, MUSICBRAINZ_WORDS, _CREDIT, _PEOPLE
from marquetry.plans.entities import _IDS, _ITEMS
from marquetry.plans.sql import query
from marquetry.session import Scratch
from marquetry.sources import pages
from marquetry.sources.tables import table
from marquetry.streaming import jobs

_MEMBERS = f"SELECT i.role, i.pk AS entry, concat(e.field, '|', lower(e.value)) AS identifier FROM {_ITEMS} i JOIN {_IDS} e ON e.pk = i.pk WHERE e.field NOT IN ('derived_from_imdb', 'studio_id', 'network_id')"
_PART_PAGE = "concat('<html><table><tr>', CASE WHEN p_partkey % 2 = 0 THEN '<th>Name</th><th>Brand</th><th>Size</th>' ELSE '<th>Size</th><th>Name</th><th>Brand</th>' END, '</tr><tr>', CASE WHEN p_partkey % 2 = 0 THEN concat('<td><b>', p_name, '</b></td><td> ', p_brand, '</td><td>', CAST(p_size AS STRING), '</td>') ELSE concat('<td>', CAST(p_size AS STRING), '<td>', p_name, '<td>', p_brand) END, '</table></html>')"
_SPEC_PAGE = "concat('<h3>Video</h3>Codec: ', p_type, '<br>Resolution: 1080p<h3>Disc</h3><p>Brand: ', p_brand, '</p>no value here<p>Size: ', CAST(p_size AS STRING), '</p>')"
_RELEASE_PAGE = "concat('<h2>', p_brand, ' US</h2><ul><li>Theatrical (', CAST(60 + p_size AS STRING), ':05)</li><li>', p_name, ' cut (', CAST(90 + p_size AS STRING), ':30)</li></ul><h2>', p_brand, ' DE</h2><ul><li>no runtime</li><li>Theatrical (', CAST(60 + p_size AS STRING), ':05)</li></ul>')"
_FEED = "concat('<rss xmlns:itunes=\"http://itunes.example/dtd\"><channel><title>f</title><item><title>', replace(replace(norm, '&', '&amp;'), '<', '&lt;'), '</title><pubDate>Tue, 01 Feb 2022 10:00:00 +0000</pubDate><itunes:duration>', CAST(pk AS STRING), '</itunes:duration></item><item><title>second</title>', CASE WHEN pk % 10 = 0 THEN '' ELSE '</item></channel></rss>' END)"


def _pages(spark: SparkSession, folder: str, text: str) -> DataFrame:
    return query("pages", text)(spark, folder)


def q_norm_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "item", "pk", "title").select("pk", norm_name(F.col("title")).alias("norm"))


def q_fuzzy_ratio(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "item_alias", "norm", "pk").distinct().withColumnRenamed("norm", "alias")
    return table(spark, folder, "item", "pk", "norm").distinct().join(names, "pk").select("pk", "alias", F.round(fuzzy_ratio(F.col("norm"), F.col("alias")), 6).alias("ratio"))


def q_mapping_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.mapping_clusters(query("members", _MEMBERS)(spark, folder))


def _credited(spark: SparkSession, folder: str, where: str) -> DataFrame:
    """Credits (repeated rows once) beside the names of their people; persons with very many credits fill no task."""
    credit = query("credit", f"SELECT * FROM {_CREDIT} c WHERE {where} AND person IS NOT NULL")(spark, folder)
    people = query("people", f"SELECT person_id AS person, name FROM {_PEOPLE} p")(spark, folder)
    counts = credit.groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    scratch = Scratch(spark)
    held, seen = scratch.measured(people.join(counts, "person"), total=F.sum("n"), largest=F.max("n"))
    return hot_split_join(credit, held, ["person"], "n", seen["total"] or 1, largest=seen["largest"] or 0)


def q_relation_credits(spark: SparkSession, folder: str) -> DataFrame:
    return _credited(spark, folder, "note <> ''").select("item_pk", "name", "role", "note")


def q_filmography(spark: SparkSession, folder: str) -> DataFrame:
    """Every credit with person and title, cast and crew in one pass."""
    titles = table(spark, folder, "item", "pk", "title").groupBy("pk").agg(F.max("title").alias("title"))
    rows = _credited(spark, folder, "item_pk IS NOT NULL").select(F.col("person").alias("person_id"), F.col("item_pk").alias("pk"), "role")
    return rows.join(titles, "pk").select("person_id", "pk", "role", F.col("role").isin("actor", "voice-actor").alias("is_cast"), "title")


def q_html_table(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("name", "brand", "size")
    return pages.parse(_pages(spark, folder, f"SELECT p_partkey, {_PART_PAGE} AS page FROM @part"), "p_partkey", "page", lambda p: pages.table_rows(p, columns), "name string, brand string, size string")


def q_html_spec(spark: SparkSession, folder: str) -> DataFrame:
    return pages.parse(_pages(spark, folder, f"SELECT p_partkey, {_SPEC_PAGE} AS page FROM @part"), "p_partkey", "page", pages.spec_rows, "section string, field string, value string")


def q_html_releases(spark: SparkSession, folder: str) -> DataFrame:
    return pages.parse(_pages(spark, folder, f"SELECT p_partkey, {_RELEASE_PAGE} AS page FROM @part"), "p_partkey", "page", pages.release_rows, "number int, title string, cut string, seconds int")


def q_feed_parse(spark: SparkSession, folder: str) -> DataFrame:
    feeds = _pages(spark, folder, f"SELECT pk, {_FEED} AS feed FROM (SELECT DISTINCT pk, norm FROM @item) i")
    return pages.parse(feeds, "pk", "feed", pages.feed_rows, "number int, title string, published string, duration string")


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "user_id", "event_id", "ts").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("second"))


def q_token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.token_bucket(_requests(spark, folder), rate=1 / 3600, burst=3.0).select("user_id", "event_id", "granted", F.round("wait_s", 3).alias("wait_s"))


def q_ttl_cache(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.ttl_cache(_requests(spark, folder), ttl=7200.0).select("user_id", "event_id", "hit")


def q_stream_watch(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.watched_counts(spark, folder, "events")


QUERIES = {f.__name__[2:]: f for f in (q_norm_name, q_fuzzy_ratio, q_mapping_clusters, q_relation_credits, q_filmography, q_html_table, q_html_spec, q_html_releases, q_feed_parse, q_token_bucket, q_ttl_cache, q_stream_watch)}

ORACLE = {name: duck_text(text) for name, text in {
    "mapping_clusters": f"""
        WITH RECURSIVE m AS (SELECT DISTINCT * FROM ({_MEMBERS}) x),
        e AS (SELECT DISTINCT a.role, a.entry AS x, b.entry AS y FROM m a JOIN m b ON a.role = b.role AND a.identifier = b.identifier AND a.entry <> b.entry),
        r AS (SELECT role, x AS entry, x AS g FROM e UNION SELECT e.role, e.y, r.g FROM r JOIN e ON e.role = r.role AND e.x = r.entry WHERE r.g < e.y)
        SELECT role, entry, min(g) AS cluster FROM (SELECT role, entry, g FROM r UNION ALL SELECT role, y, x FROM e WHERE x < y UNION ALL SELECT role, entry, entry FROM m) u GROUP BY role, entry""",
    "html_table": "SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(p_size AS STRING) AS size FROM @part",
    "html_spec": "SELECT p_partkey, 'Video' AS section, 'Codec' AS field, p_type AS value FROM @part UNION ALL SELECT p_partkey, 'Video', 'Resolution', '1080p' FROM @part UNION ALL SELECT p_partkey, 'Disc', 'Brand', p_brand FROM @part UNION ALL SELECT p_partkey, 'Disc', 'Size', CAST(p_size AS STRING) FROM @part",
    "html_releases": "SELECT p_partkey, 0 AS number, concat(p_brand, ' US') AS title, 'Theatrical' AS cut, (60 + p_size) * 60 + 5 AS seconds FROM @part UNION ALL SELECT p_partkey, 0, concat(p_brand, ' US'), concat(p_name, ' cut'), (90 + p_size) * 60 + 30 FROM @part UNION ALL SELECT p_partkey, 1, concat(p_brand, ' DE'), 'Theatrical', (60 + p_size) * 60 + 5 FROM @part",
    "feed_parse": "SELECT pk, 0 AS number, rx_sub(norm, ~'^[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}]+|[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}]+$', '') AS title, 'Tue, 01 Feb 2022 10:00:00 +0000' AS published, CAST(pk AS STRING) AS duration FROM (SELECT DISTINCT pk, norm FROM @item) i UNION ALL SELECT DISTINCT pk, 1, 'second', '', '' FROM @item WHERE pk % 10 <> 0",
    "stream_watch": "SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(ts) AS last_ts FROM @events GROUP BY event_type",
}.items()}

# Written on their own: roles through a joined word table, people through windows.
_WORDS = ", ".join(f"('{w}', '{r}')" for r, ws in ROLE_WORDS.items() for w in ws)
_MUSIC = ", ".join(f"('{w}', '{r}')" for w, r in MUSICBRAINZ_WORDS.items())
_CLEAN_WORD = "trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\\([^)]*\\)', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
_ROLE_OF = "coalesce({own}v.role, CASE WHEN list_contains(string_split(w, ' '), 'casting') THEN 'casting' WHEN list_contains(string_split(w, ' '), 'director') AND list_has_any(string_split(w, ' '), ['voice', 'dub', 'dubbing', 'adr']) THEN 'audio-director'{more} END, replace(w, ' ', '-'))"


def _role_of(own: str = "", more: str = "") -> str:
    return _ROLE_OF.replace("{own}", own).replace("{more}", more)


_DUCK_CREDIT = f"""
    v(word, role) AS (VALUES {_WORDS}),
    k AS (SELECT DISTINCT credit_id, person, item_pk, {_CLEAN_WORD.replace("{x}", "role")} AS w, coalesce(note, '') AS note, coalesce(character_name, '') AS character_name, credit_pos, seen_at FROM credit WHERE person IS NOT NULL),
    c AS (SELECT DISTINCT k.* EXCLUDE (w), {_role_of()} AS role FROM k LEFT JOIN v ON v.word = w),
    p AS (SELECT person_id, name FROM person QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY updated_at DESC) = 1 UNION ALL SELECT person_id, name FROM house_person)"""
ORACLE |= {
    "relation_credits": f"WITH {_DUCK_CREDIT} SELECT c.item_pk, p.name, c.role, c.note FROM c JOIN p ON p.person_id = c.person WHERE c.note <> ''",
    "filmography": f"WITH {_DUCK_CREDIT} SELECT c.person AS person_id, c.item_pk AS pk, c.role, c.role IN ('actor', 'voice-actor') AS is_cast, i.title FROM c JOIN p ON p.person_id = c.person JOIN (SELECT pk, max(title) AS title FROM item GROUP BY pk) i ON i.pk = c.item_pk",
    "role_norm": f"""
        WITH v(word, role) AS (VALUES {_WORDS}), m(word, role) AS (VALUES {_MUSIC}),
        x AS (SELECT role AS word, count(*) AS n FROM credit WHERE role IS NOT NULL GROUP BY role UNION ALL SELECT unnest([@SAMPLES@]), 0)
        SELECT x.word, x.n, {_role_of()} AS role, {_role_of(own="m.role, ")} AS music_role, {_role_of(more=" WHEN list_contains(string_split(w, ' '), 'voice') THEN 'voice-actor'")} AS cast_role, trim(regexp_extract(x.word, '\\(([^)]*)\\)', 1), ' ') AS note
        FROM (SELECT *, {_CLEAN_WORD.replace("{x}", "word")} AS w FROM x) x LEFT JOIN v ON v.word = w LEFT JOIN m ON m.word = w""".replace("@SAMPLES@", "'Casting (US)', 'Dub Director', 'Voice_Over', 'Best Boy', 'SCREENPLAY', 'Executive Producer', 'guest-star (ep. 4)', 'Read by', 'Sound Design', 'Director of Photography', 'Co/Executive Producer', 'Voice Recording', 'Music & Lyrics'"),
}
