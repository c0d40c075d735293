"""The catalogue store: ingest, and lookups by id and by name (neutral SQL)."""

from __future__ import annotations

# The id fields in the order a lookup asks them.
ID_ORDER = ("imdb", "tmdb", "tvdb", "wikidata", "musicbrainz_artist", "isbn_13", "isbn_10", "olid")
PLACEHOLDERS = "'', '-', 'null', 'N/A', 'none', 'unknown', '0', 'tt0000000', '00000000-0000-0000-0000-000000000000'"
_ORDER = "CASE field " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(ID_ORDER, 1)) + " ELSE 99 END"
_REAL = f"value IS NOT NULL AND value NOT IN ({PLACEHOLDERS})"
_ITEM = "(SELECT pk, max(kind) AS kind, max(title) AS title, max(norm) AS norm, max(year) AS year, max(CASE WHEN isnan(rank) THEN NULL ELSE rank END) AS rank FROM @item GROUP BY pk)"
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC NULLS LAST, fetched_at DESC NULLS LAST, coalesce(overview, '') DESC) AS nth FROM @catalog_item) d WHERE nth = 1)"
_NORM = "trim(rx_sub(lower({x}), ~'[^\\p{L}\\p{N}]+', ' '))"


def norm(x: str) -> str:
    return _NORM.replace("{x}", x)


TEXTS = {
    # projection and filter reach the scan
    "scan_prune": "SELECT pk, title FROM @item WHERE year >= 2000",
    "ingest_counts": "SELECT source, count(*) AS declared, count(CASE WHEN trim(coalesce(title, '')) <> '' THEN 1 END) AS inserted, count(CASE WHEN trim(coalesce(title, '')) <> '' THEN NULL ELSE 1 END) AS skipped FROM @catalog_item GROUP BY source",
    "build_item": f"""
        SELECT item_id AS pk, kind, coalesce(nullif(trim(original_title), ''), nullif(trim(title), '')) AS title, {norm("coalesce(nullif(trim(original_title), ''), nullif(trim(title), ''))")} AS norm,
            CASE WHEN year BETWEEN 1000 AND 2200 THEN year ELSE try_cast(substring(release_date, 1, 4) AS INT) END AS year,
            CASE WHEN isnan(runtime_min) OR runtime_min <= 0 THEN NULL ELSE round(runtime_min, 2) END AS runtime
        FROM {_LATEST} c WHERE coalesce(nullif(trim(original_title), ''), nullif(trim(title), '')) IS NOT NULL""",
    "build_ext_id": f"""
        SELECT DISTINCT e.key AS field, CASE WHEN starts(e.key, 'isbn') THEN upper(replace(trim(e.value), '-', '')) ELSE trim(e.value) END AS value, pk
        FROM (SELECT item_id AS pk, unnest_rows(map_entries(ext_ids)) AS e FROM {_LATEST} c WHERE ext_ids IS NOT NULL) x WHERE trim(e.value) <> ''""",
    "build_alias": f"""
        SELECT DISTINCT alias AS norm, pk FROM (
            SELECT item_id AS pk, {norm("sort_title")} AS alias, {norm("title")} AS main FROM {_LATEST} a
            UNION ALL SELECT item_id, {norm("title")}, {norm("coalesce(nullif(trim(original_title), ''), title)")} FROM {_LATEST} b) u
        WHERE alias <> '' AND alias <> main""",
    "convert_row": f"""
        SELECT item_id, CASE source WHEN 'librivox' THEN 'audiobook' WHEN 'openlibrary' THEN 'book' ELSE kind END AS kind,
            coalesce(nullif(trim(title), ''), nullif(trim(original_title), ''), '') AS title,
            CASE WHEN runtime_min > 0 AND NOT isnan(runtime_min) THEN floor(runtime_min * CAST(CASE source WHEN 'librivox' THEN 0.5 ELSE 1.0 END AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) / 100 END AS minutes,
            CASE WHEN trim(coalesce(overview, '')) <> '' THEN substring(trim(overview), 1, 2000) END AS overview,
            concat('https://img.example/', CAST(item_id AS STRING), '.jpg') AS poster_url
        FROM {_LATEST} c""",
    "ids_map": "SELECT item_id, join_agg(kv, ';', kv) AS ids FROM (SELECT DISTINCT item_id, concat(e.key, '=', e.value) AS kv FROM (SELECT item_id, unnest_rows(map_entries(ext_ids)) AS e FROM @catalog_item WHERE ext_ids IS NOT NULL) x WHERE e.value NOT IN ('', '0')) y GROUP BY item_id",
    "explode_values": "SELECT person_id, trim(a) AS value FROM (SELECT person_id, unnest_rows(aliases) AS a FROM @person WHERE aliases IS NOT NULL) x WHERE trim(a) <> ''",
    "pick_image": "SELECT person_id, coalesce(rx_sub(arr_get(arr_filter(pics, e -> starts(e, 'poster|')), 1), ~'^poster\\|', ''), rx_sub(arr_get(arr_filter(pics, e -> starts(e, 'cover|')), 1), ~'^cover\\|', ''), '') AS url FROM (SELECT person_id, arr_filter(arr(concat(CASE WHEN person_id % 3 = 0 THEN 'cover|' WHEN person_id % 3 = 1 THEN 'poster|' ELSE 'fanart|' END, image_url), concat('cover|', image_url, '?alt')), e -> e IS NOT NULL) AS pics FROM @person) x",
    "person_name": "SELECT payload_id, coalesce(nullif(trim(js(author, '$.name')), ''), trim(concat(coalesce(js(author, '$.first_name'), ''), ' ', coalesce(js(author, '$.last_name'), '')))) AS person FROM (SELECT payload_id, CASE payload_id % 3 WHEN 0 THEN concat('{\"name\": \"N ', request_key, '\"}') WHEN 1 THEN concat('{\"first_name\": \"F\", \"last_name\": \"L', request_key, '\"}') ELSE '{\"last_name\": \"Only\"}' END AS author FROM @api_payload) x",
    "list_caps": "SELECT person_id, arr_len(aliases) AS held, least(arr_len(aliases), 2) AS kept, arr_get(aliases, 1) AS first_alias, substring(name, 1, 20) AS name FROM @person WHERE aliases IS NOT NULL",
    # lookups
    "find_ids": f"""
        WITH asked AS (SELECT DISTINCT pk AS query_id, {_ORDER} AS ord, field, value FROM @ext_id WHERE pk % 50 = 0 AND {_REAL} AND {_ORDER} < 99),
        hit AS (SELECT DISTINCT a.query_id, a.ord, e.pk FROM asked a JOIN @ext_id e ON e.field = a.field AND e.value = a.value)
        SELECT query_id, pk, title FROM (
            SELECT h.query_id, i.pk, i.title, row_number() OVER (PARTITION BY h.query_id ORDER BY h.ord, i.rank DESC NULLS LAST, i.pk) AS nth FROM hit h JOIN {_ITEM} i ON i.pk = h.pk) t WHERE nth = 1""",
    "find_name": f"""
        WITH named AS (SELECT norm, pk FROM @item WHERE norm <> '' UNION SELECT norm, pk FROM @item_alias WHERE norm <> '')
        SELECT name, pk, nth FROM (SELECT n.norm AS name, i.pk, row_number() OVER (PARTITION BY n.norm ORDER BY i.rank DESC NULLS LAST, i.pk) AS nth FROM named n JOIN {_ITEM} i ON i.pk = n.pk) t WHERE nth <= 5""",
    "stale_sets": "SELECT source, built_at, (SELECT max(loaded_at) FROM @catalog_item) AS seen_at, epoch_micros((SELECT max(loaded_at) FROM @catalog_item)) - epoch_micros(built_at) > 86400000000 * 2 AS stale FROM (SELECT source, max(loaded_at) AS built_at FROM @catalog_item GROUP BY source) s",
    "front_lookup": f"SELECT i.pk, i.kind, min(p.seq) AS front_seq, count(*) AS fronts FROM {_ITEM} i JOIN (SELECT provider, seq, unnest_rows(media) AS medium FROM @provider) p ON p.medium = i.kind GROUP BY i.pk, i.kind",
    "extra_candidates": f"""
        SELECT kind, title_key, item_id, origin FROM (
            SELECT *, row_number() OVER (PARTITION BY kind, title_key ORDER BY origin, item_id) AS nth FROM (
                SELECT kind, lower(trim(title)) AS title_key, pk AS item_id, 'store' AS origin FROM {_ITEM} i WHERE trim(title) <> ''
                UNION ALL SELECT kind, lower(trim(title)), item_id, source FROM {_LATEST} c WHERE trim(title) <> '') u) t WHERE nth = 1""",
    "extra_enrich": f"""
        SELECT pk, field, value FROM (SELECT e.pk, e.field, e.value, row_number() OVER (PARTITION BY e.pk, e.field ORDER BY e.prio, e.value) AS nth FROM (
            SELECT pk, field, value, 1 AS prio FROM @ext_id WHERE {_REAL} AND field IS NOT NULL
            UNION ALL SELECT i.pk, e.field, e.value, 2 FROM (SELECT pk, norm FROM {_ITEM} x WHERE norm <> '') i JOIN (SELECT DISTINCT norm, pk FROM @item_alias) a ON a.norm = i.norm JOIN @ext_id e ON e.pk = a.pk WHERE e.field IS NOT NULL AND e.value IS NOT NULL AND e.value NOT IN ({PLACEHOLDERS})) e) t WHERE nth = 1""",
    "flat_ids": f"SELECT pk, join_agg(concat(field, '=', value), ' ', field, value) AS ids FROM (SELECT DISTINCT pk, field, value FROM @ext_id WHERE {_REAL} AND field IS NOT NULL) d GROUP BY pk",
    "id_translate": "SELECT DISTINCT item_id, CASE e.key WHEN 'tmdb_id' THEN CASE WHEN kind = 'series' THEN 'tmdb_tv' ELSE 'tmdb_movie' END WHEN 'wikidata_id' THEN 'wikidata' WHEN 'tvmaze_id' THEN 'tvmaze' WHEN 'openlibrary_id' THEN 'olid' ELSE e.key END AS slot, e.value FROM (SELECT item_id, kind, unnest_rows(map_entries(ext_ids)) AS e FROM @catalog_item WHERE ext_ids IS NOT NULL) x WHERE e.value <> ''",
    "person_ids": "SELECT pk, scheme, value FROM (SELECT pk, CASE field WHEN 'musicbrainz_artist' THEN 'musicbrainz' WHEN 'audiodb_artist_id' THEN 'audiodb' WHEN 'wikidata' THEN 'wikidata' END AS scheme, value, row_number() OVER (PARTITION BY pk, CASE field WHEN 'musicbrainz_artist' THEN 'musicbrainz' WHEN 'audiodb_artist_id' THEN 'audiodb' WHEN 'wikidata' THEN 'wikidata' END ORDER BY value) AS nth FROM @ext_id WHERE field IN ('musicbrainz_artist', 'audiodb_artist_id', 'wikidata') AND value <> '') t WHERE nth = 1",
    "reverse_probe": f"SELECT pk, field, value FROM (SELECT pk, field, value, row_number() OVER (PARTITION BY pk ORDER BY {_ORDER}, field, value) AS nth FROM @ext_id WHERE {_REAL} AND field IS NOT NULL) t WHERE nth = 1",
    "fallback_lookup": f"""
        WITH q AS (SELECT DISTINCT query_id, lower(trim(signals.title)) AS title, signals.year AS year FROM @provider_match),
        by_title AS (SELECT q.query_id, min(i.pk) AS pk FROM q JOIN {_ITEM} i ON lower(trim(i.title)) = q.title WHERE q.title <> '' GROUP BY q.query_id),
        by_alias AS (SELECT q.query_id, min(a.pk) AS pk FROM q JOIN (SELECT DISTINCT norm, pk FROM @item_alias) a ON a.norm = q.title WHERE q.title <> '' GROUP BY q.query_id)
        SELECT q.query_id, coalesce(t.pk, a.pk) AS pk, CASE WHEN t.pk IS NOT NULL THEN 'title' WHEN a.pk IS NOT NULL THEN 'alias' ELSE 'none' END AS found_by FROM (SELECT DISTINCT query_id FROM q) q LEFT JOIN by_title t ON t.query_id = q.query_id LEFT JOIN by_alias a ON a.query_id = q.query_id""",
}
