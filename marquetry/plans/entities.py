"""Entity identity, mappings, sidecars and variants (neutral SQL)."""

from __future__ import annotations

from marquetry.plans.store import _REAL, norm

# Work-level id fields in the order that decides a variant's key.
VARIANT_LADDER = (
    "fanedit_id", "musicbrainz_release", "musicbrainz_release_group", "musicbrainz_recording", "musicbrainz_work", "imdb", "tmdb", "tvdb", "tvmaze", "trakt_id", "discogs_release", "isbn_13", "isbn_10", "olid",
    "google_books_id", "bluray_com_id", "dvdcompare_id", "audible_asin", "librivox_id", "podcast_index_id", "apple_podcast_id", "listen_notes_id", "anilist_id", "mal_id", "anidb_id", "audiodb_album_id",
    "audiodb_track_id", "metal_archives_release", "metal_archives_song", "opencritic_id", "rawg_id", "igdb_id", "iheart_podcast_id", "iheart_episode_id", "iheart_track_id", "iheart_playlist_id",
)
# Id fields by which a role's entity is known best, in order.
_PERSON = ("tmdb_person", "imdb_person", "anilist_staff_id", "mal_person_id", "metal_archives_artist", "wikidata")
ROLE_LADDERS = {
    "artist": ("musicbrainz_artist", "metal_archives_band", "wikidata", "tmdb_person", "imdb_person", "bandcamp_band_id", "soundcloud_user_id", "audiodb_artist_id", "youtube_music_artist_browse_id"),
    "person": _PERSON,
    "author": ("olid", "goodreads", "goodreads_author", "wikidata"),
    "illustrator": ("tmdb_person", "imdb_person", "olid", "wikidata"),
    "label": ("metal_archives_label", "musicbrainz_label", "wikidata"),
    "channel": ("youtube_channel_id", "wikidata"),
    "voice-actor": ("tmdb_person", "imdb_person", "anilist_staff_id", "mal_person_id", "wikidata"),
    "studio": ("anilist_studio_id", "mal_studio_id", "wikidata"),
}
# Roles that are known by another role's ladder.
LADDER_OF = {r: "person" for r in ("actor", "director", "producer", "composer", "lyricist", "writer", "screenwriter", "cinematographer", "editor", "narrator", "host", "guest", "curator")} | {"featured-artist": "artist", "translator": "illustrator", "distributor": "channel"}
_RUNG = "CASE field " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(VARIANT_LADDER, 1)) + " ELSE 90 END"
_IDS = f"(SELECT DISTINCT pk, field, trim(value) AS value FROM @ext_id WHERE {_REAL} AND field IS NOT NULL)"
# the role in which an item's maker is known: by kind
_ROLE = "CASE kind WHEN 'artist' THEN 'artist' WHEN 'book' THEN 'author' WHEN 'audiobook' THEN 'illustrator' WHEN 'show' THEN 'channel' WHEN 'game' THEN 'studio' WHEN 'playlist' THEN 'label' WHEN 'series' THEN 'voice-actor' ELSE 'person' END"
_ITEMS = f"(SELECT pk, max(kind) AS kind, max(title) AS title, max({_ROLE}) AS role FROM @item GROUP BY pk)"
_LADDER = "CASE " + " ".join(f"WHEN i.role = '{r}' AND e.field = '{f}' THEN {n}" for r, fields in ROLE_LADDERS.items() for n, f in enumerate(fields, 1)) + " END"
_DOMINANT = f"(SELECT i.pk, min_by(e.value, concat(pad2({_LADDER}), e.value)) AS dominant FROM {_ITEMS} i JOIN {_IDS} e ON e.pk = i.pk WHERE {_LADDER} IS NOT NULL GROUP BY i.pk)"
_ENTITY = f"(SELECT i.pk, i.role, i.title, d.dominant, sha1(CASE WHEN d.dominant IS NOT NULL THEN concat(i.role, '|ext:', d.dominant) ELSE concat(i.role, '|name:', {norm('coalesce(i.title, %s)' % repr(''))}) END) AS entity_id FROM {_ITEMS} i LEFT JOIN {_DOMINANT} d ON d.pk = i.pk)"
_KEYS = f"(SELECT i.pk, i.title, coalesce(k.variant_key, concat('name:', {norm('coalesce(i.title, %s)' % repr(''))})) AS variant_key FROM {_ITEMS} i LEFT JOIN (SELECT pk, min_by(concat(field, ':', value), concat(pad2({_RUNG}), field, value)) AS variant_key FROM {_IDS} e WHERE field <> 'derived_from_imdb' GROUP BY pk) k ON k.pk = i.pk)"
_NAMES = f"(SELECT DISTINCT person_id, kind, {norm('name')} AS norm, name AS surface, 0 AS ord FROM @person WHERE {norm('name')} <> '' UNION SELECT DISTINCT person_id, kind, {norm('a')} AS norm, a AS surface, 1 AS ord FROM (SELECT person_id, kind, unnest_rows(aliases) AS a FROM @person WHERE aliases IS NOT NULL) x WHERE {norm('a')} <> '')"

TEXTS = {
    "dominant_id": f"SELECT pk, dominant FROM {_DOMINANT} d",
    "entity_id": f"SELECT pk, role, entity_id FROM {_ENTITY} e",
    "entity_upsert": f"SELECT entity_id, min(role) AS role, min_by(title, pk) AS name, count(*) AS n_rows, count(DISTINCT title) AS n_names, min(pk) AS first_pk FROM {_ENTITY} e GROUP BY entity_id",
    "aggregate_relations": f"SELECT e.entity_id, x.field, min_by(x.value, concat(lpad(CAST(e.pk AS STRING), 12, '0'), x.value)) AS value FROM {_ENTITY} e JOIN {_IDS} x ON x.pk = e.pk GROUP BY e.entity_id, x.field",
    "entity_aliases": f"SELECT person_id, norm, min(surface) AS surface FROM (SELECT n.person_id, n.norm, n.surface, max(CASE WHEN n.ord = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY n.person_id, n.norm) AS canonical FROM {_NAMES} n) t WHERE canonical = 0 GROUP BY person_id, norm",
    "entity_works": "SELECT DISTINCT person, item_pk FROM @credit WHERE person IS NOT NULL",
    "variant_key": f"SELECT pk, variant_key FROM {_KEYS} k",
    "variants_dedup": f"SELECT variant_key, min(pk) AS pk, count(*) AS n_merged FROM {_KEYS} k GROUP BY variant_key",
    "mapping_load": f"SELECT role, scheme, count(*) AS identifiers FROM (SELECT DISTINCT i.role, e.field AS scheme, e.value FROM {_ITEMS} i JOIN {_IDS} e ON e.pk = i.pk) m GROUP BY role, scheme",
    "mapping_by_role": f"SELECT role, join_agg(scheme, ',', scheme) AS schemes FROM (SELECT DISTINCT i.role, e.field AS scheme FROM {_ITEMS} i JOIN {_IDS} e ON e.pk = i.pk) m GROUP BY role",
    "sidecar_index": f"SELECT norm, count(DISTINCT person_id) AS people, min(person_id) AS first_id FROM {_NAMES} n GROUP BY norm",
    "sidecar_by_id": f"SELECT field, value, min(pk) AS pk, count(*) AS n FROM {_IDS} e WHERE field NOT IN ('derived_from_imdb', 'studio_id', 'network_id') GROUP BY field, value",
    "id_resolve": f"SELECT c.item_id, c.imdb, m.pk, CAST(CASE WHEN m.pk IS NULL THEN 0.0 WHEN lower(trim(c.title)) = lower(trim(i.title)) THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM (SELECT item_id, max(title) AS title, max(map_entry(ext_ids, 'imdb')) AS imdb FROM @catalog_item WHERE ext_ids IS NOT NULL GROUP BY item_id) c LEFT JOIN (SELECT value, min(pk) AS pk FROM {_IDS} e WHERE field = 'imdb' GROUP BY value) m ON m.value = c.imdb LEFT JOIN {_ITEMS} i ON i.pk = m.pk WHERE c.imdb IS NOT NULL",
    "link_relations": "SELECT pk, slot, url FROM (SELECT pk, CASE rel WHEN 'wikidata' THEN 'wikidata' WHEN 'discogs' THEN 'discogs_artist' ELSE concat('extra:', rel) END AS slot, url, row_number() OVER (PARTITION BY pk, rel ORDER BY url) AS nth FROM (SELECT DISTINCT pk, CASE pk % 3 WHEN 0 THEN 'wikidata' WHEN 1 THEN 'discogs' ELSE 'bandcamp' END AS rel, concat('https://', field, '.example/', value) AS url FROM @ext_id WHERE field IS NOT NULL AND value <> '') r) t WHERE nth = 1",
    "streams": "SELECT pk, CASE field WHEN 'feed_url' THEN 1 WHEN 'deezer_playlist_id' THEN 2 ELSE 3 END AS ord, CASE field WHEN 'feed_url' THEN value WHEN 'deezer_playlist_id' THEN concat('https://www.deezer.com/playlist/', value) ELSE concat('https://librivox.org/', value) END AS stream FROM (SELECT DISTINCT pk, field, value FROM @ext_id WHERE field IN ('feed_url', 'deezer_playlist_id', 'librivox_id') AND value <> '') s",
    "claims_to_ids": "SELECT pk, js(claims, '$.P345[0].mainsnak.datavalue.value') AS imdb, try_cast(js(claims, '$.P4947[0].mainsnak.datavalue.value') AS BIGINT) AS tmdb_movie FROM (SELECT DISTINCT pk, concat('{\"P345\": [{\"mainsnak\": {\"datavalue\": {\"value\": \"tt', CAST(pk AS STRING), '\"}}}]', CASE WHEN pk % 2 = 0 THEN concat(', \"P4947\": [{\"mainsnak\": {\"datavalue\": {\"value\": \"', CAST(pk AS STRING), '\"}}}]') ELSE '' END, '}') AS claims FROM @item) c",
    "nested_or_flat": "SELECT pk, coalesce(js(body, '$.artists[0].name'), js(body, '$.artist')) AS artist, coalesce(js(body, '$.album.id'), js(body, '$.albumId')) AS album FROM (SELECT DISTINCT pk, CASE WHEN pk % 2 = 0 THEN concat('{\"artists\": [{\"name\": \"a', CAST(pk AS STRING), '\"}], \"album\": {\"id\": \"b', CAST(pk AS STRING), '\"}}') ELSE concat('{\"artist\": \"c', CAST(pk AS STRING), '\", \"albumId\": \"d\"}') END AS body FROM @item) b",
    "relations_explode": "SELECT item_id, 'title' AS role, title AS name FROM @catalog_item WHERE title <> '' UNION ALL SELECT item_id, 'original', original_title FROM @catalog_item WHERE original_title <> '' UNION ALL SELECT item_id, 'sort', sort_title FROM @catalog_item WHERE sort_title <> ''",
    "cast_explode": "SELECT person_id, coalesce(nullif(trim(a), ''), name) AS credit_name FROM (SELECT person_id, name, unnest_rows(CASE WHEN aliases IS NULL OR arr_len(aliases) = 0 THEN arr(name) ELSE aliases END) AS a FROM @person) x",
    "scan_media_files": "SELECT ext, count(*) AS files, count(CASE WHEN extra THEN 1 END) AS skipped FROM (SELECT DISTINCT pk, CASE pk % 4 WHEN 0 THEN 'mkv' WHEN 1 THEN 'mp3' WHEN 2 THEN 'txt' ELSE 'flac' END AS ext, pk % 11 = 0 AS extra FROM @item) f WHERE ext IN ('mkv', 'mp4', 'avi', 'webm', 'mov', 'm4v', 'ts', 'mp3', 'flac', 'm4a', 'ogg', 'opus', 'wav', 'aac') GROUP BY ext",
    "rename_collisions": "SELECT target, count(*) AS n, min(pk) AS keeps FROM (SELECT DISTINCT pk, concat(title, CASE WHEN year IS NULL THEN '' ELSE concat(' (', CAST(year AS STRING), ')') END, '.mkv') AS target FROM @item WHERE title IS NOT NULL) t GROUP BY target HAVING count(*) > 1",
    "incremental_anti": "SELECT c.item_id FROM (SELECT DISTINCT item_id FROM @catalog_item) c LEFT JOIN (SELECT DISTINCT item_id FROM @catalog_item WHERE overview IS NOT NULL) d ON d.item_id = c.item_id WHERE d.item_id IS NULL",
    "late_rows": "SELECT user_id, event_id, ts, epoch_micros(seen) - epoch_micros(ts) AS behind FROM (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM (SELECT user_id, event_id, ts, event_id + (event_id * 7) % 400 AS arrival FROM @events) a) t WHERE epoch_micros(seen) - epoch_micros(ts) > 600000000",
    "host_slots": "SELECT user_id, event_id, slot FROM (SELECT user_id, event_id, max(epoch_micros(ts) - rn * CAST(60000000 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + rn * CAST(60000000 AS BIGINT) AS slot FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM @events) e) s",
}
