"""People, roles, credits, releases and other roll-ups (neutral SQL)."""

from __future__ import annotations

# The words and phrases that stand for each role.
ROLE_WORDS = {
    "actor": ("actor", "actress", "cast", "acting", "star", "starring", "co star"),
    "voice-actor": ("voice", "voice actor", "voice actress", "voice over", "voiceover", "voice cast", "dub", "seiyuu"),
    "narrator": ("narrator", "narration", "reader", "read by", "narrated by"),
    "host": ("host", "presenter", "anchor", "co host"),
    "guest": ("guest", "guest star", "guest cast"),
    "performer": ("performer", "vocals", "vocal", "vocalist", "singer", "musician", "instrument", "theme song performance"),
    "self": ("self", "himself", "herself", "themselves"),
    "writer": ("writer", "written by", "story", "teleplay", "script", "writing", "series composition"),
    "screenwriter": ("screenplay", "screenwriter", "screen play"),
    "author": ("author", "novel"),
    "lyricist": ("lyricist", "lyrics", "lyrics by"),
    "translator": ("translator", "translation"),
    "adapted-from": ("adapted from", "based on", "source", "original story", "original creator", "characters"),
    "director": ("director", "directed by", "directing", "series director"),
    "creator": ("creator", "created by"),
    "producer": ("producer", "produced by"),
    "executive-producer": ("executive producer", "exec producer", "co executive producer"),
    "showrunner": ("showrunner",),
    "audio-director": ("audio director", "sound director", "voice director", "dubbing director"),
    "sound-designer": ("sound designer", "sound design", "sound effects"),
    "artist": ("artist", "album artist", "primary artist", "main artist"),
    "composer": ("composer", "original music composer", "music", "music by", "score"),
    "conductor": ("conductor",),
    "arranger": ("arranger", "arranged by", "orchestrator", "instrument arranger", "vocal arranger"),
    "producer-music": ("music producer", "record producer"),
    "featured-artist": ("featured artist", "featuring", "feat", "ft"),
    "cinematographer": ("cinematographer", "director of photography", "dop", "dp", "cinematography", "camera"),
    "editor": ("editor", "film editor", "editing"),
    "illustrator": ("illustrator", "illustration"),
    "cover-artist": ("cover artist", "cover", "cover art", "design illustration"),
    "mixer": ("mixer", "mixing", "mixed by", "mix"),
    "mastering": ("mastering", "mastered by", "mastering engineer"),
    "studio": ("studio", "production company", "animation studio"),
    "label": ("label", "record label"),
    "publisher": ("publisher",),
    "network": ("network", "channel", "broadcaster"),
    "distributor": ("distributor", "distribution"),
}
# Words that mean something narrower with one provider.
MUSICBRAINZ_WORDS = {"producer": "producer-music", "instrument": "performer", "vocal": "performer"}
_CLEANED = "trim(rx_sub(rx_sub(rx_sub(rx_sub(lower({x}), ~'\\([^)]*\\)', ' '), ~'[_/-]', ' '), ~'[^\\p{L}\\p{N} ]+', ' '), ~'\\s+', ' '))"


def cleaned(x: str) -> str:
    return _CLEANED.replace("{x}", x)


def role(w: str, overrides: dict[str, str] | None = None, cast: bool = False) -> str:
    """The role a provider's word ``w`` (as ``cleaned``, a column) stands for; an unknown word with hyphens for blanks.

    ``overrides`` are one provider's own words. In a cast list (``cast``) any word about a voice is a voice actor.
    """
    words = {word: r for r, ws in ROLE_WORDS.items() for word in ws} | (overrides or {})
    known = f"map_entry(word_map({', '.join(f'{word!r}, {r!r}' for word, r in words.items())}), {w})"
    cases = [f"WHEN rx_is({w}, ~'\\bcasting\\b') THEN 'casting'", f"WHEN rx_is({w}, ~'\\bdirector\\b') AND rx_is({w}, ~'\\b(voice|dub|dubbing|adr)\\b') THEN 'audio-director'"]
    cases += [f"WHEN rx_is({w}, ~'\\bvoice\\b') THEN 'voice-actor'"] if cast else []
    return f"coalesce({known}, CASE {' '.join(cases)} ELSE replace({w}, ' ', '-') END)"


def role_note(x: str) -> str:
    """The bracketed part of a provider's role word; an empty text without one."""
    return f"trim(rx_get({x}, ~'\\(([^)]*)\\)', 1))"


_CREDIT = f"(SELECT DISTINCT credit_id, person, item_pk, {role('w')} AS role, coalesce(character_name, '') AS character_name, coalesce(note, '') AS note, credit_pos, seen_at FROM (SELECT *, {cleaned('role')} AS w FROM @credit) r)"
_PEOPLE = "(SELECT person_id, name, kind FROM (SELECT person_id, name, kind, row_number() OVER (PARTITION BY person_id ORDER BY updated_at DESC) AS nth FROM @person) d WHERE nth = 1 UNION ALL SELECT person_id, name, kind FROM @house_person)"

TEXTS = {
    "role_norm": f"SELECT word, n, {role('w')} AS role, {role('w', MUSICBRAINZ_WORDS)} AS music_role, {role('w', cast=True)} AS cast_role, {role_note('word')} AS note FROM (SELECT word, n, {cleaned('word')} AS w FROM (SELECT role AS word, count(*) AS n FROM @credit GROUP BY role UNION ALL SELECT v.word, 0 FROM (VALUES ('Casting (US)'), ('Dub Director'), ('Voice_Over'), ('Best Boy'), ('SCREENPLAY'), ('Executive Producer'), ('guest-star (ep. 4)'), ('Read by'), ('Sound Design'), ('Director of Photography'), ('Co/Executive Producer'), ('Voice Recording'), ('Music & Lyrics')) v(word)) x) w WHERE word IS NOT NULL",
    "merge_credits": f"""
        WITH first AS (SELECT item_pk, person, role, character_name, min(credit_id) AS first_id FROM {_CREDIT} c WHERE person IS NOT NULL GROUP BY item_pk, person, role, character_name),
        notes AS (SELECT item_pk, person, role, character_name, note, min(credit_id) AS first_note FROM {_CREDIT} c WHERE person IS NOT NULL AND note <> '' GROUP BY item_pk, person, role, character_name, note),
        joined AS (SELECT item_pk, person, role, character_name, join_agg(note, ', ', first_note, note) AS note FROM notes GROUP BY item_pk, person, role, character_name)
        SELECT f.item_pk, f.person, f.role, f.character_name, coalesce(j.note, '') AS note, row_number() OVER (PARTITION BY f.item_pk, f.role ORDER BY f.first_id) - 1 AS position
        FROM first f LEFT JOIN joined j ON j.item_pk = f.item_pk AND j.person = f.person AND j.role = f.role AND j.character_name = f.character_name""",
    "relations_to_credits": f"SELECT DISTINCT item_pk, person, role FROM {_CREDIT} c WHERE role <> 'other' AND person IS NOT NULL",
    "cast_order": f"SELECT item_pk, credit_id, row_number() OVER (PARTITION BY item_pk ORDER BY coalesce(credit_pos, 9999), credit_id) AS nth FROM {_CREDIT} c WHERE role IN ('actor', 'voice-actor')",
    "appearance_count": f"SELECT c.person, c.role, count(*) AS appearances, count(DISTINCT c.item_pk) AS items, CASE WHEN count(*) = count(DISTINCT c.item_pk) THEN 1 ELSE 0 END AS once_each FROM {_CREDIT} c LEFT JOIN @house_person h ON h.person_id = c.person WHERE h.person_id IS NULL AND c.person IS NOT NULL GROUP BY c.person, c.role",
    "entities_by_role": f"SELECT role, count(DISTINCT person) AS people, count(*) AS credits FROM {_CREDIT} c GROUP BY role",
    "role_kind": f"SELECT role, CASE WHEN role IN ('artist', 'featured-artist', 'performer') THEN 'group' WHEN role IN ('studio', 'label', 'publisher', 'network', 'distributor') THEN 'organisation' WHEN role = 'other' THEN 'other' ELSE 'person' END AS kind, count(*) AS n FROM {_CREDIT} c GROUP BY role",
    "ordered_distinct": f"SELECT item_pk, join_agg(role, ',', first_id) AS roles FROM (SELECT item_pk, role, min(credit_id) AS first_id FROM {_CREDIT} c GROUP BY item_pk, role) t GROUP BY item_pk",
    "hint_except": f"SELECT DISTINCT c.role FROM {_CREDIT} c LEFT JOIN (SELECT unnest_rows(media) AS word FROM @provider) k ON k.word = c.role WHERE k.word IS NULL",
    "featured_latch": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS featured FROM @lineitem",
    "numbered_tracks": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_suppkey) AS track FROM @lineitem",
    "collection_parts": "SELECT norm, pk, row_number() OVER (PARTITION BY norm ORDER BY coalesce(year, 9999), title, pk) AS part FROM (SELECT DISTINCT pk, norm, title, year FROM @item) i",
    "pick_release_modal": """
        SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber FROM (
            SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY same DESC, l_shipdate, l_orderkey, l_suppkey, l_linenumber) AS nth FROM (
                SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_shipdate, count(*) OVER (PARTITION BY l_partkey, l_quantity) AS same, l_linestatus, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey) AS any_official FROM @lineitem) c
            WHERE l_linestatus = 'O' OR any_official = 0) t WHERE nth = 1""",
    "pick_release_earliest": "SELECT l_partkey, min(l_shipdate) AS first_date FROM @lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey",
    "season_rollup": "SELECT o.o_orderkey AS season, count(l.l_linenumber) AS episodes, min(l.l_shipdate) AS first_aired, year(min(l.l_shipdate)) AS year FROM @orders o LEFT JOIN @lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey",
    "int_ranges": "SELECT person, join_agg(CASE WHEN lo = hi THEN CAST(lo AS STRING) ELSE concat(CAST(lo AS STRING), '-', CAST(hi AS STRING)) END, ', ', lo) AS ranges FROM (SELECT person, island, min(credit_pos) AS lo, max(credit_pos) AS hi FROM (SELECT person, credit_pos, credit_pos - row_number() OVER (PARTITION BY person ORDER BY credit_pos) AS island FROM (SELECT DISTINCT person, credit_pos FROM @credit WHERE credit_pos IS NOT NULL AND person IS NOT NULL) d) g GROUP BY person, island) r GROUP BY person",
    "feed_order": "SELECT user_id, CASE WHEN min_by(ts, event_id) > max_by(ts, event_id) THEN 'newest first' ELSE 'oldest first' END AS direction, count(*) AS n FROM @events GROUP BY user_id",
    "watch_totals": "SELECT date_trunc('day', ts) AS cycle, count(CASE WHEN event_type = 'click' THEN 1 END) AS tagged, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, count(CASE WHEN event_type NOT IN ('click', 'error') THEN 1 END) AS skipped FROM @events GROUP BY date_trunc('day', ts)",
    "journal_replay": "SELECT user_id, event_id, event_type AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS undo_order, count(*) OVER (PARTITION BY user_id, event_type) AS same_outcome FROM @events",
    "multi_date": "SELECT item_id, raw, CASE WHEN rx_is(raw, ~'^[0-9]{4}-[0-9]{2}-[0-9]{2}$') OR rx_is(raw, ~'^[0-9]{4}$') THEN raw WHEN rx_is(raw, ~'^[0-9]{1,2} July [0-9]{4}$') THEN concat(rx_get(raw, ~'([0-9]{4})$', 1), '-07-', pad2(CAST(rx_get(raw, ~'^([0-9]{1,2})', 1) AS INT))) WHEN rx_is(raw, ~'^July [0-9]{1,2}, [0-9]{4}$') THEN concat(rx_get(raw, ~'([0-9]{4})$', 1), '-07-', pad2(CAST(rx_get(raw, ~'July ([0-9]{1,2})', 1) AS INT))) WHEN rx_is(raw, ~'^July [0-9]{4}$') THEN concat(rx_get(raw, ~'([0-9]{4})$', 1), '-07') ELSE raw END AS iso FROM (SELECT DISTINCT item_id, CASE item_id % 5 WHEN 0 THEN concat(CAST(1 + item_id % 28 AS STRING), ' July ', CAST(coalesce(year, 1950) AS STRING)) WHEN 1 THEN concat('July ', CAST(1 + item_id % 28 AS STRING), ', ', CAST(coalesce(year, 1950) AS STRING)) WHEN 2 THEN concat('July ', CAST(coalesce(year, 1950) AS STRING)) WHEN 3 THEN CAST(year AS STRING) ELSE 'about then' END AS raw FROM @catalog_item) d WHERE raw IS NOT NULL",
}
