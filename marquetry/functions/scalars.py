"""Scalar functions of the catalogue, as SQL expressions over named inputs.

Each is written once in the neutral dialect of ``plans.dialect`` with ``$x`` for an input, stays inside
code generation (no Python), and is used through ``column(name, x="...")``. Null inputs give null
unless the description says otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquetry.plans.dialect import spark_text


@dataclass(frozen=True)
class Scalar:
    """``expression`` over ``$``-inputs, and the sample inputs its registered query applies it to."""

    about: str
    expression: str
    table: str
    key: str
    inputs: dict[str, str]


# Vocabularies of the catalogue domain.
VIDEO_PAGES = (("youtube", "https://www.youtube.com/watch?v="), ("vimeo", "https://vimeo.com/"))
EXTRA_TYPES = ("trailer", "teaser", "behind-the-scenes", "making-of", "featurette", "deleted-scene", "interview", "clip", "scene", "short", "music-video", "live-session", "other")
RELEASE_WORDS = "1080p|720p|2160p|4k|hdr|x264|x265|h264|h265|hevc|webrip|web-dl|webdl|bluray|brrip|dvdrip|hdtv|amzn|nf|remux|proper|repack|extended"
VARIANT_WORDS = (("director", "directors_cut"), ("extended", "extended"), ("theatrical", "theatrical"), ("unrated", "unrated"), ("final cut", "final_cut"), ("special edition", "special_edition"), ("remaster", "remastered"))
PICTURE_CUES = (("colorized", "colorized"), ("colourized", "colorized"), ("black and white", "black_and_white"), ("black & white", "black_and_white"), ("b&w", "black_and_white"), ("imax", "imax"), ("3d", "3d"), ("4k", "4k"), ("uhd", "4k"))
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"))
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SERIES_KINDS = ("series", "season", "episode")


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _cases(subject: str, pairs: tuple[tuple[str, str], ...]) -> str:
    """The first pair whose word stands in the subject, in the pairs' order."""
    return "CASE " + " ".join(f"WHEN instr({subject}, '{w}') > 0 THEN '{v}'" for w, v in pairs) + " END"


def _entities(text: str) -> str:
    for name, char in ENTITIES:
        text = f"replace({text}, '{name}', '{char}')"
    return text


_MONTH = "CASE " + " ".join(f"WHEN lower($m) = '{m}' THEN '{i:02d}'" for i, m in enumerate(MONTHS, 1)) + " END"
_STEM = "concat(replace(title, ' ', '.'), '.', coalesce(CAST(year AS STRING), ''), '.1080p.WEB-DL')"
_NAME = "concat(title, CASE WHEN year IS NULL THEN '' ELSE concat(' (', CAST(year AS STRING), ')') END, CASE WHEN pk % 3 = 0 THEN concat(' {tmdb-', CAST(pk AS STRING), '}') WHEN pk % 3 = 1 THEN concat(' [imdbid-tt', CAST(1000000 + pk AS STRING), ']') ELSE concat(' {tvdb-', CAST(pk AS STRING), '}') END)"
_TUBE = "CASE WHEN pk % 4 = 0 THEN concat(title, ' [abc_DEF-', CAST(100 + pk % 900 AS STRING), ']') WHEN pk % 4 = 1 THEN concat('xyz_ABC-', CAST(100 + pk % 900 AS STRING)) WHEN pk % 4 = 2 THEN concat('up_d558tMKj', CAST(100 + pk % 900 AS STRING), '_', title) ELSE concat(title, ' [Bluray-1080p]') END"
_CLOCK = "CASE WHEN event_id % 4 = 0 THEN concat(CAST(event_id % 3 AS STRING), ':', CAST(10 + event_id % 50 AS STRING), ':', CAST(10 + event_id % 47 AS STRING)) WHEN event_id % 4 = 1 THEN concat(CAST(event_id % 60 AS STRING), ':', CAST(10 + event_id % 49 AS STRING)) WHEN event_id % 4 = 2 THEN CAST(event_id % 5000 AS STRING) ELSE 'soon' END"
_RUNS = "CASE WHEN event_id % 6 = 0 THEN concat(CAST(event_id % 3 AS STRING), 'h ', CAST(event_id % 60 AS STRING), 'm') WHEN event_id % 6 = 1 THEN concat(CAST(event_id % 3 AS STRING), ',5h') WHEN event_id % 6 = 2 THEN concat('1:', CAST(10 + event_id % 49 AS STRING)) WHEN event_id % 6 = 3 THEN concat(CAST(event_id % 300 AS STRING), ' min') WHEN event_id % 6 = 4 THEN CAST(event_id % 2000 AS STRING) ELSE event_type END"

_CLEAN = f"trim(BOTH ' -.' FROM rx_sub(rx_sub(replace(replace($t, '.', ' '), '_', ' '), ~'(?i)\\b({RELEASE_WORDS})\\b', ' '), ~'\\s+', ' '))"

_TITLE_PART = "CASE WHEN rx_is($x, ~'[Ss][0-9]{1,2}[EeXx][0-9]{1,3}') THEN rx_get($x, ~'^(.*?)[Ss][0-9]{1,2}[EeXx][0-9]{1,3}', 1) WHEN rx_is($x, ~'[(.\\s](19|20)[0-9]{2}([).\\s]|$)') THEN rx_get($x, ~'^(.*?)[(.\\s](?:19|20)[0-9]{2}(?:[).\\s]|$)', 1) ELSE $x END"
_SHORT_MONTH = "CASE lower(rx_get(trim($x), ~'[0-9]{1,2} ([A-Za-z]{3}) [0-9]{4}', 1)) " + " ".join(f"WHEN '{m[:3]}' THEN '{i:02d}'" for i, m in enumerate(MONTHS, 1)) + " END"

SCALARS: dict[str, Scalar] = {
    "norm_entity_name": Scalar("Lower case, signs to one blank; accents stay.", "trim(rx_sub(lower($x), ~'[^\\p{L}\\p{N}]+', ' '))", "person", "person_id", {"x": "name"}),
    "url_norm": Scalar(
        "An address with its host in lower case and without query, fragment and closing slash; other text trimmed.",
        "CASE WHEN instr($x, '://') > 0 THEN concat(rx_get(trim($x), ~'^([^:/?#]+)://', 1), '://', lower(rx_get(trim($x), ~'^[^:/?#]+://([^/?#]*)', 1)), rx_sub(rx_get(trim($x), ~'^[^:/?#]+://[^/?#]*([^?#]*)', 1), ~'/+$', '')) ELSE trim($x) END",
        "item", "pk", {"x": "CASE WHEN pk % 5 = 0 THEN concat(' ', title, ' ') ELSE concat('https://WWW.Example', CAST(pk % 7 AS STRING), '.ORG/a/', CAST(pk AS STRING), CASE WHEN pk % 2 = 0 THEN '/' ELSE '' END, CASE WHEN pk % 3 = 0 THEN '?q=1' ELSE '' END, CASE WHEN pk % 4 = 0 THEN '#top' ELSE '' END) END"}),
    "html_plain_text": Scalar(
        "Text without tags: breaks to new lines, the common entities decoded, lines trimmed, runs of blank lines cut to one, 4000 characters at most.",
        "substring(trim(BOTH ~'\n ' FROM rx_sub(rx_sub(" + _entities("rx_sub(rx_sub($x, ~'(?i)<\\s*(br|/p)\\s*/?>', '\n'), ~'<[^>]+>', '')") + ", ~'[ \\t]*\\n[ \\t]*', '\n'), ~'\\n{3,}', '\n\n')), 1, 4000)",
        "documents", "doc_id", {"x": "text"}),
    "year_extract": Scalar("The first run of exactly four digits between 1000 and 2200.", "CAST(arr_get(arr_filter(rx_all($x, ~'[0-9]+', 0), e -> length(e) = 4 AND e >= '1000' AND e <= '2200'), 1) AS INT)", "item", "pk", {"x": "concat(title, ' 0999 12345 ', coalesce(js(data, '$.release_date'), 'n.d.'))"}),
    "year_prefix": Scalar("The year of a date text that begins with one.", "CASE WHEN rx_is(trim($x), ~'^[0-9]{4}') THEN CAST(substring(trim($x), 1, 4) AS INT) END", "catalog_item", "item_id", {"x": "coalesce(release_date, title)"}),
    "iso_date": Scalar("The first ten characters of a date text that begins with a year.", "CASE WHEN rx_is(trim($x), ~'^[0-9]{4}') THEN substring(trim($x), 1, 10) END", "catalog_item", "item_id", {"x": "CASE WHEN item_id % 2 = 0 THEN concat(release_date, 'T00:00:00Z') ELSE release_date END"}),
    "to_minutes": Scalar("Positive numbers in units of u minutes; else null.", "CASE WHEN try_cast($x AS DOUBLE) > 0 THEN round(try_cast($x AS DOUBLE) * $u, 2) END", "events", "event_id", {"x": "CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(event_id % 977 AS STRING) END", "u": "CAST(0.5 AS DOUBLE)"}),
    "safe_int": Scalar("A whole number in text (signed, with outer blanks); anything else is null.", "CASE WHEN rx_is(trim($x), ~'^[+-]?[0-9]{1,18}$') THEN CAST(trim($x) AS BIGINT) END", "ext_id", "pk", {"x": "value"}),
    "video_key": Scalar("Site and key of a YouTube or Vimeo address; empty for others.",
        "CASE WHEN rx_is(trim($x), ~'^https?://((www|m|music)\\.)?(youtube\\.com/(watch\\?(.*&)?v=|embed/|shorts/)|youtu\\.be/)[A-Za-z0-9_-]{6,}') THEN concat('youtube:', rx_get(trim($x), ~'^https?://(?:(?:www|m|music)\\.)?(?:youtube\\.com/(?:watch\\?(?:.*&)?v=|embed/|shorts/)|youtu\\.be/)([A-Za-z0-9_-]{6,})', 1)) WHEN rx_is(trim($x), ~'^https?://(www\\.|player\\.)?vimeo\\.com/(video/)?[0-9]+') THEN concat('vimeo:', rx_get(trim($x), ~'^https?://(?:www\\.|player\\.)?vimeo\\.com/(?:video/)?([0-9]+)', 1)) ELSE '' END",
        "item", "pk", {"x": "CASE WHEN pk % 4 = 0 THEN concat('https://www.youtube.com/watch?list=a&v=abc', CAST(100000 + pk AS STRING)) WHEN pk % 4 = 1 THEN concat(' https://youtu.be/Q_', CAST(100000 + pk AS STRING)) WHEN pk % 4 = 2 THEN concat('https://player.vimeo.com/video/', CAST(pk AS STRING)) ELSE concat('https://video.example/', CAST(pk AS STRING)) END"}),
    "video_url": Scalar("The page of a video by site and key; empty for unknown sites.", "CASE WHEN $k = '' THEN '' " + " ".join(f"WHEN lower(trim($s)) = '{s}' THEN concat('{u}', $k)" for s, u in VIDEO_PAGES) + " ELSE '' END", "item", "pk", {"s": "CASE WHEN pk % 3 = 0 THEN ' YouTube ' WHEN pk % 3 = 1 THEN 'vimeo' ELSE 'other' END", "k": "CASE WHEN pk % 7 = 0 THEN '' ELSE CAST(pk AS STRING) END"}),
    "first_nonempty": Scalar("The first of two texts that is not blank; empty when both are.", "coalesce(nullif(trim($a), ''), nullif(trim($b), ''), '')", "catalog_item", "item_id", {"a": "original_title", "b": "title"}),
    "full_title": Scalar("A file's title with its subtitle, as the file-name parser cleans it.", f"nullif({_CLEAN.replace('$t', 'rx_sub($x, ~\'\\\\s*[(]?(19|20)[0-9]{2}[)]?.*$\', \'\')')}, '')", "item", "pk", {"x": "concat(title, ' - Part Two (', coalesce(CAST(year AS STRING), ''), ').1080p')"}),
    "whole_id": Scalar("An id of a field of whole numbers: digits as such a number, anything else null.", "CASE WHEN rx_is(trim($x), ~'^[0-9]{1,18}$') THEN CAST(CAST(trim($x) AS BIGINT) AS STRING) END", "ext_id", "pk", {"x": "value"}),
    "public_address": Scalar("Whether a dotted address is a public one; null for no such address.", "CASE WHEN rx_is($x, ~'^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$') THEN NOT rx_is($x, ~'^(0|10|127)[.]|^169[.]254[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]|^192[.]168[.]|^192[.]0[.][02][.]|^198[.]1[89][.]|^198[.]51[.]100[.]|^203[.]0[.]113[.]|^100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.]|^(22[4-9]|2[34][0-9]|25[0-5])[.]') END", "events", "event_id", {"x": "concat(CAST(event_id % 256 AS STRING), '.', CAST((event_id * 7) % 256 AS STRING), '.', CAST((event_id * 13) % 256 AS STRING), '.', CAST(event_id % 300 AS STRING))"}),
    "cover_url": Scalar("The address of the first positive cover id of a list.", "concat('https://covers.openlibrary.org/b/id/', CAST(arr_get(arr_filter($x, e -> e > 0), 1) AS STRING), '-L.jpg')", "item", "pk", {"x": "arr(pk % 3 - 1, -pk, pk % 5)"}),
    "to_text": Scalar("A number as trimmed text, as it is written; empty for null, NaN and infinite.", "CASE WHEN $x IS NULL OR isnan($x) OR abs($x) = CAST('Infinity' AS DOUBLE) THEN '' WHEN abs($x) >= 10000000 AND $x = floor($x) THEN concat(CAST(CAST($x AS BIGINT) AS STRING), '.0') ELSE CAST($x AS STRING) END", "item", "pk", {"x": "rank"}),
    "json_safe": Scalar("A number as JSON holds it: NaN and infinite are null.", "CASE WHEN isnan($x) OR abs($x) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE $x END", "catalog_item", "item_id", {"x": "runtime_min"}),
    "clean_isbn": Scalar("An ISBN without hyphens, in upper case.", "upper(replace($x, '-', ''))", "ext_id", "pk", {"x": "CASE WHEN starts(field, 'isbn') THEN concat(substring(value, 1, 3), '-', substring(value, 4)) ELSE lower(value) END"}),
    "isbn_convert": Scalar(
        "The 13-digit form of an ISBN-10 and the 10-digit form of a 978 ISBN-13; null for others (979 has no 10-digit form).",
        "CASE WHEN rx_is(upper(replace($x, '-', '')), ~'^[0-9]{9}[0-9X]$') THEN concat('978', substring(replace($x, '-', ''), 1, 9), CAST((10 - (38 + " + " + ".join(f"CAST(substring(replace($x, '-', ''), {i}, 1) AS INT) * {3 if i % 2 else 1}" for i in range(1, 10)) + ") % 10) % 10 AS STRING)) WHEN rx_is(replace($x, '-', ''), ~'^978[0-9]{10}$') THEN concat(substring(replace($x, '-', ''), 4, 9), CASE (11 - (" + " + ".join(f"CAST(substring(replace($x, '-', ''), {i + 3}, 1) AS INT) * {11 - i}" for i in range(1, 10)) + ") % 11) % 11 WHEN 10 THEN 'X' ELSE CAST((11 - (" + " + ".join(f"CAST(substring(replace($x, '-', ''), {i + 3}, 1) AS INT) * {11 - i}" for i in range(1, 10)) + ") % 11) % 11 AS STRING) END) END",
        "item", "pk", {"x": "CASE WHEN pk % 3 = 0 THEN concat('0-', CAST(10000000 + pk AS STRING), '-', CASE WHEN pk % 2 = 0 THEN 'X' ELSE '5' END) WHEN pk % 3 = 1 THEN concat('978-', CAST(1000000000 + pk AS STRING)) ELSE concat('979', CAST(1000000000 + pk AS STRING)) END"}),
    "slugify": Scalar("The slug of a track title: letters, digits and single hyphens.", "rx_sub(trim(BOTH '-' FROM rx_sub(rx_sub(lower($x), ~'[^a-z0-9\\s_-]+', ''), ~'[\\s_]+', '-')), ~'-{2,}', '-')", "item", "pk", {"x": "title"}),
    "edit_name": Scalar(
        "The own part of an edit's title after the film's title, where a sign or blank follows it; else the whole title.",
        "CASE WHEN trim($o) <> '' AND starts(lower(trim($x)), lower(trim($o))) AND rx_is(substring(trim($x), length(trim($o)) + 1), ~'^[\\s:|/(–—-]') AND trim(rx_sub(substring(trim($x), length(trim($o)) + 1), ~'^[\\s:|/–—-]+', '')) <> '' THEN trim(rx_sub(substring(trim($x), length(trim($o)) + 1), ~'^[\\s:|/–—-]+', '')) ELSE trim($x) END",
        "catalog_item", "item_id", {"x": "concat(title, CASE WHEN item_id % 3 = 0 THEN ': FanFix' WHEN item_id % 3 = 1 THEN 's Special' ELSE '' END)", "o": "title"}),
    "month_year_date": Scalar("'April 2026' as 2026-04; ISO dates as they are; else null.", "CASE WHEN rx_is(lower(trim($x)), ~'^[0-9]{4}(-[0-9]{2}){0,2}$') THEN lower(trim($x)) WHEN rx_is(lower(trim($x)), ~'^[a-z]+ [0-9]{4}$') AND (" + _MONTH.replace("$m", "rx_get(trim($x), ~'^([A-Za-z]+)', 1)") + ") IS NOT NULL THEN concat(rx_get(trim($x), ~'([0-9]{4})$', 1), '-', " + _MONTH.replace("$m", "rx_get(trim($x), ~'^([A-Za-z]+)', 1)") + ") END", "catalog_item", "item_id", {"x": "CASE WHEN item_id % 3 = 0 THEN concat('April ', CAST(coalesce(year, 2000) AS STRING)) WHEN item_id % 3 = 1 THEN release_date ELSE concat('Smarch ', CAST(year AS STRING)) END"}),
    "runtime_parse": Scalar(
        "Minutes of '1h 45m', '1,5h', '1:45', '105 min' or '105'; null for none and for more than a day.",
        "CASE WHEN (CASE WHEN rx_is($x, ~'^[0-9]+:[0-9]{2}') THEN CAST(rx_get($x, ~'^([0-9]+):', 1) AS DOUBLE) * 60 + CAST(rx_get($x, ~'^[0-9]+:([0-9]{2})', 1) AS DOUBLE) WHEN rx_is($x, ~'^[0-9]+([.,][0-9]+)?$') THEN CAST(replace($x, ',', '.') AS DOUBLE) WHEN rx_is($x, ~'[0-9]+([.,][0-9]+)?\\s*h') THEN CAST(replace(rx_get($x, ~'([0-9]+(?:[.,][0-9]+)?)\\s*h', 1), ',', '.') AS DOUBLE) * 60 + coalesce(try_cast(nullif(rx_get($x, ~'h\\s*([0-9]+)', 1), '') AS DOUBLE), 0) WHEN rx_is($x, ~'[0-9]+\\s*m') THEN CAST(rx_get($x, ~'([0-9]+)\\s*m', 1) AS DOUBLE) END) BETWEEN 0.01 AND 1440 THEN round((CASE WHEN rx_is($x, ~'^[0-9]+:[0-9]{2}') THEN CAST(rx_get($x, ~'^([0-9]+):', 1) AS DOUBLE) * 60 + CAST(rx_get($x, ~'^[0-9]+:([0-9]{2})', 1) AS DOUBLE) WHEN rx_is($x, ~'^[0-9]+([.,][0-9]+)?$') THEN CAST(replace($x, ',', '.') AS DOUBLE) WHEN rx_is($x, ~'[0-9]+([.,][0-9]+)?\\s*h') THEN CAST(replace(rx_get($x, ~'([0-9]+(?:[.,][0-9]+)?)\\s*h', 1), ',', '.') AS DOUBLE) * 60 + coalesce(try_cast(nullif(rx_get($x, ~'h\\s*([0-9]+)', 1), '') AS DOUBLE), 0) WHEN rx_is($x, ~'[0-9]+\\s*m') THEN CAST(rx_get($x, ~'([0-9]+)\\s*m', 1) AS DOUBLE) END), 2) END",
        "events", "event_id", {"x": _RUNS}),
    "duration_parse": Scalar(
        "Minutes of seconds or [hh:]mm:ss; null when it is no duration or not positive.",
        "CASE WHEN rx_is($x, ~'^[0-9]+(:[0-9]+){0,2}$') THEN nullif(round((coalesce(try_cast(arr_get(rx_split($x, ':'), 1) AS DOUBLE), 0) * CASE arr_len(rx_split($x, ':')) WHEN 3 THEN 3600 WHEN 2 THEN 60 ELSE 1 END + coalesce(try_cast(arr_get(rx_split($x, ':'), 2) AS DOUBLE), 0) * CASE arr_len(rx_split($x, ':')) WHEN 3 THEN 60 ELSE 1 END + coalesce(try_cast(arr_get(rx_split($x, ':'), 3) AS DOUBLE), 0)) / 60, 2), 0) END",
        "events", "event_id", {"x": _CLOCK}),
    "extra_type": Scalar("The vocabulary's type of an extra; 'other' for words it has none for.", f"CASE WHEN replace(trim(rx_sub(rx_sub(lower($x), ~'[-_]', ' '), ~'\\s+', ' ')), ' ', '-') IN ({_in(EXTRA_TYPES)}) THEN replace(trim(rx_sub(rx_sub(lower($x), ~'[-_]', ' '), ~'\\s+', ' ')), ' ', '-') WHEN trim(rx_sub(rx_sub(lower($x), ~'[-_]', ' '), ~'\\s+', ' ')) = 'live performance' THEN 'live-session' ELSE 'other' END", "item", "pk", {"x": "CASE pk % 8 WHEN 0 THEN ' Behind the_Scenes' WHEN 1 THEN 'Live  Performance' WHEN 2 THEN 'TRAILER' WHEN 3 THEN 'music-video' WHEN 4 THEN 'Bloopers' WHEN 5 THEN kind ELSE 'Deleted Scene' END"}),
    "parse_video_title": Scalar("The title in a video file's name, without release words.", _CLEAN.replace("$t", "CASE WHEN rx_is($x, ~'[Ss][0-9]{1,2}[EeXx][0-9]{1,3}') THEN rx_get($x, ~'^(.*?)[Ss][0-9]{1,2}[EeXx][0-9]{1,3}', 1) WHEN rx_is($x, ~'[(.\\s](19|20)[0-9]{2}([).\\s]|$)') THEN rx_get($x, ~'^(.*?)[(.\\s](?:19|20)[0-9]{2}(?:[).\\s]|$)', 1) ELSE $x END"), "item", "pk", {"x": f"CASE WHEN pk % 3 = 0 THEN concat(replace(title, ' ', '.'), '.S', pad2(pk % 20), 'E', pad2(pk % 30), '.720p') ELSE {_STEM} END"}),
    "parse_video_name": Scalar("Title, year, season and episode in a video file's name, joined by bars.", "concat(" + _CLEAN.replace("$t", _TITLE_PART) + ", '|', coalesce(nullif(CASE WHEN rx_is($x, ~'[Ss][0-9]{1,2}[EeXx][0-9]{1,3}') THEN '' ELSE rx_get($x, ~'[(.\\s]((?:19|20)[0-9]{2})(?:[).\\s]|$)', 1) END, ''), '-'), '|', coalesce(CAST(try_cast(nullif(rx_get($x, ~'[Ss]([0-9]{1,2})[EeXx][0-9]{1,3}', 1), '') AS INT) AS STRING), '-'), '|', coalesce(CAST(try_cast(nullif(rx_get($x, ~'[Ss][0-9]{1,2}[EeXx]([0-9]{1,3})', 1), '') AS INT) AS STRING), '-'))", "item", "pk", {"x": f"CASE WHEN pk % 3 = 0 THEN concat(replace(title, ' ', '.'), '.S', pad2(pk % 20), 'E', pad2(pk % 30), '.720p') ELSE {_STEM} END"}),
    "rfc_date": Scalar("The ISO date of an RFC 2822 date; null when it is none.", "CASE WHEN rx_is(trim($x), ~'^([A-Za-z]{3}, )?[0-9]{1,2} [A-Za-z]{3} [0-9]{4}( |$)') AND (" + _SHORT_MONTH + ") IS NOT NULL THEN concat(rx_get(trim($x), ~'[A-Za-z]{3} ([0-9]{4})', 1), '-', " + _SHORT_MONTH + ", '-', pad2(CAST(rx_get(trim($x), ~'([0-9]{1,2}) [A-Za-z]{3} [0-9]{4}', 1) AS INT))) END", "events", "event_id", {"x": "CASE event_id % 4 WHEN 0 THEN concat('Tue, ', CAST(1 + event_id % 28 AS STRING), ' Feb 2022 10:00:00 +0000') WHEN 1 THEN concat(CAST(1 + event_id % 28 AS STRING), ' nov 1999') WHEN 2 THEN concat('Mon, 3 Foo ', CAST(event_id AS STRING)) ELSE event_type END"}),
    "embedded_ids": Scalar("The ids a file's name carries in brackets, as scheme:value joined by blanks.", "trim(concat(CASE WHEN rx_is($x, ~'(?i)[\\[{]tmdb(id)?[-=][0-9]+[\\]}]') THEN concat(CASE WHEN rx_is($x, ~'[Ss][0-9]{1,2}[EeXx][0-9]{1,3}') THEN 'tmdb_tv:' ELSE 'tmdb_movie:' END, rx_get($x, ~'(?i)[\\[{]tmdb(?:id)?[-=]([0-9]+)[\\]}]', 1), ' ') ELSE '' END, CASE WHEN rx_is($x, ~'(?i)[\\[{]imdb(id)?[-=]tt[0-9]+[\\]}]') THEN concat('imdb:', rx_get($x, ~'(?i)[\\[{]imdb(?:id)?[-=](tt[0-9]+)[\\]}]', 1), ' ') ELSE '' END, CASE WHEN rx_is($x, ~'(?i)[\\[{]tvdb(id)?[-=][0-9]+[\\]}]') THEN concat('tvdb:', rx_get($x, ~'(?i)[\\[{]tvdb(?:id)?[-=]([0-9]+)[\\]}]', 1)) ELSE '' END))", "item", "pk", {"x": _NAME}),
    "youtube_id": Scalar("The 11-character id in a file's stem: in brackets, alone, or between underscores, in this order.", "coalesce(nullif(rx_get($x, ~'\\[([A-Za-z0-9_-]{11})\\]', 1), ''), nullif(rx_get($x, ~'^([A-Za-z0-9_-]{11})$', 1), ''), nullif(rx_get($x, ~'_([A-Za-z0-9_-]{11})_', 1), ''))", "item", "pk", {"x": _TUBE}),
    "media_kind": Scalar("music, episodic or movie by medium and season.", "CASE WHEN $m IN ('music', 'music_video', 'album', 'track') THEN 'music' WHEN $m IN ('series', 'tv', 'anime') OR $s IS NOT NULL THEN 'episodic' ELSE 'movie' END", "provider_match", "match_id", {"m": "lower(signals.medium)", "s": "signals.season"}),
    "rename_target": Scalar(
        "A file's target name from title, year and id, without characters that file systems refuse.",
        "concat(coalesce(nullif(trim(BOTH ' .' FROM rx_sub(rx_sub(concat(coalesce(nullif($t, ''), 'untitled'), CASE WHEN $y IS NULL THEN '' ELSE concat(' (', CAST($y AS STRING), ')') END, CASE WHEN $i IS NULL THEN '' ELSE concat(' {tmdb-', CAST($i AS STRING), '}') END), ~'[<>:\"/\\\\|?*\\x00-\\x1f]', ''), ~'\\s+', ' ')), ''), 'untitled'), '.mkv')",
        "item", "pk", {"t": "CASE WHEN pk % 9 = 0 THEN concat(' ..', title, '?: <x>') ELSE title END", "y": "year", "i": "CASE WHEN pk % 4 = 0 THEN pk END"}),
    "variant_kind": Scalar("The kind of cut a version's text names, first word of the list that stands in it.", _cases("lower($x)", VARIANT_WORDS), "catalog_item", "item_id", {"x": "CASE item_id % 6 WHEN 0 THEN concat(title, ' Extended Cut') WHEN 1 THEN 'Director''s Cut (Remastered)' WHEN 2 THEN 'Theatrical' WHEN 3 THEN title WHEN 4 THEN 'The Final Cut' END"}),
    "picture_format": Scalar("The picture format that texts name, first cue of the list that stands in them.", _cases("lower($x)", PICTURE_CUES), "catalog_item", "item_id", {"x": "CASE item_id % 6 WHEN 0 THEN 'IMAX 3D' WHEN 1 THEN 'Black & White' WHEN 2 THEN '4K UHD' WHEN 3 THEN title WHEN 4 THEN 'Colourized B&W' END"}),
    "id_validate": Scalar("What is wrong with an id of a scheme; null when nothing is.", "CASE WHEN trim($v) = '' OR $v IS NULL THEN 'value is required' WHEN length(trim($v)) > 200 THEN 'value is too long' WHEN $s = 'imdb' AND NOT rx_is(trim($v), ~'^tt[0-9]{7,10}$') THEN 'invalid imdb id' WHEN $s IN ('musicbrainz_artist') AND NOT rx_is(lower(trim($v)), ~'^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$') THEN 'invalid musicbrainz id' WHEN $s IN ('tmdb', 'tvdb', 'tvmaze') AND NOT rx_is(trim($v), ~'^0*[1-9][0-9]{0,9}$') THEN concat('invalid ', $s, ' id') WHEN $s IN ('isbn_10', 'isbn_13') AND NOT rx_is(replace(trim($v), '-', ''), ~'^([0-9]{9}[0-9Xx]|[0-9]{13})$') THEN 'invalid isbn id' WHEN $s = 'olid' AND NOT rx_is(trim($v), ~'^OL[0-9]+[AMW]$') THEN 'invalid openlibrary id' END", "ext_id", "pk", {"s": "field", "v": "value"}),
    "redact_url": Scalar("A message with the values of credential parameters masked.", "rx_sub($x, ~'(?i)((?:api_?key|access_token|token|key|secret|password)=)[^&\\s]+', " + "'\\1***')", "item", "pk", {"x": "concat('GET https://h.example/x?q=', CAST(pk AS STRING), '&Api_Key=', norm, '&token=t', CAST(pk AS STRING), ' failed')"}),
    "finite": Scalar("A number that is neither NaN nor infinite; else null.", "CASE WHEN NOT isnan($x) AND abs($x) < CAST('Infinity' AS DOUBLE) THEN $x END", "item", "pk", {"x": "rank"}),
    "etag": Scalar("The first 32 digits of the SHA-256 of a body.", "substring(hash256($x), 1, 32)", "api_payload", "payload_id", {"x": "body"}),
    "ids_hash": Scalar("SHA-1 of a canonical id text.", "sha1(concat('{\"', $f, '\": \"', $v, '\"}'))", "ext_id", "pk", {"f": "field", "v": "value"}),
    "signal_hash": Scalar("SHA-256 of the normalised fields of a description.", "hash256(concat_ws('|', trim(rx_sub(lower(coalesce($t, '')), ~'[^\\p{L}\\p{N}]+', ' ')), trim(rx_sub(lower(coalesce($a, '')), ~'[^\\p{L}\\p{N}]+', ' ')), coalesce(CAST($y AS STRING), ''), coalesce(lower($m), '')))", "provider_match", "match_id", {"t": "signals.title", "a": "signals.artist", "y": "signals.year", "m": "signals.medium"}),
    "season_key": Scalar("Series and season of a composite value 'series/season'.", "CASE WHEN rx_is($x, ~'^[0-9]+/[0-9]+$') THEN concat('series ', rx_get($x, ~'^([0-9]+)/', 1), ' season ', CAST(CAST(rx_get($x, ~'/([0-9]+)$', 1) AS INT) AS STRING)) END", "item", "pk", {"x": "CASE WHEN pk % 3 = 0 THEN CAST(pk AS STRING) ELSE concat(CAST(pk AS STRING), '/', pad2(pk % 12)) END"}),
    "ol_key": Scalar("The last part of a path-like key.", "rx_get(rx_sub(coalesce($x, ''), ~'/+$', ''), ~'([^/]*)$', 1)", "item", "pk", {"x": "CASE WHEN pk % 3 = 0 THEN concat('/works/OL', CAST(pk AS STRING), 'W/') WHEN pk % 3 = 1 THEN concat('OL', CAST(pk AS STRING), 'M') END"}),
    "strip_artist_prefix": Scalar("A track's title without 'Artist - ' before it.", "CASE WHEN $a <> '' AND starts(lower($t), lower($a)) THEN coalesce(nullif(rx_sub(substring($t, length($a) + 1), ~'^[\\s:–—-]+', ''), ''), $t) ELSE $t END", "item", "pk", {"t": "CASE WHEN pk % 2 = 0 THEN concat(norm, ' - ', title) ELSE title END", "a": "norm"}),
    "headline": Scalar("The title without its subtitle when the question is that short form.", "CASE WHEN lower(trim(rx_get($t, ~'^([^:]*):', 1))) = lower(trim($q)) AND instr($t, ':') > 0 THEN trim(rx_get($t, ~'^([^:]*):', 1)) ELSE $t END", "catalog_item", "item_id", {"t": "title", "q": "CASE WHEN item_id % 2 = 0 THEN rx_get(title, ~'^([^:]*)', 1) ELSE title END"}),
    "clean_video_title": Scalar("A video's title without '(YYYY)' and what follows a pipe.", "rx_sub(rx_sub(rx_sub(rx_sub($x, ~'\\|.*$', ''), ~'\\(\\s*[0-9]{4}\\s*\\)', ' '), ~'\\s+', ' '), ~'^ +| +$', '')", "item", "pk", {"x": "concat(title, ' (', coalesce(CAST(year AS STRING), '19'), ') | Full Movie ', kind)"}),
    "url_allowlist": Scalar("Whether an address is https, without port and user, on an allowed host.", "rx_is(lower($x), ~'^https://([a-z0-9-]+\\.)*(bandcamp\\.com|example\\.org)(/|$)')", "item", "pk", {"x": "CASE pk % 5 WHEN 0 THEN concat('https://a', CAST(pk AS STRING), '.bandcamp.com/track/x') WHEN 1 THEN 'http://bandcamp.com/' WHEN 2 THEN 'https://bandcamp.com.evil.example/' WHEN 3 THEN concat('https://user', chr(64), 'bandcamp.com:99/') ELSE 'https://Example.org' END"}),
    "is_extra_path": Scalar("Whether a path is a trailer, sample or other extra.", "rx_is(lower($x), ~'/(trailers|extras|featurettes|behind the scenes|deleted scenes|interviews|sample|samples|other)/') OR rx_is(rx_sub(lower($x), ~'\\.[a-z0-9]{2,4}$', ''), ~'[-.](trailer|sample|behindthescenes|featurette|deleted|interview|scene|short|clip|other)$') OR rx_is(lower(rx_get($x, ~'([^/]*)$', 1)), ~'[._-]sample([._-]|$)')", "item", "pk", {"x": "CASE pk % 7 WHEN 0 THEN concat('/m/', title, '/Extras/a.mkv') WHEN 1 THEN concat('/m/', title, '-trailer.mp4') WHEN 2 THEN concat('/m/x.sample.', kind, '.mkv') WHEN 3 THEN '/m/The Sample.mkv' ELSE concat('/m/', title, '.mkv') END"}),
    "nfo_render": Scalar(
        "A sidecar XML text of a title, its year, runtime and id.",
        "concat('<?xml version=\"1.0\" encoding=\"UTF-8\" standalone=\"yes\"?>', chr(10), '<movie>', chr(10), '  <title>', replace(replace(replace($t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</title>', chr(10), CASE WHEN $r > 0 THEN concat('  <runtime>', CAST(CAST(greatest(1, half_even($r / 60, 0)) AS BIGINT) AS STRING), '</runtime>', chr(10)) ELSE '' END, CASE WHEN $y > 0 THEN concat('  <year>', CAST($y AS STRING), '</year>', chr(10)) ELSE '' END, '  <uniqueid type=\"tmdb\">', CAST($i AS STRING), '</uniqueid>', chr(10), '</movie>', chr(10))",
        "catalog_item", "item_id", {"t": "title", "y": "year", "r": "CASE WHEN isnan(runtime_min) THEN NULL ELSE runtime_min * 60 END", "i": "item_id"}),
}


#: Scalars of numbers that may be NaN, which no two engines compare alike; their inputs are shown as null.
NUMERIC = ("to_text", "json_safe", "finite")


def expression(name: str, **inputs: str) -> str:
    """The neutral SQL of a scalar over the given input expressions."""
    scalar = SCALARS[name]
    missing = set(scalar.inputs) - set(inputs)
    if missing:
        raise TypeError(f"{name} needs {', '.join(sorted(missing))}")
    return re.sub(r"\$([a-z])\b", lambda m: f"({inputs[m.group(1)]})" if m.group(1) in inputs else m.group(0), scalar.expression)


def column(name: str, **inputs: str) -> Column:
    """A scalar over columns of the DataFrame it is used in, e.g. ``column("slugify", x="title")``."""
    return F.expr(spark_text(expression(name, **inputs)))


def query_text(name: str) -> str:
    """The registered query of a scalar: key, inputs and result over its whole sample table."""
    s = SCALARS[name]
    inputs = ", ".join(f"{e} AS in_{k}" for k, e in s.inputs.items())
    result = expression(name, **{k: f"in_{k}" for k in s.inputs})
    shown = ", ".join(f"CASE WHEN NOT isnan(in_{k}) THEN in_{k} END AS in_{k}" if name in NUMERIC else f"in_{k}" for k in s.inputs)
    return f"SELECT {s.key}, {shown}, {result} AS {name} FROM (SELECT {s.key}, {inputs} FROM @{s.table}) q"
