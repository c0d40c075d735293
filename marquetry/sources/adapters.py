"""Adapters of metadata sources: raw JSON answers to candidates and catalogue items.

An adapter is a mapping, not a program: where in an answer its records stand, and which paths give each
field. It compiles to expressions over the answer's text, so all answers of a source are read in one
stage without Python, and a question's best record is a pre-aggregated minimum. Fetching answers is no
part of this; they come as a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions.scalars import column
from marquetry.functions.text import folded_title, fuzzy_ratio, norm_name
from marquetry.operators import fusion, specs

MAX_RECORDS = 1 << 20  #: place of a record in its answer, for ordering


@dataclass(frozen=True)
class Provider:
    """A source that proposes records for a question (title, artist, year, medium).

    ``rows`` is the path of the records; ``fields`` and ``ids`` map names to paths below a record, ``a|b``
    taking the first that holds a value, ``=text`` a constant; an id may have a template, ``path -> text {}``.
    ``pick`` says which record is taken: the first, the first near the year asked for ("year"), the best
    graded title ("graded"), the most alike title ("alike"), or the ``most`` best ("all"). ``quality``
    scales the confidence by match_quality; ``score`` is a path that holds the confidence in percent.
    """

    name: str
    media: tuple[str, ...]
    playback: tuple[str, ...] = ()
    genres: tuple[str, ...] = ()
    rows: str = "$"
    fields: dict[str, str] = field(default_factory=dict)
    ids: dict[str, str] = field(default_factory=dict)
    confidence: float = 0.0
    quality: bool = False
    score: str = ""
    pick: str = "first"
    seconds: float = 1.0
    most: int = 5


@dataclass(frozen=True)
class Catalogue:
    """A source of catalogue items; ``priority`` orders sources of one question, lower first."""

    name: str
    kind: str
    priority: int
    rows: str = "$"
    fields: dict[str, str] = field(default_factory=dict)
    ids: dict[str, str] = field(default_factory=dict)
    minutes: float = 1.0


VIDEO, AUDIO, PAGED = ("video",), ("audio",), ("paged",)

# The sources' media, confidences, picks and the paths of their answers.
PROVIDERS = (
    Provider("skyhook", ("movie", "series", "music", "book"), rows="$", fields={"title": "Title|title|ArtistName|artistname", "artist": "ArtistName|artistname", "year": "Year|year|firstAired|first_publish_year"}, ids={"tmdb_movie": "TmdbId", "imdb": "ImdbId|imdbId", "tvdb": "tvdbId", "musicbrainz_artist": "Id|id", "isbn_13": "isbn_13[0]", "isbn_10": "isbn_10[0]"}, confidence=0.85, quality=True, pick="year"),
    Provider("musicbrainz", ("music",), AUDIO, rows="$.recordings", fields={"title": "title", "artist": "artist-credit[0].name", "year": "releases[0].date|first-release-date", "country": "releases[0].country", "runtime": "length"}, ids={"musicbrainz_recording": "id", "musicbrainz_release": "releases[0].id", "musicbrainz_artist": "artist-credit[0].artist.id"}, score="score", quality=True, pick="all", seconds=0.001),
    Provider("audiodb", ("music",), AUDIO, rows="$.track", fields={"title": "strTrack", "artist": "strArtist", "runtime": "intDuration"}, ids={"audiodb_track_id": "idTrack", "audiodb_album_id": "idAlbum", "audiodb_artist_id": "idArtist", "musicbrainz_artist": "strMusicBrainzArtistID", "music_video_url": "strMusicVid"}, confidence=0.65, quality=True, seconds=0.001),
    Provider("tvmaze", ("series",), VIDEO, rows="$[*].show", fields={"title": "name", "year": "premiered", "runtime": "runtime", "language": "language"}, ids={"tvmaze_id": "id", "tvmaze_url": "url", "imdb": "externals.imdb", "tvdb": "externals.thetvdb"}, confidence=0.7, quality=True),
    Provider("anilist", ("series", "movie", "comic"), ("video", "paged"), ("anime", "manga"), rows="$.data.Media", fields={"title": "title.english|title.romaji", "year": "startDate.year", "medium": "=series"}, ids={"anilist_id": "id", "title_romaji": "title.romaji", "title_native": "title.native"}, confidence=0.90),
    Provider("jikan_anime", ("series", "movie"), VIDEO, ("anime",), rows="$.data", fields={"title": "title_english|title", "year": "aired.prop.from.year|year"}, ids={"mal_id": "mal_id", "title_japanese": "title_japanese"}, confidence=0.85, pick="year"),
    Provider("jikan_manga", ("comic",), PAGED, ("manga",), rows="$.data", fields={"title": "title_english|title", "artist": "authors[0].name", "year": "published.prop.from.year|year"}, ids={"mal_id": "mal_id", "title_japanese": "title_japanese"}, confidence=0.85, pick="year"),
    Provider("librivox", ("audiobook",), AUDIO, rows="$.books", fields={"title": "title", "year": "copyright_year|catalog_date", "language": "language", "artist": "authors[0].last_name"}, ids={"librivox_id": "id", "librivox_author_id": "authors[0].id"}, confidence=0.80),
    Provider("apple_podcasts", ("podcast", "audio_drama"), AUDIO, rows="$.results", fields={"title": "collectionName", "artist": "artistName"}, ids={"apple_podcast_id": "collectionId", "feed_url": "feedUrl"}, confidence=0.75),
    Provider("wikidata", ("movie", "series", "music", "book", "podcast"), rows="$.search", fields={"title": "label"}, ids={"wikidata": "id"}, confidence=0.7, quality=True, pick="all", most=3),
    Provider("discogs", ("music", "music_video", "generic"), ("audio", "video"), rows="$.results", fields={"title": "title", "year": "year", "country": "country"}, ids={"discogs_release": "id", "discogs_url": "uri -> https://www.discogs.com{}", "discogs_cover": "cover_image", "discogs_label": "label[0]", "discogs_catno": "catno"}, confidence=0.70, quality=True, pick="year"),
    Provider("bluray_com", ("movie", "series"), VIDEO, rows="$.editions", fields={"title": "title", "year": "year"}, ids={"bluray_com_id": "bluray_com_id", "bluray_com_url": "url", "bluray_com_cover": "cover_url"}, confidence=0.65, quality=True, pick="year"),
    Provider("dvdcompare", ("movie", "series"), VIDEO, rows="$.results", fields={"title": "title", "year": "year"}, ids={"dvdcompare_id": "dvdcompare_id", "dvdcompare_url": "url", "dvdcompare_version": "version"}, confidence=0.60, quality=True, pick="alike"),
    Provider("pyfanedit", ("movie",), VIDEO, rows="$.edits", fields={"title": "title", "year": "fanedit_release_date"}, ids={"fanedit_id": "fanedit_id", "fanedit_url": "url"}, pick="none"),
    Provider("bandcamp", ("music",), AUDIO, rows="$.results", fields={"title": "name|title", "artist": "band_name|artist", "year": "year", "runtime": "duration"}, ids={"bandcamp_band_id": "band_id", "bandcamp_track_id": "track_id|id", "bandcamp_album_id": "album_id", "bandcamp_track_url": "url", "bandcamp_album_url": "album_url", "bandcamp_artist_url": "artist_url"}, confidence=0.6),
    Provider("soundcloud", ("music",), AUDIO, rows="$.collection", fields={"title": "title", "artist": "user.username", "runtime": "duration"}, ids={"soundcloud_track_id": "id", "soundcloud_user_id": "user.id", "soundcloud_track_url": "permalink_url", "soundcloud_artist_url": "user.permalink_url"}, confidence=0.55, seconds=0.001),
    Provider("youtube_music", ("music",), AUDIO, rows="$.results", fields={"title": "title", "artist": "artists[0].name|artist", "year": "year", "runtime": "duration|length"}, ids={"youtube_music_video_id": "videoId|video_id", "youtube_music_artist_browse_id": "artists[0].id", "youtube_music_album_browse_id": "album.id|albumId", "youtube_music_playlist_id": "playlistId"}, confidence=0.7),
    Provider("youtube", ("movie", "series", "podcast", "generic"), rows="$.results", fields={"title": "title", "artist": "channel|uploader|author", "runtime": "length"}, ids={"youtube_video_id": "videoId|video_id", "youtube_channel_id": "channelId|channel_id", "youtube_content_type": "content_type"}, confidence=0.5),
    Provider("metal_archives", ("music",), AUDIO, rows="$.songs", fields={"title": "title", "artist": "band_name"}, ids={"metal_archives_band": "band_id", "metal_archives_song": "song_id", "metal_archives_release": "release_id"}, confidence=0.9, quality=True, pick="all"),
    Provider("openlibrary", ("book",), PAGED, rows="$.docs", fields={"title": "title", "artist": "author_name[0]", "year": "first_publish_year", "language": "language[0]"}, ids={"olid": "key", "openlibrary_url": "key -> https://openlibrary.org{}", "openlibrary_cover_id": "cover_i"}, confidence=0.70, quality=True),
    Provider("annas_archive", ("book",), PAGED, rows="$.results", fields={"title": "title", "artist": "author", "language": "language"}, ids={"annas_archive_md5": "md5", "annas_archive_cover_url": "cover_url", "annas_archive_size": "size"}, confidence=0.55, quality=True),
    Provider("tmdb", ("movie",), VIDEO, rows="$.results", fields={"title": "title", "year": "release_date"}, ids={"tmdb_movie": "id"}, pick="graded"),
    Provider("tvdb", ("tv", "series"), VIDEO, rows="$.data", fields={"title": "name", "year": "year"}, ids={"tvdb_id": "tvdb_id", "tvdb_slug": "slug"}, pick="graded"),
    Provider("pymal_anime", ("series", "movie"), VIDEO, ("anime",), rows="$.anime", fields={"title": "title", "year": "year"}, ids={"mal_id": "mal_id", "title_english": "english_title", "title_japanese": "japanese_title", "mal_score": "score"}, confidence=0.95),
    Provider("pymal_manga", ("comic",), PAGED, ("manga",), rows="$.manga", fields={"title": "title"}, ids={"mal_id": "mal_id", "title_english": "english_title", "title_japanese": "japanese_title"}, confidence=0.95),
    Provider("pymal_character", (), rows="$", fields={"title": "name"}, ids={"mal_character_id": "mal_id", "name_japanese": "japanese_name"}, pick="none"),
    Provider("pymal_person", (), rows="$", fields={"title": "name"}, ids={"mal_person_id": "mal_id", "name_japanese": "japanese_name", "birthday": "birthday"}, pick="none"),
)

_POSTER = "Images[0].Url|images[0].url"
CATALOGUES = (
    Catalogue("skyhook", "movie", 10, "$", {"title": "Title", "original_title": "OriginalTitle", "year": "Year", "release_date": "InCinema|Premier", "runtime_min": "Runtime", "overview": "Overview", "poster_url": _POSTER}, {"tmdb": "TmdbId", "imdb": "ImdbId"}),
    Catalogue("skyhook", "series", 10, "$", {"title": "title", "release_date": "firstAired", "runtime_min": "runtime", "overview": "overview", "poster_url": _POSTER}, {"tvdb": "tvdbId", "tmdb": "tmdbId", "imdb": "imdbId", "tvmaze": "tvMazeId"}),
    Catalogue("skyhook", "season", 10, "$.seasons", {"title": "=Season", "position": "seasonNumber", "poster_url": _POSTER}),
    Catalogue("tmdb", "movie", 20, "$", {"title": "title", "original_title": "original_title", "release_date": "release_date", "runtime_min": "runtime", "overview": "overview", "poster_url": "poster_path"}, {"tmdb": "id", "imdb": "imdb_id|external_ids.imdb_id", "wikidata": "external_ids.wikidata_id"}),
    Catalogue("tmdb", "series", 20, "$", {"title": "name", "original_title": "original_name", "release_date": "first_air_date", "runtime_min": "episode_run_time[0]", "overview": "overview", "poster_url": "poster_path"}, {"tmdb": "id", "imdb": "external_ids.imdb_id", "tvdb": "external_ids.tvdb_id", "wikidata": "external_ids.wikidata_id"}),
    Catalogue("tmdb", "episode", 20, "$.episodes", {"title": "name", "position": "episode_number", "release_date": "air_date", "runtime_min": "runtime", "overview": "overview", "poster_url": "still_path"}, {"tmdb": "id"}),
    Catalogue("tvmaze", "series", 30, "$", {"title": "name", "release_date": "premiered", "runtime_min": "averageRuntime|runtime", "overview": "summary", "poster_url": "image.original|image.medium"}, {"tvmaze": "id", "tvdb": "externals.thetvdb", "imdb": "externals.imdb"}),
    Catalogue("tvmaze", "season", 30, "$._embedded.seasons", {"title": "name|=Season", "position": "number", "release_date": "premiereDate", "overview": "summary", "poster_url": "image.original|image.medium"}, {"tvmaze": "id"}),
    Catalogue("tvmaze", "episode", 30, "$._embedded.episodes", {"title": "name", "position": "number", "release_date": "airdate", "runtime_min": "runtime", "overview": "summary", "poster_url": "image.original|image.medium"}, {"tvmaze": "id"}),
    Catalogue("musicbrainz", "album", 30, "$.release-groups", {"title": "title", "release_date": "first-release-date"}, {"musicbrainz": "id"}),
    Catalogue("musicbrainz", "track", 30, "$.media[*].tracks[*]", {"title": "title|recording.title", "position": "position", "runtime_min": "length|recording.length"}, {"musicbrainz": "recording.id", "musicbrainz_track": "id"}, 1 / 60000),
    Catalogue("anilist", "series", 10, "$.data.Media", {"title": "title.english|title.romaji|title.native", "original_title": "title.native", "year": "startDate.year", "runtime_min": "duration", "overview": "description", "poster_url": "coverImage.extraLarge|coverImage.large"}, {"anilist": "id", "mal": "idMal"}),
    Catalogue("openlibrary", "book", 10, "$", {"title": "title", "release_date": "first_publish_date", "overview": "description.value|description", "poster_url": "covers[0] -> https://covers.openlibrary.org/b/id/{}-L.jpg"}, {"openlibrary": "key"}),
    Catalogue("librivox", "audiobook", 10, "$.books", {"title": "title", "overview": "description", "runtime_min": "totaltimesecs"}, {"librivox": "id"}, 1 / 60),
    Catalogue("librivox", "chapter", 10, "$.books[0].sections", {"title": "title", "position": "section_number", "runtime_min": "playtime"}, {"librivox_section": "id"}, 1 / 60),
    Catalogue("apple_podcasts", "show", 10, "$.results", {"title": "collectionName", "poster_url": "artworkUrl600|artworkUrl100"}, {"apple_podcasts": "collectionId"}),
    Catalogue("discogs", "extra", 60, "$.videos", {"title": "title", "overview": "uri"}, {}),
    Catalogue("pyfanedit", "variant", 50, "$.edits", {"title": "title", "release_date": "fanedit_release_date", "overview": "synopsis", "poster_url": "cover_url"}, {"ifdb": "fanedit_id"}),
)


def _records(body: Column, path: str) -> Column:
    """The JSON texts of the records under ``path``; a lone object is a list of one, ``[*]`` opens a list on the way."""
    head, star, rest = path.partition("[*]")
    found = body if head == "$" else F.get_json_object(body, head)
    listed = F.when(F.startswith(F.trim(found), F.lit("[")), found).otherwise(F.concat(F.lit("["), found, F.lit("]")))
    records = F.filter(F.from_json(listed, "array<string>"), lambda r: F.startswith(F.trim(r), F.lit("{")))
    if not star or not rest:
        return records
    return F.flatten(F.filter(F.transform(records, lambda r: _records(r, f"${rest}")), lambda x: x.isNotNull()))


def _value(record: str, path: str) -> Column:
    """The first of ``path``'s alternatives that holds a value that is not blank."""
    path, _, template = path.partition(" -> ")
    parts = [F.lit(p[1:]) if p.startswith("=") else F.nullif(F.trim(F.get_json_object(record, f"$.{p}")), F.lit("")) for p in path.split("|")]
    text = F.coalesce(*parts)
    return F.replace(F.lit(template), F.lit("{}"), text) if template else text


def _ids(record: str, ids: dict[str, str]) -> Column:
    """Map of the ids that are there; "0" and blanks are none, a work's key loses its path."""
    clean = {slot: F.regexp_replace(_value(record, path), r"^/(?:works|books|authors)/", "") for slot, path in ids.items()}
    entries = F.array(*[F.when(v != "0", F.struct(F.lit(slot).alias("key"), v.alias("value"))) for slot, v in clean.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())) if ids else F.lit(None).cast("map<string,string>")


def _year(text: Column) -> Column:
    year = F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int")
    return F.when(year.between(1000, 2200), year)


def candidates(answers: DataFrame, provider: Provider) -> DataFrame:
    """Rows (query_id, place, provider, confidence, title, artist, year, runtime, medium, language, country, ids).

    ``answers`` is (query_id, body) with what was asked: title, artist, year, medium (each may be null or
    missing). An answer that is no JSON, or has no record, gives no row; so does a record without a title,
    and any for a medium the provider doesn't serve. Of equal records the first in the answer is taken.
    """
    asked = {c: (F.col(c) if c in answers.columns else F.lit(None)).cast(t).alias(c) for c, t in (("title", "string"), ("year", "int"), ("medium", "string"))}
    rows = answers.select("query_id", F.struct(*asked.values()).alias("q"), F.posexplode(_records(F.col("body"), provider.rows)).alias("place", "record"))
    if provider.media:
        rows = rows.where(F.col("q.medium").isNull() | F.col("q.medium").isin(*provider.media))
    value = lambda f: _value("record", provider.fields[f]) if f in provider.fields else F.lit(None).cast("string")
    medium = F.coalesce(F.col("q.medium"), value("medium"), F.lit(provider.media[0] if provider.media else None))
    clock = value("runtime")
    runtime = F.when(F.contains(F.col("clock"), F.lit(":")), column("duration_parse", x="clock") * 60).otherwise(F.col("clock").try_cast("double") * provider.seconds)
    rows = rows.select("query_id", "place", "q", value("title").alias("title"), value("artist").alias("artist"), _year(value("year")).alias("year"), clock.alias("clock"), medium.alias("medium"), value("language").alias("language"), value("country").alias("country"), _ids("record", provider.ids).alias("ids"), (_value("record", provider.score).try_cast("double") / 100 if provider.score else F.lit(provider.confidence)).alias("base"))
    rows = rows.withColumn("runtime", F.when(runtime > 0, runtime)).where("title is not null").withColumn("form", folded_title(F.col("title"))).withColumn("asked", folded_title(F.col("q.title")))
    near = F.coalesce(F.abs(F.col("year") - F.col("q.year")) <= fusion.YEAR_WINDOW, F.lit(False))
    if provider.pick == "graded":
        same = norm_name(F.col("title")) == norm_name(F.col("q.title"))
        part = F.contains(F.lower("title"), F.lower("q.title")) | F.contains(F.lower("q.title"), F.lower("title"))
        grade = F.when(same & near, 0.95).when(same, 0.85).when(part, 0.60).otherwise(0.35)
        rows = rows.withColumn("confidence", grade)
    else:
        a, b = "named_struct('year', q.year, 'medium', q.medium)", "named_struct('year', year, 'medium', medium)"
        quality = fusion.match_quality(a, b, fusion.title_ratio(F.col("asked"), F.col("form"))) if provider.quality else F.lit(1.0)
        rows = rows.withColumn("confidence", F.round(F.col("base") * quality, 6))
    order = {"year": F.when(near, 0.0).otherwise(1.0), "graded": -F.col("confidence"), "alike": -F.coalesce(fuzzy_ratio(F.col("asked"), F.col("form")), F.lit(0.0)), "all": -F.col("confidence")}.get(provider.pick, F.lit(0.0))
    out = ["title", "artist", "year", "runtime", "medium", "language", "country", "ids"]
    ordered = rows.select("query_id", F.struct(order.alias("o"), "place").alias("order"), F.struct("confidence", *out).alias("r"))
    if provider.pick == "all":  # an answer holds few records
        taken = ordered.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("order", F.struct("r.confidence", *[f"r.{c}" for c in out if c != "ids"], F.map_entries("r.ids").alias("ids")).alias("r")))), 1, provider.most).alias("t")).select("query_id", F.posexplode("t").alias("place", "t"))
        return taken.select("query_id", "place", F.lit(provider.name).alias("provider"), "t.r.confidence", *[f"t.r.{c}" for c in out if c != "ids"], F.map_from_entries("t.r.ids").alias("ids"))
    taken = ordered.groupBy("query_id").agg(F.min_by("r", "order").alias("r"), F.min("order.place").alias("p"))
    return taken.select("query_id", F.lit(0).alias("place"), F.lit(provider.name).alias("provider"), "r.confidence", *[f"r.{c}" for c in out])


def items(answers: DataFrame, source: Catalogue) -> DataFrame:
    """Rows (query_id, place, source, kind, title, original_title, year, release_date, runtime_min, overview, poster_url, position, ext_ids).

    ``answers`` is (query_id, body). Missing texts are null, runtimes minutes above 0, dates cut to what
    they say; a year is the date's where the record has none. An answer that is no JSON gives no row.
    """
    rows = answers.select("query_id", F.posexplode(_records(F.col("body"), source.rows)).alias("place", "record"))
    raw = {f: (_value("record", source.fields[f]) if f in source.fields else F.lit(None).cast("string")).alias(f) for f in ("title", "original_title", "year", "release_date", "runtime_min", "overview", "poster_url", "position")}
    rows = rows.select("query_id", "place", *raw.values(), _ids("record", source.ids).alias("ext_ids"))
    date = F.nullif(F.regexp_extract("release_date", r"^(\d{4}(?:-\d{2}(?:-\d{2})?)?)", 1), F.lit(""))
    minutes = F.round(F.col("runtime_min").try_cast("double") * source.minutes, 2)
    return rows.select("query_id", "place", F.lit(source.name).alias("source"), F.lit(source.kind).alias("kind"), "title", "original_title", F.coalesce(_year(F.col("year")), _year(F.col("release_date"))).alias("year"), date.alias("release_date"), F.when(minutes > 0, minutes).alias("runtime_min"), column("html_plain_text", x="overview").alias("overview"), "poster_url", F.col("position").try_cast("int").alias("position"), "ext_ids")


def served(medium: str, playback: str | None = None, genre: str | None = None) -> list[Provider]:
    """Providers that serve a medium: all three axes must pass, an axis that a provider leaves open always does."""
    return [p for p in PROVIDERS if (not p.media or medium in p.media) and (not playback or not p.playback or playback in p.playback) and (not p.genres or genre in p.genres)]


def register_all() -> None:
    """Every provider as an adapter of the process's registry; a name that is taken stays as it is."""
    for place, provider in enumerate(PROVIDERS):
        if provider.name not in specs.registered():
            specs.register(provider.name, lambda answers, p=provider: candidates(answers.where(F.col("provider") == p.name), p), priority=place)
