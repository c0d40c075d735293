"""The datasets the store is built from, as declarations.

Each block says which columns of a dataset hold the title, names, ids and fields of an item; they are
compiled by ``operators.specs.build``. Blocks are TOML: a list of columns are alternatives.
"""

from __future__ import annotations

import tomllib

from marquetry.operators.specs import Dataset

# Columns of the public datasets, and the item fields and id fields they hold.
DECLARED = """
[musicbrainz-artists]
kind = "artist"
media = ["music"]
title = ["name"]
names = ["aliases"]
year = "begin_date"
ids = {mb_id = "musicbrainz_artist"}
fields = {sort_title = ["sort_name"], release_date = ["begin_date"]}
keep = ["type", "gender", "country", "area", "end_date", "ended", "disambiguation", "tags", "isni_codes", "ipi_codes"]
answers = ["musicbrainz/artist"]
children = true

[unified-artists]
kind = "artist"
media = ["music"]
title = ["name"]
names = ["aliases"]
year = "begin_date"
ids = {mb_id = "musicbrainz_artist", adb_id = "audiodb_artist_id", ma_id = "metal_archives_band", progarchives_id = "progarchives_id", jazz_id = "jazz_id", classical_id = "classical_id", bandcamp_id = "bandcamp_band_id", soundcloud_id = "soundcloud_user_id"}
fields = {sort_title = ["sort_name"], release_date = ["begin_date"], overview = ["biography_en"]}
keep = ["type", "gender", "country", "area", "end_date", "ended", "disambiguation", "tags", "sources", "style", "mood", "classical_period", "members", "website", "prog_genre", "jazz_genre", "themes", "label", "genres", "status", "soundcloud_username", "bandcamp_url"]

[artists]
kind = "artist"
media = ["music"]
title = ["name"]
names = ["aliases"]
year = "begin_date"
ids = {mb_id = "musicbrainz_artist", adb_id = "audiodb_artist_id", ma_id = "metal_archives_band", progarchives_id = "progarchives_id", jazz_id = "jazz_id", classical_id = "classical_id"}
fields = {sort_title = ["sort_name"], release_date = ["begin_date"], overview = ["biography_en"]}
keep = ["type", "gender", "country", "area", "end_date", "ended", "disambiguation", "tags", "sources", "style", "mood", "classical_period", "members", "website"]

[wikidata-entities]
kind = "entity"
media = ["generic"]
title = ["label_en"]
year = "inception_year"
ids = {wikidata_id = "wikidata"}
fields = {overview = ["description_en"]}
keep = ["entity_type", "domain", "country", "country_qid", "website", "dissolved_year", "location"]

[openlibrary-books]
kind = "book"
media = ["book"]
title = ["title"]
year = "first_publish_year"
rank = "edition_count"
creator = "authors"
ids = {olid = "olid", isbn_10 = "isbn_10", isbn_13 = "isbn_13"}
fields = {original_title = ["subtitle"]}
poster = ["cover_i", "https://covers.openlibrary.org/b/id/{}-M.jpg"]
keep = ["authors", "author_key", "publisher", "edition_count", "subjects", "language", "number_of_pages_median", "ebook_access"]
front = "openlibrary"
answers = ["openlibrary/book", "isbn/book"]

[gutenberg-books]
kind = "book"
media = ["book"]
title = ["title"]
rank = "download_count"
creator = "authors"
ids = {gutenberg_id = "gutenberg_id"}
keep = ["authors", "translators", "subjects", "bookshelves", "languages", "copyright", "download_count", "has_text", "has_epub"]

[librivox-audiobooks]
kind = "audiobook"
media = ["audiobook"]
title = ["title"]
year = "copyright_year"
creator = "authors"
ids = {librivox_id = "librivox_id"}
fields = {overview = ["description"], runtime_min = ["totaltimesecs"]}
runtime_unit = "seconds"
keep = ["language", "copyright_year", "num_sections", "url_librivox", "url_rss", "url_zip_file", "url_text_source", "authors"]
front = "librivox"
answers = ["librivox/audiobook"]
children = true

[tvmaze-shows]
kind = "series"
media = ["episodic_series"]
title = ["name"]
ids = {tvmaze_id = "tvmaze", imdb_id = "imdb", thetvdb_id = "tvdb", tvrage_id = "tvrage_id"}
fields = {release_date = ["premiered"], runtime_min = ["average_runtime", "runtime"], overview = ["summary"], poster_url = ["image_medium"]}
keep = ["type", "language", "genres", "status", "ended", "network_name", "network_country", "rating_average", "official_site", "schedule_days", "schedule_time"]
front = "tvmaze"
answers = ["tvmaze/series", "tvdb/series", "imdb/series"]
children = true

[anilist-anime]
kind = "series"
media = ["episodic_series", "movie"]
title = ["title_english", "title_romaji", "title_native"]
names = ["title_romaji", "title_native", "title_english"]
year = "season_year"
rank = "popularity"
ids = {anilist_id = "anilist_id", mal_id = "mal_id"}
fields = {original_title = ["title_native"], release_date = ["start_date"], runtime_min = ["duration"]}
keep = ["format", "status", "episodes", "genres", "studios", "average_score", "country_of_origin", "source_material", "season", "tags", "is_adult", "end_date"]
kind_column = "format"
kinds = {MOVIE = "movie"}
front = "anilist"
answers = ["anilist/series", "anilist/movie", "mal/series", "mal/movie"]

[jikan-manga]
kind = "book"
media = ["comic"]
title = ["title", "title_english", "title_japanese"]
names = ["title_english", "title_japanese", "aliases"]
rank = "members"
creator = "authors"
ids = {mal_id = "mal_id"}
fields = {original_title = ["title_japanese"], release_date = ["published_from"], overview = ["synopsis"]}
keep = ["type", "status", "chapters", "volumes", "authors", "serializations", "genres", "themes", "demographics", "score", "scored_by", "popularity", "published_to"]
front = "jikan_manga"

[podcastindex-podcasts]
kind = "show"
media = ["podcast"]
title = ["title"]
rank = "episode_count"
creator = "author"
ids = {itunes_id = "apple_podcast_id", feed_url = "feed_url"}
fields = {overview = ["description"], poster_url = ["image"]}
keep = ["author", "genres", "language", "episode_count", "explicit", "url", "country_charts"]

[listennotes-podcasts]
kind = "show"
media = ["podcast"]
title = ["title"]
rank = "listen_score"
ids = {ln_id = "listen_notes_id"}
fields = {overview = ["description"], poster_url = ["image"]}
keep = ["ln_url", "episode_count", "listen_score", "global_rank"]

[steam-games]
kind = "game"
media = ["game"]
title = ["name"]
year = "release_date"
rank = "positive_reviews"
creator = "developer"
ids = {steam_appid = "steam_appid"}
fields = {overview = ["short_description"], release_date = ["release_date"]}
keep = ["developer", "publisher", "genres", "categories", "price_usd", "is_free", "metacritic_score", "positive_reviews", "negative_reviews", "owners", "type"]

[radiobrowser-stations]
kind = "station"
media = ["radio"]
title = ["name"]
rank = "votes"
ids = {stationuuid = "stationuuid"}
fields = {poster_url = ["favicon"]}
keep = ["url", "url_resolved", "homepage", "country", "countrycode", "state", "language", "tags", "codec", "bitrate", "clickcount"]

[metal-archives]
kind = "artist"
media = ["music"]
title = ["name"]
ids = {band_id = "metal_archives_band"}
keep = ["country", "location", "status", "formed_in", "genres", "themes", "years_active", "current_label_name", "url"]

[progarchives-artists]
kind = "artist"
media = ["music"]
title = ["name"]
ids = {artist_id = "progarchives_id"}
fields = {overview = ["bio"]}
keep = ["genre", "country", "url", "n_albums"]

[jazz-artists]
kind = "artist"
media = ["music"]
title = ["name"]
ids = {artist_slug = "jazz_id"}
fields = {overview = ["bio"]}
keep = ["genres", "genre", "url", "n_albums"]

[deezer-playlists]
kind = "playlist"
media = ["playlist"]
title = ["title"]
rank = "fans"
creator = "creator_name"
ids = {deezer_id = "deezer_playlist_id"}
fields = {overview = ["description"], release_date = ["creation_date"]}
keep = ["creator_name", "nb_tracks", "fans", "genres", "url", "source_genre", "duration_seconds", "tracks"]

[ytmusic-playlists]
kind = "playlist"
media = ["playlist"]
title = ["title"]
creator = "author"
ids = {ytm_id = "ytmusic_playlist_id"}
fields = {overview = ["description"]}
keep = ["author", "track_count", "duration_seconds", "source_category", "tracks"]

[fanedits]
kind = "movie"
media = ["movie"]
title = ["title"]
creator = "faneditor"
ids = {fanedit_id = "fanedit_id", imdb_id = "derived_from_imdb"}
fields = {original_title = ["original_title"], overview = ["synopsis"], release_date = ["fanedit_release_date"], poster_url = ["cover_url"]}
keep = ["faneditor", "genre", "franchise", "fanedit_type", "url", "slug", "editor_rating", "user_rating", "original_release_date", "fanedit_running_time"]
front = "pyfanedit"
"""

DATASETS: dict[str, Dataset] = {name: Dataset.declared(name, block) for name, block in tomllib.loads(DECLARED).items()}


def fronting(provider: str) -> Dataset | None:
    """The dataset that answers in place of a provider."""
    return next((d for d in DATASETS.values() if d.front == provider), None)


def answering(scheme: str, kind: str, children: bool = False) -> list[Dataset]:
    """Datasets that answer a lookup by ``scheme`` for ``kind``; those whose live answer lists children only without them."""
    return [d for d in DATASETS.values() if f"{scheme}/{kind}" in d.answers and not (children and d.children)]


def standalone(medium: str) -> list[Dataset]:
    """Datasets of a medium that stand in front of no provider."""
    return [d for d in DATASETS.values() if not d.front and medium in d.media]
