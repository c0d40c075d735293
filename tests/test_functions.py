"""Scalars and text functions at the values that pin them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquetry.functions.scalars import SCALARS, column, expression
from marquetry.functions.text import fuzzy_ratio, norm_name, normalise
from marquetry.plans.dialect import duck_text, spark_query, spark_text

CASES = [
    ("year_extract", {"x": "released 12345, then 0999 and 1999-03"}, 1999),
    ("year_extract", {"x": None}, None),
    ("year_prefix", {"x": " 1999-03-31"}, 1999),
    ("iso_date", {"x": "1999-03-31T10:00"}, "1999-03-31"),
    ("iso_date", {"x": "soon"}, None),
    ("url_norm", {"x": " https://WWW.Example.org/A/?q=1#x "}, "https://www.example.org/A"),
    ("slugify", {"x": "Don't Stop -- Me_Now!"}, "dont-stop-me-now"),
    ("isbn_convert", {"x": "0-306-40615-2"}, "9780306406157"),
    ("isbn_convert", {"x": "978-0-306-40615-7"}, "0306406152"),
    ("isbn_convert", {"x": "9791234567896"}, None),
    ("duration_parse", {"x": "1:02:03"}, 62.05),
    ("duration_parse", {"x": "90"}, 1.5),
    ("duration_parse", {"x": "soon"}, None),
    ("runtime_parse", {"x": "1h 45m"}, 105.0),
    ("runtime_parse", {"x": "1,5h"}, 90.0),
    ("runtime_parse", {"x": "1:45"}, 105.0),
    ("runtime_parse", {"x": "105 min"}, 105.0),
    ("runtime_parse", {"x": "5000"}, None),
    ("month_year_date", {"x": "April 2026"}, "2026-04"),
    ("extra_type", {"x": "Behind the Scenes"}, "behind-the-scenes"),
    ("extra_type", {"x": "Bloopers"}, "other"),
    ("extra_type", {"x": "Live_performance"}, "live-session"),
    ("embedded_ids", {"x": "The Film (2022) {tmdb-696806} [imdbid-tt1254207]"}, "tmdb_movie:696806 imdb:tt1254207"),
    ("embedded_ids", {"x": "Show S01E02 {tmdbid=5}"}, "tmdb_tv:5"),
    ("youtube_id", {"x": "Title [dQw4w9WgXcQ]"}, "dQw4w9WgXcQ"),
    ("youtube_id", {"x": "Title [Bluray-1080p]"}, None),
    ("youtube_id", {"x": "a_d558tMKjvgc_b"}, "d558tMKjvgc"),
    ("parse_video_name", {"x": "Show.Name.S01E02.720p"}, "Show Name|-|1|2"),
    ("parse_video_name", {"x": "Title.2010.1080p"}, "Title|2010|-|-"),
    ("rfc_date", {"x": "Tue, 1 Feb 2022 10:00:00 +0000"}, "2022-02-01"),
    ("html_plain_text", {"x": "<p>a &amp; b</p>c<br/>  d"}, "a & b\nc\nd"),
    ("video_key", {"x": "https://youtu.be/dQw4w9WgXcQ?t=1"}, "youtube:dQw4w9WgXcQ"),
    ("redact_url", {"x": "x?api_key=abc&q=1"}, "x?api_key=***&q=1"),
    ("season_key", {"x": "81189/02"}, "series 81189 season 2"),
    ("clean_isbn", {"x": "0-306-40615-x"}, "030640615X"),
    ("id_validate", {"s": "imdb", "v": "nm0000001"}, "invalid imdb id"),
    ("id_validate", {"s": "imdb", "v": "tt0133093"}, None),
]


@pytest.mark.parametrize(("name", "inputs", "want"), CASES)
def test_scalar(spark, name, inputs, want):
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in inputs.items()])
    assert df.select(column(name, **{k: k for k in inputs}).alias("r")).first().r == want


def test_scalars_are_null_safe(spark):
    df = spark.range(1).select(F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("array<bigint>").alias("a"))
    for name, scalar in SCALARS.items():
        numeric = {"to_text": "x", "json_safe": "x", "finite": "x", "nfo_render": "r"}
        df.select(column(name, **{k: "a" if name == "cover_url" else "d" if numeric.get(name) == k else "s" for k in scalar.inputs}).alias("r")).collect()
    with pytest.raises(TypeError):
        expression("slugify")


def test_names(spark):
    assert normalise("Café_Noir — 第1話!") == "cafe noir 第1話"
    assert normalise("हिन्दी_x") == "ह नद x"
    assert normalise(None) == ""
    df = spark.createDataFrame([("Ünïcode  Ｘ", "abc", "abd"), (None, None, "x")], "t string, a string, b string")
    rows = df.select(norm_name(F.col("t")).alias("n"), fuzzy_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert rows[0].n == "unicode x" and round(rows[0].r, 3) == 0.667
    assert rows[1].n == "" and rows[1].r is None


def test_dialect():
    text = "SELECT arr_get(arr_map(x, e -> rx_sub(e, ~'a{2}', '\\1')), 1) FROM @t"
    assert spark_query(text) == "SELECT try_element_at(transform(x, e -> regexp_replace(e, r'a{{2}}', '$1')), 1) FROM {t}"
    assert duck_text(text) == "SELECT list_extract(list_transform(x, lambda e: regexp_replace(e, 'a{2}', '\\1', 'g')), 1) FROM t"
    assert spark_text("concat(a, 'b)')") == "concat(a, 'b)')"
