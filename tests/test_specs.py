from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquetry.operators import specs
from marquetry.sources.datasets import DATASETS, answering, fronting, standalone
from marquetry.sources.tables import MissingColumns

BOOKS = specs.Dataset("books", "book", ("title", "alt"), names=("names",), ids={"isbn": "isbn_13"}, fields={"release_date": ("published",), "runtime_min": ("secs",)}, rank="score", runtime_unit=1 / 60, kind_column="form", kinds={"audio": "audiobook"})


def test_build(spark):
    rows = [(1, " Café_Noir ", "Black Café", ["978-1"], ["Cafe noir", "Kaffee", "Kaffee", ""], "March 1999", "120", float("nan"), "audio"), (2, None, "Only alt", None, None, None, "x", 2.5, None), (3, " ", None, ["9"], None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, alt string, isbn array<string>, names array<string>, published string, secs string, score double, form string")
    item, ext_id, alias = specs.build(df, BOOKS, "id")
    assert [tuple(r) for r in item.orderBy("pk").collect()] == [(1, "audiobook", "Café_Noir", "cafe noir", 1999, None, "March 1999", 2.0), (2, "book", "Only alt", "only alt", None, 2.5, None, None)]
    assert [tuple(r) for r in ext_id.collect()] == [("isbn_13", "9781", 1)]
    assert sorted(tuple(r) for r in alias.collect()) == [("black cafe", 1), ("kaffee", 1)]
    with pytest.raises(MissingColumns):
        specs.build(df.drop("title"), BOOKS, "id")


def test_registered_sources_in_order(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    specs.register("b", lambda d: d.withColumn("x", F.lit("b")), 10)
    specs.register("a", lambda d: d.withColumn("x", F.lit("a")), 20)
    try:
        assert [(r.source, r.x) for r in specs.candidates(q).orderBy("source_seq").collect()] == [("b", "b"), ("a", "a")]
        with pytest.raises(ValueError):
            specs.register("a", lambda d: d)
    finally:
        specs.unregister("a"), specs.unregister("b")
    with pytest.raises(ValueError):
        specs.candidates(q)


@pytest.mark.parametrize("name", sorted(DATASETS))
def test_every_dataset_builds(spark, name):
    spec = DATASETS[name]
    lists = {"aliases", "authors", "genres", "tags", "isbn_13", "isbn_10"}
    held = {"name": "The Name", "title": "The Title", "label_en": "Label", "title_english": None, "title_romaji": "Romaji", "format": "MOVIE", "totaltimesecs": "3600", "duration": "24", "average_runtime": "60", spec.year: "1999"}
    row = {c: [f"{c} 1", "", None, f"{c} 2"] if c in lists else held.get(c, "12" if c == spec.rank else f"{c} x") for c in spec.columns}
    row["authors"] = ['{"first_name": "Ann", "last_name": "Lee"}', "Other"] if "authors" in row else None
    schema = ", ".join(f"`{c}` {'array<string>' if c in lists else 'string'}" for c in row)
    df = spark.createDataFrame([tuple(row.values()), tuple(None for _ in row)], schema)
    item, ext_id, alias = specs.build(df, spec)
    (got,) = item.collect()
    assert got.title == next(row[c] for c in spec.title if row[c]) and got.kind == spec.kinds.get("MOVIE", spec.kind)
    assert got.year == (1999 if spec.year else None) and got.rank == (12.0 if spec.rank else None)
    assert {r.field for r in ext_id.collect()} == set(spec.ids.values())
    if spec.creator:
        assert got.artist == ("Ann Lee" if spec.creator == "authors" else f"{spec.creator} x")
    if spec.poster:
        assert got.poster_url == spec.poster[1].replace("{}", row[spec.poster[0]])
    if "runtime_min" in spec.fields:
        assert got.runtime_min in (60.0, 24.0)
    assert set(got.extra) == {c for c in spec.keep}
    for c in spec.required:
        with pytest.raises(MissingColumns):
            specs.build(df.drop(c), spec)


def test_fronts_and_lookups():
    assert len(DATASETS) == 20 and fronting("tvmaze").name == "tvmaze-shows" and fronting("nobody") is None
    assert [d.name for d in answering("imdb", "series")] == ["tvmaze-shows"] and answering("imdb", "series", children=True) == []
    assert "fanedits" not in {d.name for d in standalone("movie")} and "gutenberg-books" in {d.name for d in standalone("book")}
