"""Adapters on answers as their sources give them."""

from __future__ import annotations

import json

import pytest

from marquetry.sources import adapters

QUESTION = "query_id long, body string, title string, year int, medium string, ids string"
BY_NAME = {p.name: p for p in adapters.PROVIDERS}


def put(path, value):
    """The least JSON record that has ``value`` under ``path``."""
    path = path.partition(" -> ")[0].split("|")[0]
    if path.startswith("="):
        return {}
    out = value
    for key in reversed(path.split(".")):
        out = {key.split("[")[0]: [out]} if "[" in key else {key: out}
    return out


def joined(a, b):
    out = dict(a)
    for k, v in b.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = joined(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list) and isinstance(v[0], dict):
            out[k] = [joined(out[k][0], v[0])]
        else:
            out[k] = v
    return out


def answer(rows, records):
    if rows == "$":
        return records[0]
    if rows == "$[*].show":
        return [{"show": r} for r in records]
    if rows == "$.media[*].tracks[*]":
        return {"media": [{"tracks": records}]}
    body = records if not rows.endswith("Media") else records[0]
    for key in reversed(rows[2:].split(".")):
        body = {key.split("[")[0]: [body]} if "[" in key else {key: body}
    return body


def record(spec, title, year, **extra):
    out = {}
    for f, path in spec.fields.items():
        value = {"title": title, "year": f"{year}-03-04", "release_date": f"{year}-03-04", "runtime": 120, "runtime_min": 60, "position": 3, **extra}.get(f, f"the {f}")
        out = joined(out, put(path, value))
    for slot, path in spec.ids.items():
        if not any(put(path, 0) == put(p, 0) for p in spec.fields.values()):
            out = joined(out, put(path, f"id-{slot}"))
    return joined(out, put(spec.score, 80)) if getattr(spec, "score", "") else out


@pytest.mark.parametrize("provider", adapters.PROVIDERS, ids=lambda p: p.name)
def test_providers(spark, provider):
    body = json.dumps(answer(provider.rows, [record(provider, "Inception", 2010), record(provider, "Other", 1990)]))
    rows = [(1, body, "Inception", 2010, provider.media[0] if provider.media else None, "clash"), (2, "{}", "x", None, None, ""), (3, None, None, None, None, None), (4, "<html>", "x", 1, None, "")]
    got = adapters.candidates(spark.createDataFrame(rows, QUESTION), provider).collect()
    assert {r.query_id for r in got} == {1}
    first = min(got, key=lambda r: r.place)
    assert (first.title, first.provider) == ("Inception", provider.name)
    assert first.confidence == pytest.approx({"graded": 0.95 if "year" in provider.fields else 0.85}.get(provider.pick, 0.8 if provider.score else provider.confidence))
    assert set(first.ids) == set(provider.ids) and all(v is not None for v in first.ids.values())
    if "year" in provider.fields:
        assert first.year == 2010
    if "runtime" in provider.fields:
        assert first.runtime == pytest.approx(120 * provider.seconds)


@pytest.mark.parametrize("source", adapters.CATALOGUES, ids=lambda s: f"{s.name}-{s.kind}")
def test_catalogues(spark, source):
    body = json.dumps(answer(source.rows, [record(source, "Inception", 2010, runtime_min=round(60 / source.minutes))]))
    got = adapters.items(spark.createDataFrame([(1, body, None, None, None, ""), (2, "[]", None, None, None, ""), (3, None, None, None, None, None)], QUESTION), source).collect()
    assert [(r.query_id, r.source, r.kind) for r in got] == [(1, source.name, source.kind)]
    assert set(got[0].ext_ids or {}) == set(source.ids)
    if "release_date" in source.fields:
        assert (got[0].release_date, got[0].year) == ("2010-03-04", 2010)
    if "runtime_min" in source.fields:
        assert got[0].runtime_min == 60


def test_picks(spark):
    discogs = BY_NAME["discogs"]
    body = json.dumps({"results": [record(discogs, "Opus", 1990), record(discogs, "Opus", 2011), record(discogs, "Opus", 2010)]})
    rows = spark.createDataFrame([(1, body, "Opus", 2010, None, ""), (2, body, "Opus", 1950, None, ""), (3, body, "Opus", None, "book", "")], QUESTION)
    assert {r.query_id: r.year for r in adapters.candidates(rows, discogs).collect()} == {1: 2011, 2: 1990}
    tmdb = BY_NAME["tmdb"]
    body = json.dumps({"results": [record(tmdb, "Inception: Making of", 2010), record(tmdb, "Incéption", 1999), record(tmdb, "inception", 2011)]})
    (got,) = adapters.candidates(spark.createDataFrame([(1, body, "Inception", 2010, None, "")], QUESTION), tmdb).collect()
    assert (got.title, got.confidence) == ("inception", 0.95)


def test_routing():
    names = lambda *a: {p.name for p in adapters.served(*a)}
    assert "tvmaze" in names("series") and "musicbrainz" not in names("series") and "jikan_anime" not in names("series")
    assert "jikan_anime" in names("series", "video", "anime") and "discogs" in names("generic", "audio") and "tvmaze" not in names("series", "audio")
    assert len(adapters.PROVIDERS) == 27 and len({c.name for c in adapters.CATALOGUES}) == 10
