"""Consolidation and comparison against a fold in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marquetry.functions.text import fold, ratio
from marquetry.operators import fusion
from tests.oracle import DATA

CANDIDATE = "query_id long, match_id long, provider string, confidence double, seq int, title string, year int, medium string, season int, episode int, runtime double, variant_kind string, n string"
NAMES = [c.split()[0] for c in CANDIDATE.split(", ")]
COMPARED = ("title", "year", "medium", "season", "episode", "runtime", "variant_kind")


def clash(a, b, titles=True):
    out = []
    for f in COMPARED:
        x, y = a.get(f), b.get(f)
        if x is None or y is None:
            continue
        if f == "title":
            bad = titles and ratio(fold(x), fold(y)) < 0.92
        elif f == "year":
            bad = abs(x - y) > 1
        elif f == "runtime":
            both = a.get("medium") is not None and b.get("medium") is not None
            bad = abs(x - y) > (fusion.RUNTIME_TOLERANCE.get(a["medium"], 5.0) if both else 5.0)
        else:
            bad = x != y
        if bad:
            out.append(f)
    return out


def fold_rows(rows, local=None, titles=True):
    run, own, anchor, accepted, dropped, conflicted = dict(local or {}), local or {}, None, [], [], False
    place = lambda r: (-(r["confidence"] if r["confidence"] is not None else -1.0), r["seq"] if r["seq"] is not None else 1 << 30, r["match_id"])
    for r in sorted(rows, key=place):
        if fields := clash(own, r, titles):
            dropped.append((r["match_id"], "local", fields))
        elif fields := clash(run, r, titles):
            conflicted = True
            dropped.append((r["match_id"], anchor or "consolidated", fields))
        else:
            for f in fusion.FIELDS:
                if run.get(f) is None:
                    run[f] = r.get(f)
            accepted.append(r["match_id"])
            anchor = anchor or r["provider"]
    return accepted, dropped, anchor, conflicted, {f: None if conflicted else run.get(f) for f in fusion.FIELDS}


def candidates(rng, queries):
    rows = []
    for q in range(queries):
        for _ in range(rng.choice((1, 2, 3, 7, 40 if q == 0 else 4))):
            pick = lambda *v: rng.choice((None, *v))
            rows.append((q, len(rows), rng.choice("abc"), pick(0.2, 0.5, 0.9), pick(1, 2), pick("The Boys", "the boys!", "Café (2010)", "cafe", "Interstellar"), pick(2009, 2010, 2011, 2015), pick("movie", "tv", "music"), pick(1, 2), pick(1), pick(100.0, 103.0, 190.0), pick("directors", "extended"), "clash"))
    return rows


@pytest.mark.parametrize("with_local", [False, True])
@pytest.mark.parametrize("fold_rows_most", [0, 32])
def test_consolidate_is_the_fold(spark, monkeypatch, with_local, fold_rows_most):
    monkeypatch.setattr(fusion, "FOLD_ROWS", fold_rows_most)
    rng = random.Random(6)
    rows = candidates(rng, 60)
    local = {q: {"title": rng.choice((None, "The Boys")), "year": rng.choice((None, 2010)), "medium": rng.choice((None, "movie"))} for q in range(0, 60, 2)} if with_local else {}
    given = spark.createDataFrame([(q, d["title"], d["year"], d["medium"]) for q, d in local.items()], "query_id long, title string, year int, medium string") if with_local else None
    verdicts, results = fusion.consolidate(spark.createDataFrame([*rows, rows[0]], CANDIDATE), given)
    got, ends = {}, {r.query_id: r for r in results.collect()}
    for r in verdicts.collect():
        got.setdefault(r.query_id, []).append(r)
    for q in range(60):
        accepted, dropped, anchor, conflicted, fields = fold_rows([dict(zip(NAMES, r)) for r in rows if r[0] == q], local.get(q))
        assert sorted(r.match_id for r in got[q] if r.accepted) == sorted(accepted), q
        assert sorted((r.match_id, r.against, sorted(r.fields)) for r in got[q] if not r.accepted) == sorted((m, a, sorted(f)) for m, a, f in dropped), q
        end = ends[q]
        assert (end.anchor, end.conflicted, end.n_accepted, end.n_dropped) == (anchor, conflicted, len(accepted), len(dropped)), q
        assert {f: end[f] for f in fusion.FIELDS} == fields, q
    empty = spark.createDataFrame([], CANDIDATE)
    assert fusion.consolidate(empty)[1].count() == 0


def test_identifiers_of_accepted_matches_first_writer_wins(spark):
    rows = [(1, 1, "weak", 0.3, 1, "The Matrix", 2003, "movie", None, None, None, None, "x"), (1, 2, "strong", 0.95, 2, "The Matrix", 1999, "movie", None, None, None, None, "x"), (1, 3, "third", 0.2, 3, "The Matrix", 1999, None, None, None, None, None, "x")]
    verdicts, _ = fusion.consolidate(spark.createDataFrame(rows, CANDIDATE))
    ids = spark.createDataFrame([(1, "tmdb", "999"), (2, "tmdb", "603"), (3, "tmdb", "7"), (3, "imdb", "tt3"), (2, "x", None)], "match_id long, field string, value string")
    mapped = spark.createDataFrame([(2, "imdb", "tt2"), (2, "tmdb", "0")], "match_id long, field string, value string")
    assert {(r.field, r.value) for r in fusion.merged_ids(verdicts, ids, mapped).collect()} == {("tmdb", "603"), ("imdb", "tt2")}


def test_quality_and_folding(spark):
    pairs = [({"title": "Inception", "year": 2010, "medium": "movie"}, {"title": "Inception", "year": 2010, "medium": "movie"}, 1.0), ({"title": "X", "medium": "movie"}, {"title": "X", "medium": "tv"}, 0.5), ({}, {"title": "X"}, 1.0), ({"title": "Inception", "year": 2010}, {"title": "Inception", "year": 2020}, 0.5)]
    schema = "i int, title string, year int, medium string"
    sides = [fusion.described(spark.createDataFrame([(i, p[k].get("title"), p[k].get("year"), p[k].get("medium")) for i, p in enumerate(pairs)], schema), "i").withColumnRenamed("s", name) for k, name in ((0, "a"), (1, "b"))]
    quality = fusion.match_quality("a", "b", fusion.title_ratio(F.col("a.form"), F.col("b.form")))
    assert [r[0] for r in sides[0].join(sides[1], "i").orderBy("i").select(quality).collect()] == [q for *_, q in pairs]
    assert fold("Pokémon (Uncut) feat. X") == "pokemon" and fold("(2010)") == "2010" and fold("Café") == fold("cafe")


@pytest.mark.skipif(not DATA.exists(), reason="test data not present")
def test_the_whole_table_is_the_fold(spark):
    from marquetry.plans import matching

    rows = [r.asDict() for r in matching.answers(spark, str(DATA)).collect()]
    by: dict[int, list[dict]] = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    for r in matching.QUERIES["consolidate"](spark, str(DATA)).collect():
        accepted, dropped, anchor, conflicted, fields = fold_rows(by[r.query_id])
        assert (r.n_accepted, r.n_dropped, r.anchor, r.conflicted, r.title, r.runtime) == (len(accepted), len(dropped), anchor, conflicted, fields["title"], fields["runtime"]), r
