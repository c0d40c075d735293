"""Stores, mappings, sidecars, journals and the registry of sources."""

from __future__ import annotations

import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from marquetry.operators import specs
from marquetry.sources import datasets, mappings, sidecar, store
from marquetry.sources.files import read_journal, write_journal


def tables(spark, n):
    df = spark.createDataFrame([(f"w{i}", f"Band {i}", None) for i in range(n)], "band_id string, name string, x string")
    item, ext_id, alias = specs.build(df, datasets.DATASETS["metal-archives"])
    return {"item": item, "ext_id": ext_id, "alias": alias}


def test_a_store_is_published_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert store.open_store(spark, folder) is None
    assert store.publish(tables(spark, 5), folder, "metal-archives", "r1", 6, skipped=1) == 5
    opened = store.open_store(spark, folder)
    assert (opened.rows, opened.revision, opened.item.count(), opened.ext_id.count()) == (5, "r1", 5, 5)
    for declared in (4, 7):
        with pytest.raises(ValueError):
            store.publish(tables(spark, 5), folder, "metal-archives", "r2", declared)
    with pytest.raises(ValueError):
        store.publish(tables(spark, 0), folder, "metal-archives", "r2", 0)
    assert store.open_store(spark, folder).revision == "r1"
    store.publish(tables(spark, 7), folder, "metal-archives", "r3", 7)
    assert store.open_store(spark, folder).item.count() == 7 and len(list((tmp_path / "store").glob("v-*"))) == 1


def test_damaged_and_foreign_stores_are_absent(spark, tmp_path):
    folder = tmp_path / "store"
    store.publish(tables(spark, 3), str(folder), "d", "r", 3)
    pointer = folder / store.POINTER
    meta = json.loads(pointer.read_text())
    for text in ("", "{", "[]", json.dumps(meta | {"schema": 99}), json.dumps(meta | {"version": "v-gone"}), json.dumps({"schema": 1})):
        store.Files(spark).replace(str(pointer), text)
        assert store.open_store(spark, str(folder)) is None, text
    store.Files(spark).replace(str(pointer), json.dumps(meta))
    assert store.open_store(spark, str(folder)) is not None


def test_mappings_from_files(spark, tmp_path):
    (tmp_path / "a.toml").write_text('[[artist]]\nname = "A"\nsoundcloud_artist_url = "https://SoundCloud.com/acid/"\nbandcamp_band_id = "007"\n[[artist]]\nx = "1"\nscore = 0.3\n[[nonsense]]\nx = "2"\n')
    (tmp_path / "b.toml").write_text('[[artist]]\nsoundcloud_artist_url = "https://soundcloud.com/acid"\nmusicbrainz_artist = "mb"\n')
    (tmp_path / "c.toml").write_text("[[artist\n")
    found = mappings.merged(mappings.load(spark, *(str(tmp_path / f"{n}.toml") for n in "abcd")))
    assert {(r.entry, r.field) for r in found.collect()} == {(0, "soundcloud_artist_url"), (0, "bandcamp_band_id"), (0, "musicbrainz_artist"), (1, "x")}
    ids = spark.createDataFrame([("k", "artist", "musicbrainz_artist", "mb"), ("k", "artist", "bandcamp_band_id", "9"), ("l", "artist", "x", "1"), ("m", "label", "musicbrainz_artist", "mb"), ("n", "artist", "musicbrainz_artist", "mb")], "key string, role string, field string, value string")
    got = {(r.key, r.field): (r.value, r.mapped) for r in mappings.applied(found, ids, min_score=0.5).collect()}
    assert got["k", "bandcamp_band_id"] == ("9", False) and got["n", "bandcamp_band_id"] == ("7", True)
    assert {f for k, f in got if k == "k"} == {"musicbrainz_artist", "bandcamp_band_id", "soundcloud_artist_url"}
    assert {f for k, f in got if k == "l"} == {"x"} and {f for k, f in got if k == "m"} == {"musicbrainz_artist"}
    more = mappings.added(found, "label", {"wikidata": "Q1", "musicbrainz_artist": "mb"}, "L", 2.0)
    assert more.where("role = 'label'").select("entry", "score").distinct().collect() == [(2, 1.0)] and found.where("role = 'label'").count() == 0
    assert mappings.load(spark).count() == 0


def test_sidecar(spark, tmp_path):
    folder = str(tmp_path / "side")
    assert sidecar.load(spark, folder).count() == 0
    rows = [("e1", "artist", "group", "Café Noir", ["Cafe-Noir", ""], {"mb": "1", "x": ""}, None), ("e2", "label", None, "Café noir", None, None, ["w"]), ("e3", "artist", None, "Other", ["café noir"], {"mb": "2"}, [])]
    entities = spark.createDataFrame(rows, sidecar.SCHEMA)
    for _ in range(2):
        sidecar.save(entities, folder)
    loaded = sidecar.load(spark, folder)
    assert loaded.count() == 3 and len(list((tmp_path / "side").glob("v*"))) == 1
    names = spark.createDataFrame([(1, "artist", "CAFÉ_NOIR"), (2, "label", "café noir"), (3, "track", "café noir")], "key int, role string, name string")
    assert sorted(tuple(r) for r in sidecar.by_name(loaded, names).collect()) == [(1, "e1"), (1, "e3"), (2, "e2")]
    ids = spark.createDataFrame([(1, "artist", "mb", "2"), (2, "label", "mb", "1"), (3, "artist", "x", "")], "key int, role string, field string, value string")
    assert [tuple(r) for r in sidecar.by_external_id(loaded, ids).collect()] == [(1, "e3")]


def test_journal_is_rewritten_and_removed(spark, tmp_path):
    path, schema = str(tmp_path / "j"), "src string, dst string"
    assert read_journal(spark, path, schema).count() == 0
    rows = spark.createDataFrame([("a", "b"), ("c", "d")], schema)
    assert write_journal(rows, path) == 2 and write_journal(rows.where("src = 'a'"), path) == 1
    assert [tuple(r) for r in read_journal(spark, path, schema).collect()] == [("a", "b")]
    assert write_journal(rows.where("false"), path) == 0 and not (tmp_path / "j").exists()
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == []


def test_plugins_settle(spark):
    def one(d):
        return d.withColumn("x", F.lit(1))

    def bad():
        specs.register("lost", one)
        raise RuntimeError("no network")

    def greedy():
        specs.unregister("base")
        specs._ADAPTERS["base2"] = (1, one)
        specs._ADAPTERS["nothing"] = "text"
        specs.register("new", one)

    specs.register("base", one), specs.register("base2", lambda d: d)
    try:
        assert specs.settle("bad", bad) == "bad: RuntimeError: no network" and specs.registered() == ["base", "base2"]
        assert specs.settle("greedy", greedy) == "greedy: base removed; base2 replaced; nothing are no adapters"
        assert specs.registered() == ["base", "base2", "new"] and specs.settle("idle", lambda: None) == "idle: registered nothing"
        assert specs.settle("fine", lambda: specs.register("fine", lambda d: d.select("missing"))) is None
        errors = []
        got = specs.candidates(spark.createDataFrame([(1,)], "query_id long"), errors)
        assert {r.source for r in got.collect()} == {"base", "base2", "new"} and [e[:3] for e in errors] == [("fine", "candidates", "AnalysisException")]
        with pytest.raises(TypeError):
            specs.register("text", "text")
        assert specs.load_plugins() == {}
        package = types.ModuleType("json")
        package.__path__ = sys.modules["json"].__path__
        assert "decoder" in specs.discover(package)
    finally:
        for name in ("base", "base2", "new", "fine"):
            specs.unregister(name)
