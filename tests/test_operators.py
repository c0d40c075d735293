"""Clusters, pages, files and streams on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marquetry.operators.clusters import mapping_clusters
from marquetry.operators.skew import ranked
from marquetry.session import Scratch
from marquetry.sources import pages
from marquetry.sources.files import read_journal, scan_media_files, write_store
from marquetry.sources.tables import MissingColumns, require
from marquetry.streaming import jobs

def test_clusters_bridge_and_roles(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("a", 3, "y"), ("b", 1, "x"), ("b", 2, "x"), ("a", 9, "z"), ("a", None, "x"), ("a", 4, None), ("a", 1, "x")]
    rows += [("c", i, f"n{i}") for i in range(40)] + [("c", i, f"n{i + 1}") for i in range(40)]
    got = {(r.role, r.entry): r.cluster for r in mapping_clusters(spark.createDataFrame(rows, "role string, entry long, identifier string")).collect()}
    assert {k: v for k, v in got.items() if k[0] != "c"} == {("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("a", 9): 9, ("b", 1): 1, ("b", 2): 1}
    assert {v for k, v in got.items() if k[0] == "c"} == {0}
    assert mapping_clusters(spark.createDataFrame([], "role string, entry long, identifier string")).count() == 0


def test_pages():
    assert pages.table_rows("<table><tr><th>B<th>A</tr><tr><td>1<td>x &amp; y</tr><tr><td>2</table>", ("a", "b")) == [("x & y", "1"), (None, "2")]
    assert pages.table_rows("<table><tr><td>1<td>2</table>", ("a", "b", "c")) == [("1", "2", None)]
    assert pages.table_rows(None, ("a",)) == []
    assert pages.spec_rows("<h3>Video</h3>Codec: AVC<br>none<h3>Audio</h3>English: DTS: 5.1") == [("Video", "Codec", "AVC"), ("Audio", "English", "DTS: 5.1")]
    assert pages.release_rows("<h2>US</h2><li>Theatrical (116:37)</li><h2>DE</h2><li>-</li>") == [(0, "US", "Theatrical", 6997)]
    feed = "<rss><channel><item><title>a</title><duration>1</duration></item><item><title>b"
    assert pages.feed_rows(feed) == [(0, "a", "", "1")]
    assert pages.feed_rows("not xml") == pages.feed_rows(None) == []
    people = '<rss xmlns:p="x"><channel><author>Ann</author><item><p:person role="Guest">Bo</p:person><author>x</author></item><item><p:person>Cy</p:person><p:person> </p:person></item><item>'
    assert pages.feed_people(people) == [(-1, "Ann", "host", ""), (0, "Bo", "guest", ""), (1, "Cy", "host", "")]
    assert pages.feed_people(people.replace("<item>", '<p:person role="host" group="cast">Di</p:person><item>', 1))[0] == (-1, "Di", "host", "cast") and pages.feed_people(None) == []


def test_files_and_store(spark, tmp_path):
    for name in ("a.mkv", "b-trailer.mp4", "c.mp3", "d.txt", "Extras/e.mkv"):
        p = tmp_path / "media" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    assert sorted((r.path.rsplit("/", 1)[1], r.kind) for r in scan_media_files(spark, str(tmp_path / "media")).collect()) == [("a.mkv", "video"), ("c.mp3", "music")]
    (tmp_path / "j.jsonl").write_text(json.dumps({"src": "a"}) + "\n{broken\n" + json.dumps({"src": "b"}) + "\n")
    assert read_journal(spark, str(tmp_path / "j.jsonl"), "src string").count() == 2
    df, path = spark.range(5), str(tmp_path / "store")
    assert write_store(df, path, 5, ["id"]) == 5
    with pytest.raises(ValueError):
        write_store(spark.range(3), path, 4, ["id"])
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(MissingColumns):
        require(df, "store", ["title"])


def test_ranked_is_a_row_number(spark):
    rows = [(k, (i * 37) % 101, i) for i in range(300) for k in ("a", "b", None)[: 1 + i % 3]]
    df = spark.createDataFrame(rows, "k string, x int, i int")
    got = ranked(df, ["k"], [F.col("x"), F.col("i")], "nth", Scratch(spark))
    want = df.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy("x", "i")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ranked(df.where("false"), ["k"], [F.col("x")], "nth", Scratch(spark)).count() == 0


def test_a_failing_cycle_is_recorded(spark, tmp_path):
    for i in range(3):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []

    def handle(batch, number):
        seen.append(number)
        raise ValueError("broken")

    jobs.watch(spark, f"{tmp_path}/in", "id long", handle, f"{tmp_path}/check", attempts=2).awaitTermination()
    lost = jobs.failed_files(spark, f"{tmp_path}/check").collect()
    assert len(seen) == 2 and len(lost) == 3 and all("broken" in r.error for r in lost)
    assert jobs.failed_files(spark, f"{tmp_path}/none").count() == 0


def test_buckets_caches_and_streams(spark, tmp_path):
    rows = [(u, i, 1.6e9 + t) for u in (1, 2) for i, t in enumerate((0, 1, 2, 3, 100, 101, 5000))]
    events = spark.createDataFrame(rows, "user_id long, event_id long, second double")
    step, want = jobs.bucket_step(0.01, 2.0), {}
    for u in (1, 2):
        state = None
        for r in sorted(events.where(f"user_id = {u}").collect(), key=lambda r: r.second):
            state, want[u, r.event_id] = step(state, r)
    got = {(r.user_id, r.event_id): (r.granted, r.wait_s) for r in jobs.token_bucket(events, 0.01, 2.0).collect()}
    assert got == want and not all(g for g, _ in want.values())
    hits = [r.hit for r in jobs.ttl_cache(events.where("user_id = 1"), 99.0).orderBy("event_id").collect()]
    assert hits == [False, True, True, True, False, True, False]
    scratch = Scratch(spark)
    timed = events.withColumn("ts", F.timestamp_seconds("second"))
    timed.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/in")
    jobs.stream_token_bucket(stream, 0.01, 2.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{scratch.root}/c").trigger(availableNow=True).start().awaitTermination()
    assert {(r.user_id, r.event_id): (r.granted, r.wait_s) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
