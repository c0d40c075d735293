"""Lookups and merges through shared identifiers and titles, linear in the rows.

What an identifier or title can answer is aggregated before anyone asks, so a value that very many rows
share costs no more than they are; rows equal in all that matters stand for each other. The DuckDB twins
are written on their own, with the joins and windows that this avoids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.scalars import column
from marquetry.operators.skew import hot_split_join, ranked
from marquetry.session import Scratch
from marquetry.sources.adapters import CATALOGUES
from marquetry.sources.tables import table

# Identifiers that name nothing, and fields that name another work or a company.
PLACEHOLDERS = ("", "-", "0", "n/a", "none", "null", "unknown", "tt0000000", "00000000-0000-0000-0000-000000000000")
FOREIGN = ("derived_from_imdb", "studio_id", "network_id")
#: Sources in the order they are asked: by priority, then name; a source without one comes last.
PRIORITY = {c.name: c.priority for c in CATALOGUES}


def _asked(source: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(PRIORITY.items()) for x in kv])[source], F.lit(99))


def catalogue(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Every item_id's row, the one loaded last."""
    rows = table(spark, folder, "catalog_item", "item_id", "source", "kind", "title", "year", "runtime_min", "ext_ids", "overview", "loaded_at", "fetched_at")
    kept = [c for c in columns if c != "item_id"]
    row = F.struct(*[(F.array_sort(F.map_entries(c)) if c == "ext_ids" else F.col(c)).alias(c) for c in kept])
    order = F.struct("loaded_at", "fetched_at", F.coalesce("overview", F.lit("")).alias("o"))
    return rows.groupBy("item_id").agg(F.max_by(row, order).alias("r")).select("item_id", "r.*")


def _name(c: str) -> Column:
    return F.lower(F.trim(c))


def _own_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, source, field, value) of the catalogue's real identifiers."""
    rows = catalogue(spark, folder, "source", "ext_ids").select("item_id", "source", F.explode("ext_ids").alias("e"))
    return rows.select("item_id", "source", F.col("e.key").alias("field"), F.trim("e.value").alias("value")).where(~F.lower("value").isin(*PLACEHOLDERS) & ~F.col("field").isin(*FOREIGN))


def _store_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(pk, field, value) of the store's identifiers that name the item itself."""
    value = F.lower(F.trim("value"))
    return table(spark, folder, "ext_id", "field", "value", "pk").select("pk", "field", value.alias("value")).where(F.col("field").isNotNull() & ~F.col("field").isin(*FOREIGN) & ~value.isin(*PLACEHOLDERS)).distinct()


def _beside(many: DataFrame, one: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``many`` joined to ``one`` (a row a key, with its number of rows n), hot keys split."""
    held, seen = scratch.measured(one, total=F.sum("n"), largest=F.max("n"))
    return hot_split_join(many, held, keys, "n", seen["total"] or 1, largest=seen["largest"] or 0)


def q_ids_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The identifiers of rows of one kind and title together, the source asked first deciding each field."""
    rows = catalogue(spark, folder, "source", "kind", "title", "ext_ids").select("item_id", "source", "kind", _name("title").alias("name"), F.explode("ext_ids").alias("e")).where("name <> '' and trim(e.value) <> ''")
    best = rows.groupBy("kind", "name", F.col("e.key").alias("field")).agg(F.min(F.struct(_asked(F.col("source")).alias("p"), "source", "item_id", F.trim("e.value").alias("value"))).alias("b"))
    return best.select("kind", "name", "field", "b.value", "b.source")


def q_front_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Of the other sources that hold a row's title the one asked first, its first row and how many it has."""
    rows = Scratch(spark).keep(catalogue(spark, folder, "source", "kind", "title").withColumn("name", _name("title")).where("name <> ''"))
    held = rows.groupBy("kind", "name", "source").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n"))
    answers = held.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(_asked(F.col("source")).alias("p"), "source", "item_id", F.col("n").alias("rows")))).alias("sources"))  # no more entries than sources
    met = _beside(rows.select(F.col("item_id").alias("query_id"), "kind", "name", F.col("source").alias("own")), answers, ["kind", "name"], Scratch(spark))
    best = met.withColumn("b", F.expr("get(filter(sources, s -> s.source <> own), 0)")).where("b is not null")
    return best.select("query_id", "b.source", "b.item_id", F.col("b.rows").alias("n_rows"))


def q_front_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of another source that shares an identifier, over all fields in the order of their names."""
    rows = Scratch(spark).keep(_own_ids(spark, folder))
    held = rows.groupBy("field", "value", "source").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n"))
    answers = held.groupBy("field", "value").agg(F.sum("n").alias("n"), F.collect_list(F.struct(_asked(F.col("source")).alias("p"), "source", "item_id")).alias("sources"))
    met = _beside(rows.select(F.col("item_id").alias("query_id"), "field", "value", F.col("source").alias("own")), answers, ["field", "value"], Scratch(spark))
    best = met.select("query_id", "field", F.expr("array_min(filter(sources, s -> s.source <> own))").alias("b")).where("b is not null").groupBy("query_id").agg(F.min(F.struct("field", "b")).alias("m"))
    return best.select("query_id", "m.field", "m.b.source", "m.b.item_id")


def q_enrich_ids(spark: SparkSession, folder: str) -> DataFrame:
    """For every identifier the other identifiers of the rows that have it, the source asked first deciding each field."""
    rows = Scratch(spark).keep(_own_ids(spark, folder))
    pairs = rows.select("item_id", F.col("field").alias("by"), F.col("value").alias("id")).join(rows, "item_id").where("`by` <> field")  # a row has a few identifiers
    best = pairs.groupBy("by", "id", "field").agg(F.min(F.struct(_asked(F.col("source")).alias("p"), "source", "item_id", "value")).alias("b"))
    return best.select("by", "id", "field", "b.value")


def q_mapping_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The store's item for a catalogue row: the first identifier by field name that the store knows, its least pk."""
    asked = _own_ids(spark, folder).select("item_id", "field", F.lower("value").alias("value"))
    held = _store_ids(spark, folder).groupBy("field", "value").agg(F.min("pk").alias("pk"))
    counts = asked.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    met = _beside(asked, held.join(counts, ["field", "value"]), ["field", "value"], Scratch(spark))
    return met.groupBy("item_id").agg(F.min(F.struct("field", "pk")).alias("m")).select("item_id", "m.field", F.col("m.pk").alias("cluster"))


def q_mapping_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Every item's identifiers and what items sharing one of them add; its own win, then the least value."""
    scratch = Scratch(spark)
    rows = scratch.keep(_store_ids(spark, folder))
    own = rows.groupBy("pk", "field").agg(F.min("value").alias("value"))
    shared = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = scratch.keep(_beside(rows, shared, ["field", "value"], scratch).select("pk", F.col("field").alias("by"), F.col("value").alias("id")))
    added = links.join(own, "pk").groupBy("by", "id", "field").agg(F.min("value").alias("value"))
    known = added.groupBy("by", "id").agg(F.collect_list(F.struct("field", "value")).alias("adds")).join(shared.select(F.col("field").alias("by"), F.col("value").alias("id"), "n"), ["by", "id"])  # no more than there are fields
    gained = _beside(links, known, ["by", "id"], scratch).select("pk", F.explode("adds").alias("a")).select("pk", "a.field", "a.value", F.lit(1).alias("prio"))
    best = own.withColumn("prio", F.lit(0)).unionByName(gained).groupBy("pk", "field").agg(F.min(F.struct("prio", "value")).alias("b"))
    return best.select("pk", "field", "b.value", "b.prio")


def q_edition_work(spark: SparkSession, folder: str) -> DataFrame:
    """Every row that has identifiers beside the least row that shares one with it."""
    rows = _own_ids(spark, folder)
    least = rows.groupBy("field", "value").agg(F.min("item_id").alias("work"), F.count(F.lit(1)).alias("n"))
    return _beside(rows, least, ["field", "value"], Scratch(spark)).groupBy(F.col("item_id").alias("edition")).agg(F.min("work").alias("work"))


def q_id_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of the same kind and title agree and how many disagree with a row, by id field."""
    rows = Scratch(spark).keep(catalogue(spark, folder, "kind", "title", "ext_ids").select("item_id", "kind", _name("title").alias("name"), F.explode("ext_ids").alias("e")).select("item_id", "kind", "name", F.col("e.key").alias("field"), F.trim("e.value").alias("value")).where(~F.lower("value").isin(*PLACEHOLDERS) & F.col("name").isNotNull()))
    values = rows.groupBy("kind", "name", "field", "value").agg(F.count(F.lit(1)).alias("same"))
    totals = values.groupBy("kind", "name", "field").agg(F.sum("same").alias("total"))
    classes = values.join(totals, ["kind", "name", "field"]).where("total > 1").withColumn("n", F.col("same"))
    met = _beside(rows, classes, ["kind", "name", "field", "value"], Scratch(spark))
    return met.select("item_id", "field", (F.col("same") - 1).alias("agrees"), (F.col("total") - F.col("same")).alias("contradicts"))


def q_candidate_block_join(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of rows of two sources with one kind and title, years one apart at most and runtimes two minutes.

    A class are the rows equal in source, kind, title, year and runtime; ``a`` and ``b`` are its least rows,
    ``n_a`` and ``n_b`` how many rows they stand for. A missing runtime goes with any, a missing year with none.
    """
    runtime = F.when((F.col("runtime_min") > 0) & ~F.isnan("runtime_min"), F.col("runtime_min"))
    rows = catalogue(spark, folder, "source", "kind", "title", "year", "runtime_min").select("item_id", "source", "kind", _name("title").alias("name"), "year", runtime.alias("runtime")).where("name is not null and year is not null")
    classes = Scratch(spark).keep(rows.groupBy("source", "kind", "name", "year", "runtime").agg(F.min("item_id").alias("i"), F.count(F.lit(1)).alias("n")))
    half = "floor(runtime / 2)"
    left = classes.select("kind", "name", F.col("source").alias("s1"), F.col("i").alias("i1"), F.col("n").alias("n1"), F.col("runtime").alias("r1"), F.explode(F.expr("array(year - 1, year, year + 1)")).alias("year"), F.expr(f"if(runtime is null, array('any'), array(string({half} - 1), string({half}), string({half} + 1), 'none'))").alias("bins")).withColumn("bin", F.explode("bins")).drop("bins")
    right = classes.select("kind", "name", "source", "i", "n", "runtime", "year", F.explode(F.expr(f"array(coalesce(string({half}), 'none'), 'any')")).alias("bin"))
    met = left.join(right, ["kind", "name", "year", "bin"]).where("s1 < source and (r1 is null or runtime is null or abs(r1 - runtime) <= 2)")
    return met.select(F.col("i1").alias("a"), F.col("i").alias("b"), F.col("n1").alias("n_a"), F.col("n").alias("n_b")).distinct()


def q_sidecar_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """People known under a sort name or a house name: the first and how many, by kind of the person."""
    people = table(spark, folder, "person", "person_id", "kind", "name", "aliases").select("person_id", "kind", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    named = people.select("person_id", "kind", column("norm_entity_name", x="n").alias("norm")).where("norm <> ''").distinct().groupBy("kind", "norm").agg(F.min("person_id").alias("person_id"), F.count(F.lit(1)).alias("people"))
    given = table(spark, folder, "house_person", "person_id", "name").select("person_id", "name").unionByName(table(spark, folder, "person", "person_id", "sort_name").withColumnRenamed("sort_name", "name"))
    asked = given.select(F.col("person_id").alias("asked_id"), column("norm_entity_name", x="name").alias("norm")).where("norm <> ''").distinct()
    return asked.join(named, "norm").select("asked_id", F.col("kind").alias("person_kind"), "person_id", "people")


def q_albums_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every row among those of its source and kind, by date (missing last), title and item_id."""
    rows = table(spark, folder, "catalog_item", "item_id", "source", "kind", "release_date", "title").distinct()
    rows = rows.groupBy("item_id", "source", "kind").agg(F.min(F.coalesce("release_date", F.lit("9999"))).alias("d"), F.min(F.coalesce("title", F.lit(""))).alias("t"))
    return ranked(rows, ["source", "kind"], [F.col("d"), F.col("t"), F.col("item_id")], "nth", Scratch(spark)).select("source", "kind", "item_id", "nth")


def q_genre_antifilter(spark: SparkSession, folder: str) -> DataFrame:
    """Items of a kind and year without the genre their question refuses (the kind's least genre), or all where none are."""
    items = table(spark, folder, "item", "pk", "kind", "year", "data").where("year is not null").select("pk", "kind", "year", F.coalesce(F.from_json(F.get_json_object("data", "$.genres"), "array<string>"), F.array().cast("array<string>")).alias("genres"))
    items = Scratch(spark).keep(items.groupBy("pk", "kind", "year").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("genres")))).alias("genres")))  # the repeats of one pk
    refused = items.select("kind", F.explode("genres").alias("g")).groupBy("kind").agg(F.min("g").alias("refused"))  # a row a kind
    rows = items.join(F.broadcast(refused), "kind", "left").withColumn("clean", ~F.coalesce(F.array_contains("genres", F.col("refused")), F.lit(False)))
    left = rows.groupBy("kind", "year").agg(F.bool_or("clean").alias("any_clean"))
    return rows.join(left, ["kind", "year"]).where("clean = any_clean").select("kind", "year", "pk")


def q_chain_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """From a catalogue row's identifier to the store's item, on to that item's first other identifier, and to its details."""
    ids = Scratch(spark).keep(_store_ids(spark, folder))
    asked = _own_ids(spark, folder).select("item_id", "field", F.lower("value").alias("value"))
    items = ids.groupBy("field", "value").agg(F.min("pk").alias("pk"))
    reached = asked.join(items, ["field", "value"]).groupBy("item_id").agg(F.min(F.struct("field", "pk")).alias("m")).select("item_id", F.col("m.field").alias("by"), "m.pk")
    onward = reached.join(ids, "pk").where("field <> `by`").groupBy("item_id", "by", "pk").agg(F.min(F.struct("field", "value")).alias("n"))
    details = table(spark, folder, "item", "pk", "kind", "title").groupBy("pk").agg(F.max(F.struct("title", "kind")).alias("d"))
    return onward.join(details, "pk").select("item_id", "by", "pk", "n.field", "n.value", "d.title", "d.kind")


def q_cache_size(spark: SparkSession, folder: str) -> DataFrame:
    """Entries and bytes of the stored answers by provider; an answer stored twice counts once."""
    rows = table(spark, folder, "api_payload", "provider", "endpoint", "request_key", "body").groupBy("provider", "endpoint", "request_key").agg(F.max(F.coalesce(F.octet_length("body"), F.lit(0))).alias("bytes"))
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_NONE = ", ".join(f"'{v}'" for v in PLACEHOLDERS)
_NOT = ", ".join(f"'{v}'" for v in FOREIGN)
_P = "CASE {s} " + " ".join(f"WHEN '{n}' THEN {p}" for n, p in sorted(PRIORITY.items())) + " ELSE 99 END"
_LATEST = """l AS (SELECT * FROM catalog_item QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC NULLS LAST, fetched_at DESC NULLS LAST, coalesce(overview, '') DESC) = 1)"""
_IDS = f"o AS (SELECT DISTINCT item_id, source, e.key AS field, trim(e.value, ' ') AS value FROM (SELECT item_id, source, unnest(map_entries(ext_ids)) AS e FROM l) u WHERE lower(trim(e.value, ' ')) NOT IN ({_NONE}) AND e.key NOT IN ({_NOT}))"
_STORE = f"s AS (SELECT DISTINCT pk, field, lower(trim(value, ' ')) AS value FROM ext_id WHERE field NOT IN ({_NOT}) AND lower(trim(value, ' ')) NOT IN ({_NONE}))"
_NORM = r"trim(regexp_replace(lower({x}), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')"


def _p(s: str) -> str:
    return _P.replace("{s}", s)


ORACLE = {
    "ids_merge": f"""
        WITH {_LATEST}, e AS (SELECT item_id, source, kind, lower(trim(title, ' ')) AS name, unnest(map_entries(ext_ids)) AS e FROM l)
        SELECT kind, name, e.key AS field, trim(e.value, ' ') AS value, source FROM e WHERE name <> '' AND trim(e.value, ' ') <> ''
        QUALIFY row_number() OVER (PARTITION BY kind, name, e.key ORDER BY {_p("source")}, source, item_id, trim(e.value, ' ')) = 1""",
    "front_candidates": f"""
        WITH {_LATEST}, t AS (SELECT item_id, source, kind, lower(trim(title, ' ')) AS name FROM l WHERE trim(title, ' ') <> '')
        SELECT a.item_id AS query_id, b.source, min(b.item_id) AS item_id, count(*) AS n_rows FROM t a JOIN t b ON a.kind = b.kind AND a.name = b.name AND a.source <> b.source GROUP BY a.item_id, b.source
        QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY {_p("b.source")}, b.source) = 1""",
    "front_enrich": f"""
        WITH {_LATEST}, {_IDS}
        SELECT a.item_id AS query_id, a.field, b.source, b.item_id FROM o a JOIN o b ON a.field = b.field AND a.value = b.value AND a.source <> b.source
        QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY a.field, {_p("b.source")}, b.source, b.item_id) = 1""",
    "enrich_ids": f"""
        WITH {_LATEST}, {_IDS}
        SELECT a.field AS by, a.value AS id, b.field, b.value FROM o a JOIN o b ON a.item_id = b.item_id AND a.field <> b.field
        QUALIFY row_number() OVER (PARTITION BY a.field, a.value, b.field ORDER BY {_p("b.source")}, b.source, b.item_id, b.value) = 1""",
    "mapping_lookup": f"""
        WITH {_LATEST}, {_IDS}, {_STORE}
        SELECT o.item_id, o.field, s.pk AS cluster FROM o JOIN s ON s.field = o.field AND s.value = lower(o.value) QUALIFY row_number() OVER (PARTITION BY o.item_id ORDER BY o.field, s.pk) = 1""",
    "mapping_apply": f"""
        WITH {_STORE}, g AS (SELECT DISTINCT a.pk, b.pk AS twin FROM s a JOIN s b ON a.field = b.field AND a.value = b.value AND a.pk <> b.pk),
        u AS (SELECT pk, field, value, 0 AS prio FROM s UNION ALL SELECT g.pk, s.field, s.value, 1 FROM g JOIN s ON s.pk = g.twin)
        SELECT pk, field, value, prio FROM u QUALIFY row_number() OVER (PARTITION BY pk, field ORDER BY prio, value) = 1""",
    "edition_work": f"WITH {_LATEST}, {_IDS} SELECT a.item_id AS edition, min(b.item_id) AS work FROM o a JOIN o b ON a.field = b.field AND a.value = b.value GROUP BY a.item_id",
    "id_agreement": f"""
        WITH {_LATEST}, d AS (SELECT item_id, kind, lower(trim(title, ' ')) AS name, e.key AS field, trim(e.value, ' ') AS value FROM (SELECT item_id, kind, title, unnest(map_entries(ext_ids)) AS e FROM l) u WHERE lower(trim(e.value, ' ')) NOT IN ({_NONE}) AND title IS NOT NULL)
        SELECT a.item_id, a.field, count(*) FILTER (WHERE a.value = b.value) AS agrees, count(*) FILTER (WHERE a.value <> b.value) AS contradicts FROM d a JOIN d b ON a.kind = b.kind AND a.name = b.name AND a.field = b.field AND a.item_id <> b.item_id GROUP BY a.item_id, a.field""",
    "candidate_block_join": f"""
        WITH {_LATEST}, t AS (SELECT source, kind, lower(trim(title, ' ')) AS name, year, CASE WHEN runtime_min > 0 AND NOT isnan(runtime_min) THEN runtime_min END AS r, min(item_id) AS i, count(*) AS n FROM l WHERE title IS NOT NULL AND year IS NOT NULL GROUP BY ALL)
        SELECT a.i AS a, b.i AS b, a.n AS n_a, b.n AS n_b FROM t a JOIN t b ON a.kind = b.kind AND a.name = b.name AND a.source < b.source AND abs(a.year - b.year) <= 1 AND coalesce(abs(a.r - b.r) <= 2, TRUE)""",
    "sidecar_by_name": f"""
        WITH n AS (SELECT DISTINCT person_id, kind, {_NORM.replace("{x}", "x")} AS norm FROM (SELECT person_id, kind, name AS x FROM person UNION ALL SELECT person_id, kind, unnest(aliases) FROM person) p)
        SELECT g.asked_id, n.kind AS person_kind, min(n.person_id) AS person_id, count(DISTINCT n.person_id) AS people
        FROM (SELECT DISTINCT person_id AS asked_id, {_NORM.replace("{x}", "name")} AS norm FROM (SELECT person_id, name FROM house_person UNION ALL SELECT person_id, sort_name FROM person) h) g JOIN n ON n.norm = g.norm WHERE n.norm <> '' GROUP BY g.asked_id, n.kind""",
    "albums_sorted": """
        SELECT source, kind, item_id, row_number() OVER (PARTITION BY source, kind ORDER BY d, t, item_id) AS nth FROM (SELECT item_id, source, kind, min(coalesce(release_date, '9999')) AS d, min(coalesce(title, '')) AS t FROM catalog_item GROUP BY ALL) x""",
    "genre_antifilter": """
        WITH i AS (SELECT DISTINCT pk, kind, year, list_sort(CAST(json_extract_string(data, '$.genres[*]') AS VARCHAR[])) AS g FROM item WHERE year IS NOT NULL),
        u AS (SELECT pk, kind, year, list_distinct(flatten(list(coalesce(g, [])))) AS g FROM i GROUP BY pk, kind, year),
        f AS (SELECT kind, min(x) AS refused FROM (SELECT kind, unnest(g) AS x FROM u) GROUP BY kind),
        c AS (SELECT u.pk, u.kind, u.year, NOT coalesce(list_contains(u.g, f.refused), FALSE) AS clean FROM u LEFT JOIN f ON f.kind = u.kind)
        SELECT kind, year, pk FROM c QUALIFY clean = bool_or(clean) OVER (PARTITION BY kind, year)""",
    "chain_lookup": f"""
        WITH {_LATEST}, {_IDS}, {_STORE}, r AS (SELECT o.item_id, o.field AS by, s.pk FROM o JOIN s ON s.field = o.field AND s.value = lower(o.value) QUALIFY row_number() OVER (PARTITION BY o.item_id ORDER BY o.field, s.pk) = 1),
        d AS (SELECT pk, title, kind FROM item QUALIFY row_number() OVER (PARTITION BY pk ORDER BY title DESC NULLS LAST, kind DESC NULLS LAST) = 1)
        SELECT r.item_id, r.by, r.pk, s.field, s.value, d.title, d.kind FROM r JOIN s ON s.pk = r.pk AND s.field <> r.by JOIN d ON d.pk = r.pk QUALIFY row_number() OVER (PARTITION BY r.item_id ORDER BY s.field, s.value) = 1""",
    "cache_size": "SELECT provider, count(*) AS entries, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT provider, max(coalesce(strlen(body), 0)) AS b FROM api_payload GROUP BY provider, endpoint, request_key) x GROUP BY provider",
}
