"""Questions against candidates: comparison, grading, picking and consolidation.

Questions are rows: every item whose pk is divisible by 50 asks for its own title, year and kind among
all catalogue rows. The DuckDB twins are written on their own, with windows and recursion where the
queries here use pre-aggregated minima and rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.text import fuzzy_ratio
from marquetry.operators import fusion
from marquetry.operators.skew import hot_split_join
from marquetry.session import Scratch
from marquetry.sources.tables import table

# What stands for "no value" in an answer.
NO_VALUE = ("", "-", "?", "n/a", "na", "nan", "none", "null", "unknown", "und", "tba", "tbd")


def _real(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*NO_VALUE), F.trim(c))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Providers' answers with their signals flat: values that are none null, the provider's registration beside."""
    matches = table(spark, folder, "provider_match", "query_id", "match_id", "provider", "confidence", "signals").withColumn("provider", F.lower(F.trim("provider")))
    s = lambda f: F.col(f"signals.{f}")
    runtime = F.when((s("runtime") > 0) & ~F.isnan(s("runtime")), s("runtime"))
    flat = matches.select("query_id", "match_id", "provider", "confidence", _real(s("title")).alias("title"), _real(s("artist")).alias("artist"), F.when(s("year").between(1000, 2100), s("year")).alias("year"), s("season").alias("season"), runtime.alias("runtime"), F.lower(_real(s("medium"))).alias("medium"), _real(s("language")).alias("language"), _real(s("country")).alias("country"))
    return flat.distinct().join(F.broadcast(providers(spark, folder)), "provider", "left")


def providers(spark: SparkSession, folder: str) -> DataFrame:
    """(provider, seq) of the registry, which holds one row for each adapter the engine has."""
    return table(spark, folder, "provider", "provider", "seq").groupBy("provider").agg(F.min("seq").alias("seq"))


def q_consolidate(spark: SparkSession, folder: str) -> DataFrame:
    _, results = fusion.consolidate(answers(spark, folder))
    return results.select("query_id", "anchor", "n_accepted", "n_dropped", "confidence", "conflicted", "title", "year", "medium", "season", "runtime")


def q_consolidate_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    verdicts, _ = fusion.consolidate(answers(spark, folder))
    return verdicts.where("not accepted").select("query_id", "match_id", "provider", "against", F.array_join("fields", ",").alias("fields"))


def q_consolidate_dated(spark: SparkSession, folder: str) -> DataFrame:
    """Consolidation without comparing titles, which SQL can express."""
    _, results = fusion.consolidate(answers(spark, folder), titles=False)
    return results.select("query_id", "anchor", "n_accepted", "n_dropped", "conflicted", "title", "year", "medium", "season", "runtime", "artist")


def q_consolidate_local(spark: SparkSession, folder: str) -> DataFrame:
    """Consolidation in favour of what the asker knows: here the year that most answers to the query give."""
    rows = answers(spark, folder)
    local = rows.where("year is not null").groupBy("query_id", "year").count().groupBy("query_id").agg(F.max_by("year", F.struct("count", "year")).alias("year"))
    _, results = fusion.consolidate(rows, local, titles=False)
    return results.select("query_id", "anchor", "n_accepted", "n_dropped", "conflicted", "year", "medium", "runtime")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every answer (b) beside the first answer to its query (a)."""
    rows = Scratch(spark).keep(fusion.described(answers(spark, folder), "query_id", "match_id", "confidence", "seq").withColumnRenamed("s", "b"))
    first = rows.groupBy("query_id").agg(F.min_by("b", F.struct(-F.coalesce("confidence", F.lit(-1.0)), F.coalesce("seq", F.lit(1 << 30)), "match_id")).alias("a"), F.count(F.lit(1)).alias("n"))
    first, seen = Scratch(spark).measured(first, total=F.sum("n"), largest=F.max("n"))
    return hot_split_join(rows, first, ["query_id"], "n", seen["total"] or 1, largest=seen["largest"] or 0)


def q_compare_signals(spark: SparkSession, folder: str) -> DataFrame:
    fields = fusion.conflicts("a", "b", None)
    has = lambda f: F.array_contains("fields", f).alias(f"{f}_conflict")
    return _pairs(spark, folder).withColumn("fields", fields).select("query_id", "match_id", *[has(f) for f in ("year", "medium", "season", "runtime")])


def q_compare_titles(spark: SparkSession, folder: str) -> DataFrame:
    ratio = fusion.title_ratio(F.col("a.form"), F.col("b.form"))
    return _pairs(spark, folder).select("query_id", "match_id", F.round(ratio, 6).alias("ratio"), (ratio < fusion.TITLE_RATIO).alias("title_conflict"))


def q_match_quality(spark: SparkSession, folder: str) -> DataFrame:
    ratio = fusion.title_ratio(F.col("a.form"), F.col("b.form"))
    return _pairs(spark, folder).select("query_id", "match_id", F.round(fusion.match_quality("a", "b", ratio), 6).alias("quality"))


def q_candidate_score(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence by title ratio, 0 for a year known to be another; four places."""
    ratio = F.coalesce(fusion.title_ratio(F.col("a.form"), F.col("b.form")), F.lit(0.0))
    off = F.coalesce(F.expr("abs(a.year - b.year) > 1"), F.lit(False))
    return _pairs(spark, folder).select("query_id", "match_id", F.round(F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0)) * ratio * F.when(off, 0.0).otherwise(1.0), 4).alias("score"))


def q_best_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Of a query's answers the title most like the first one's, the earlier match among equals."""
    rows = _pairs(spark, folder).where("a.title is not null and b.title is not null")
    scored = rows.select("query_id", "match_id", F.round(fuzzy_ratio(F.col("a.title"), F.col("b.title")), 6).alias("ratio"))
    best = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "match_id")).alias("b"))
    return best.select("query_id", "b.match_id", (-F.col("b.r")).alias("ratio"))


def _norm(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Questions beside the catalogue rows of their kind whose titles have the same first word of four letters."""
    block = lambda c: F.regexp_extract(c, "([^ ]{4,})", 1).alias("block")
    items = table(spark, folder, "item", "pk", "title", "year", "kind").where("pk % 50 = 0").groupBy("pk").agg(F.max(F.struct("title", "year", "kind")).alias("i"))
    asked = items.select(F.col("pk").alias("query_id"), F.col("i.kind").alias("kind"), F.col("i.year").alias("asked_year"), _norm("i.title").alias("asked")).where("asked <> ''").select("*", block("asked"))
    rows = table(spark, folder, "catalog_item", "item_id", "kind", "title", "year", "loaded_at", "fetched_at").groupBy("item_id").agg(F.max(F.struct("loaded_at", "fetched_at", "title", "year", "kind")).alias("r"))
    held = rows.select("item_id", "r.kind", F.when(F.col("r.year").between(1000, 2200), F.col("r.year")).alias("year"), _norm("r.title").alias("norm")).where("norm <> ''")
    return asked.join(held.select("*", block("norm")), ["kind", "block"])


def _best(rows: DataFrame, *order: Column) -> DataFrame:
    """Of each question's hits the first by ``order``, then by item_id."""
    named = [c.alias(f"o{i}") for i, c in enumerate(order)]
    return rows.groupBy("query_id").agg(F.min(F.struct(*named, "item_id")).alias("b"))


def q_graded_title_match(spark: SparkSession, folder: str) -> DataFrame:
    """The best hit: .95 for the same title and a year no more than one apart, .85 for the same title, .60 for a part of it, else .35."""
    near = F.coalesce(F.abs(F.col("year") - F.col("asked_year")) <= 1, F.lit(False))
    score = F.when((F.col("norm") == F.col("asked")) & near, 0.95).when(F.col("norm") == F.col("asked"), 0.85).when(F.contains("norm", "asked") | F.contains("asked", "norm"), 0.60).otherwise(0.35)
    return _best(hits(spark, folder), -score).select("query_id", "b.item_id", (-F.col("b.o0")).alias("score"))


def q_pick_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """The first hit of the year asked for, else of a year beside it, else the first."""
    gap = F.coalesce(F.abs(F.col("year") - F.col("asked_year")), F.lit(9999))
    return _best(hits(spark, folder), F.when(gap == 0, 0).when(gap == 1, 1).otherwise(2)).select("query_id", "b.item_id", F.col("b.o0").alias("step"))


def q_year_filter_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Hits no more than one year from the question's; all hits where there are none such."""
    rows = hits(spark, folder).select("query_id", "item_id", F.coalesce(F.abs(F.col("year") - F.col("asked_year")) <= 1, F.lit(False)).alias("within"))
    any_within = rows.groupBy("query_id").agg(F.bool_or("within").alias("any_within"))
    return rows.join(any_within, "query_id").where("within = any_within").select("query_id", "item_id")


def q_hint_match(spark: SparkSession, folder: str) -> DataFrame:
    """The first answer whose country, language or provider contains the hint: the least country answered."""
    rows = answers(spark, folder).select("query_id", "match_id", "country", F.lower(F.concat_ws(" ", "country", "language", "provider")).alias("text"))
    hint = rows.groupBy("query_id").agg(F.min(F.lower("country")).alias("hint"))
    return rows.join(hint, "query_id").where("contains(text, hint)").groupBy("query_id").agg(F.min("match_id").alias("match_id"))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_CLEAN = "CASE WHEN lower(trim({x}, ' ')) NOT IN (" + ", ".join(f"'{v}'" for v in NO_VALUE) + ") THEN trim({x}, ' ') END"


def _clean(x: str) -> str:
    return _CLEAN.replace("{x}", x)


_ANSWERS = f"""
    a AS (SELECT DISTINCT m.query_id, m.match_id, lower(trim(m.provider, ' ')) AS provider, m.confidence, {_clean("m.signals.title")} AS title, {_clean("m.signals.artist")} AS artist,
        CASE WHEN m.signals.year BETWEEN 1000 AND 2100 THEN m.signals.year END AS year, m.signals.season AS season, CASE WHEN m.signals.runtime > 0 AND NOT isnan(m.signals.runtime) THEN m.signals.runtime END AS runtime,
        lower({_clean("m.signals.medium")}) AS medium, {_clean("m.signals.language")} AS language, {_clean("m.signals.country")} AS country FROM provider_match m),
    r AS (SELECT a.*, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(confidence, -1) DESC, coalesce(p.seq, 1000000000), match_id) AS rn FROM a LEFT JOIN provider p ON p.provider = a.provider)"""
_LIMIT = "CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CASE {a} WHEN 'movie' THEN 120 WHEN 'series' THEN 30 WHEN 'tv' THEN 0 WHEN 'music' THEN 3 WHEN 'music_video' THEN 30 WHEN 'podcast' THEN 30 WHEN 'book' THEN 0 ELSE 5 END ELSE 5 END"
_CLASH = f"(coalesce(abs(s.year - r.year) > 1, FALSE) OR coalesce(s.medium <> r.medium, FALSE) OR coalesce(s.season <> r.season, FALSE) OR coalesce(abs(s.runtime - r.runtime) > {_LIMIT.replace('{a}', 's.medium').replace('{b}', 'r.medium')}, FALSE))"


def _fold_sql(own: str, local: str) -> str:
    """A recursion along each query's answers; ``own`` is the clash with the local year, ``local`` the start's year."""
    keep = lambda f: f"CASE WHEN {own} OR {_CLASH} THEN s.{f} ELSE coalesce(s.{f}, r.{f}) END AS {f}"
    fields = ("title", "year", "medium", "season", "runtime", "artist")
    return f"""
        WITH RECURSIVE {_ANSWERS},
        l AS ({local}),
        q AS (SELECT query_id, max(rn) AS n FROM r GROUP BY query_id),
        s AS (SELECT q.query_id, 0::BIGINT AS at, NULL::VARCHAR AS title, l.year AS year, l.year AS own_year, NULL::VARCHAR AS medium, NULL::INT AS season, NULL::DOUBLE AS runtime, NULL::VARCHAR AS artist, NULL::VARCHAR AS anchor, 0::BIGINT AS n_accepted, 0::BIGINT AS n_dropped, FALSE AS conflicted
                FROM q LEFT JOIN l ON l.query_id = q.query_id
            UNION ALL
            SELECT s.query_id, r.rn, {", ".join(keep(f) for f in fields[:2])}, s.own_year, {", ".join(keep(f) for f in fields[2:])},
                CASE WHEN {own} OR {_CLASH} THEN s.anchor ELSE coalesce(s.anchor, r.provider) END, s.n_accepted + CASE WHEN {own} OR {_CLASH} THEN 0 ELSE 1 END, s.n_dropped + CASE WHEN {own} OR {_CLASH} THEN 1 ELSE 0 END, s.conflicted OR (NOT {own} AND {_CLASH})
                FROM s JOIN r ON r.query_id = s.query_id AND r.rn = s.at + 1)
        SELECT s.query_id, s.anchor, s.n_accepted, s.n_dropped, s.conflicted"""


def _ends(fields: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN NOT s.conflicted THEN s.{f} END AS {f}" for f in fields) + " FROM s JOIN q ON q.query_id = s.query_id AND q.n = s.at"


_WORDS = r"trim(regexp_replace(lower({x}), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')"
_LONG = "regexp_extract({x}, '([^ ]{4,})', 1)"
_HITS = f"""
    i AS (SELECT pk AS query_id, kind, year AS asked_year, {_WORDS.replace("{x}", "title")} AS asked FROM (SELECT DISTINCT pk, title, year, kind FROM item WHERE pk % 50 = 0)
        QUALIFY row_number() OVER (PARTITION BY pk ORDER BY title DESC NULLS LAST, year DESC NULLS LAST, kind DESC) = 1),
    c AS (SELECT item_id, kind, CASE WHEN year BETWEEN 1000 AND 2200 THEN year END AS year, {_WORDS.replace("{x}", "title")} AS norm FROM catalog_item
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY loaded_at DESC NULLS LAST, fetched_at DESC NULLS LAST, title DESC NULLS LAST) = 1),
    h AS (SELECT i.*, c.item_id, c.year, c.norm FROM i JOIN c ON i.kind = c.kind AND {_LONG.replace("{x}", "asked")} = {_LONG.replace("{x}", "norm")} WHERE i.asked <> '' AND c.norm <> '')"""

ORACLE = {
    "consolidate_dated": _fold_sql("FALSE", "SELECT query_id, NULL::INT AS year FROM r WHERE FALSE") + ", " + _ends(("title", "year", "medium", "season", "runtime", "artist")),
    "consolidate_local": _fold_sql("coalesce(abs(s.own_year - r.year) > 1, FALSE)", "SELECT query_id, year FROM (SELECT query_id, year, count(*) AS n FROM r WHERE year IS NOT NULL GROUP BY query_id, year) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, year DESC) = 1") + ", " + _ends(("year", "medium", "runtime")),
    "compare_signals": f"""
        WITH {_ANSWERS}
        SELECT r.query_id, r.match_id, coalesce(abs(s.year - r.year) > 1, FALSE) AS year_conflict, coalesce(s.medium <> r.medium, FALSE) AS medium_conflict, coalesce(s.season <> r.season, FALSE) AS season_conflict, coalesce(abs(s.runtime - r.runtime) > {_LIMIT.replace("{a}", "s.medium").replace("{b}", "r.medium")}, FALSE) AS runtime_conflict
        FROM r JOIN r s ON s.query_id = r.query_id AND s.rn = 1""",
    "graded_title_match": f"""
        WITH {_HITS}
        SELECT query_id, item_id, score FROM (SELECT query_id, item_id, CAST(CASE WHEN norm = asked AND abs(year - asked_year) <= 1 THEN 0.95 WHEN norm = asked THEN 0.85 WHEN contains(norm, asked) OR contains(asked, norm) THEN 0.60 ELSE 0.35 END AS DOUBLE) AS score FROM h)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) = 1""",
    "pick_by_year": f"""
        WITH {_HITS}
        SELECT query_id, item_id, step FROM (SELECT query_id, item_id, CAST(CASE WHEN year = asked_year THEN 0 WHEN abs(year - asked_year) = 1 THEN 1 ELSE 2 END AS INT) AS step FROM h)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step, item_id) = 1""",
    "year_filter_fallback": f"""
        WITH {_HITS}
        SELECT query_id, item_id FROM h WHERE coalesce(abs(year - asked_year) <= 1, FALSE) OR query_id NOT IN (SELECT query_id FROM h WHERE abs(year - asked_year) <= 1)""",
    "hint_match": f"""
        WITH {_ANSWERS}
        SELECT a.query_id, min(a.match_id) AS match_id FROM a JOIN (SELECT query_id, min(lower(country)) AS hint FROM a GROUP BY query_id) t ON t.query_id = a.query_id
        WHERE contains(lower(concat_ws(' ', a.country, a.language, a.provider)), t.hint) GROUP BY a.query_id""",
}
