"""Queries of the problems tagged llm, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.llm import components, leaks, names, pieces, skeleton, survivor, tokens, works
from marquetry.sources.tables import table

LOOK_ALIKE_TEXTS = (("item", "title"), ("item", "norm"), ("item_alias", "norm"))


def p2_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matching catalogue rows of different sources with their probability."""
    return works.matches(table(spark, folder, "catalog_item")).where(F.col("probability") >= works.MATCH)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of catalogue rows of different sources that describe one work."""
    return p2_matches(spark, folder).select("item_id_a", "item_id_b")


def p3_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every person row that is linked to another, with its entity (the smallest person_id)."""
    return names.entities(table(spark, folder, "person", "person_id", "name", "kind", "sort_name", "aliases", "birth_date", "country", "updated_at"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every two person rows that are the same person, group or company."""
    return names.entity_pairs(p3_entities(spark, folder))


def _look_alike_texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, name, "pk", column).select(F.lit(f"{name}.{column}").alias("field"), "pk", F.col(column).alias("text")) for name, column in LOOK_ALIKE_TEXTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of pk whose titles or norms read the same to the eye but differ in characters."""
    return skeleton.look_alikes(_look_alike_texts(spark, folder), "pk", "text", by="field")


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every title and norm in its consistent form."""
    return skeleton.with_skeletons(_look_alike_texts(spark, folder), "text", "form", composed=True)


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    matches = table(spark, folder, "provider_match", "match_id", "query_id", "provider", "confidence", "accepted", "signals", "fetched_at")
    return survivor.match_claims(matches, table(spark, folder, "provider", "provider", "seq"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Per query and field the match whose value survives."""
    winners, _ = survivor.discover(_claims(spark, folder))
    return winners.select(F.col("object").alias("query_id"), "field", (-F.col("ref")).alias("match_id"))


def p5_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Per query and field the value that the providers' reliabilities support most, all claims ranking alike."""
    winners, _ = survivor.discover(_claims(spark, folder).withColumn("priority", F.lit(0)))
    return winners.select(F.col("object").alias("query_id"), "field", "value", "support")


def p5_reliability(spark: SparkSession, folder: str) -> DataFrame:
    """The reliability that truth discovery gives every provider."""
    _, trust = survivor.discover(_claims(spark, folder).withColumn("priority", F.lit(0)))
    return trust.select(F.col("source").alias("provider"), F.col("n").alias("n_claims"), F.round("reliability", 6).alias("reliability"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every item linked to another through shared identifiers, with the smallest pk of its group."""
    links = components.id_links(table(spark, folder, "ext_id", "field", "value", "pk"))
    return components.components(links, "pk", "least").select(F.col("node").alias("pk"), F.col("component").alias("group_pk"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.token_ids(table(spark, folder, "documents", "doc_id", "text"))


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an evaluation item or a third of its words in a row, and how many words."""
    return leaks.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_item", "eval_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return p9_spans(spark, folder).select("doc_id", "eval_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of more than 1,024 tokens: those with a second piece.

    A token is a byte or more, so a text of 1,024 bytes or fewer has no second piece and is left out
    before the pieces are made.
    """
    long = table(spark, folder, "documents", "doc_id", "text").where(F.octet_length("text") > pieces.LIMIT)
    return pieces.split(long, with_text=False).where("piece_no = 1").select("doc_id")


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in pieces of at most 1,024 tokens with 64 tokens of overlap."""
    return pieces.split(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_matches, p3_found, p3_entities, p4_found, p4_forms, p5_found, p5_truth, p5_reliability, p7_found, p8_ids, p9_found, p9_spans, p10_found, p10_pieces)}

_NONE = ", ".join("'" + w + "'" for w in survivor.NO_VALUE)
_PLACE = ", ".join("'" + w + "'" for w in components.PLACEHOLDERS)
_BLANK = r"'^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'"


def _field_sql(field: str) -> str:
    if field == "year":
        real = f"signals.year BETWEEN {survivor.YEARS[0]} AND {survivor.YEARS[1]}"
    elif field == "runtime":
        real = f"NOT isnan(signals.runtime) AND signals.runtime > 0 AND signals.runtime < {survivor.MAX_RUNTIME}"
    else:
        real = f"lower(regexp_replace(signals.{field}, {_BLANK})) NOT IN ({_NONE})"
    return f"""SELECT query_id, '{field}' AS field, match_id, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS c, seq
        FROM latest WHERE signals.{field} IS NOT NULL AND {real}"""


ORACLE = {
    "p5_found": f"""
        WITH m AS (SELECT *, lower(regexp_replace(provider, '^\\s+|\\s+$', '', 'g')) AS p FROM (SELECT DISTINCT * FROM provider_match) WHERE accepted),
        several AS (SELECT query_id FROM m GROUP BY query_id HAVING count(DISTINCT match_id) > 1),
        latest AS (SELECT m.*, pr.seq FROM m JOIN several USING (query_id) LEFT JOIN provider pr ON pr.provider = m.p
            QUALIFY m.fetched_at IS NOT DISTINCT FROM max(m.fetched_at) OVER (PARTITION BY m.query_id, m.p)),
        f AS ({" UNION ALL ".join(_field_sql(f) for f in survivor.FIELDS)})
        SELECT query_id, field, match_id FROM f
        QUALIFY row_number() OVER (PARTITION BY query_id, field ORDER BY c DESC NULLS LAST, seq NULLS LAST, match_id) = 1""",
    "p7_found": f"""
        WITH RECURSIVE v AS (SELECT DISTINCT regexp_replace(field, '^\\s+|\\s+$', '', 'g') AS field, lower(regexp_replace(value, {_BLANK})) AS value, pk FROM ext_id),
        e AS (SELECT DISTINCT a.pk AS x, b.pk AS y FROM v a JOIN v b ON a.field = b.field AND a.value = b.value AND a.pk <> b.pk
            WHERE a.field NOT IN ('derived_from_imdb', 'studio_id', 'network_id') AND a.value NOT IN ({_PLACE}) AND NOT regexp_full_match(a.value, '[0-]+')),
        r AS (SELECT x AS pk, x AS g FROM e UNION SELECT e.y, r.g FROM r JOIN e ON e.x = r.pk WHERE r.g < e.y)
        SELECT pk, min(g) AS group_pk FROM (SELECT pk, g FROM r UNION ALL SELECT y, x FROM e WHERE x < y) GROUP BY pk""",
}
