"""Problem 7: connected components by alternating large-star and small-star edge rewrites.

(Kiveris et al., "Connected components in MapReduce and beyond", 2014.) Large-star links every
larger neighbour of a node to the node's minimum, small-star links the smaller ones and the node
itself; both are joins, and after a logarithmic number of rounds every node hangs on its component's
minimum. Stars are rewritten by a pre-aggregated minimum per node and a join that, when
there are hot nodes, broadcasts only those boundedly many, so a node with a third of all edges fills no task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.operators.skew import hot_split_join
from marquetry.session import Scratch


def _star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with the least of u and its neighbours as m; and the table to drop afterwards."""
    least, seen = scratch.measured(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")), total=F.sum("w"), largest=F.max("w"))
    return hot_split_join(edges, least, ["u"], "w", seen["total"] or 1, largest=seen["largest"] or 0).select("u", "v", F.least("u", "m").alias("m")), least


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) of every node that ``pairs`` links to another one.

    The component is the smallest node linked directly or indirectly. Pairs may repeat, stand in
    either order, hold nulls or link a node to itself (all without effect); no pairs give no rows.
    Nodes may be of any orderable type. Raises when ``max_rounds`` do not suffice. A round writes four
    tables; how many edges there are, their checksum and the hottest node are taken on the way.
    """
    scratch = Scratch(pairs.sparkSession)
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    shape = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, before = scratch.measured(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct(), **shape)
    for _ in range(max_rounds):
        if not before["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred, used = _star(both, scratch)
        large = scratch.keep(starred.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(used)
        scratch.drop(edges)
        # small-star: all edges point from the larger to the smaller node already
        starred, used = _star(large, scratch)
        linked = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(used.select("u", F.col("m").alias("v")))
        edges, now = scratch.measured(linked.distinct(), **shape)
        scratch.drop(used)
        scratch.drop(large)
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


# Fields of ext_id that name another work or a company, and values that name nothing.
FOREIGN_FIELDS = ("derived_from_imdb", "studio_id", "network_id")
PLACEHOLDERS = ("", "-", "--", "?", "0", "n/a", "na", "nan", "nil", "none", "null", "tba", "tbd", "tt0000000", "undefined", "unknown", "00000000-0000-0000-0000-000000000000")


def id_links(ext_id: DataFrame) -> DataFrame:
    """Edges (pk, least) of ext_id rows that share field and value: each pk to the smallest of its value.

    Values are compared in lower case without outer blanks and tabs. Null, empty and placeholder
    values, null fields and the foreign fields link nothing.
    """
    value = F.lower(F.regexp_replace("value", r"^[\s ]+|[\s ]+$", ""))
    rows = ext_id.select(F.regexp_replace("field", r"^\s+|\s+$", "").alias("field"), value.alias("value"), "pk").where(F.col("pk").isNotNull() & ~F.col("field").isin(*FOREIGN_FIELDS) & ~F.col("value").isin(*PLACEHOLDERS) & ~F.col("value").rlike(r"^[0\-]+$"))
    scratch = Scratch(ext_id.sparkSession)
    rows = scratch.keep(rows.distinct())
    least, seen = scratch.measured(rows.groupBy("field", "value").agg(F.min("pk").alias("least"), F.count(F.lit(1)).alias("w")).where("w > 1"), total=F.sum("w"), largest=F.max("w"))
    return hot_split_join(rows, least, ["field", "value"], "w", seen["total"] or 1, largest=seen["largest"] or 0).where("pk <> least").select("pk", "least")
