"""Identifier clusters of a mapping store: entries of a role that share an identifier, transitively.

The reference merges an entry into the first overlapping one only; here a cluster is everything linked
directly or through others. Labels spread by minima over (entry, identifier) memberships and shortcut
through their own labels, so that chains shorten geometrically; lineage is cut every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.session import Scratch


def mapping_clusters(members: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Rows (role, entry, cluster) of ``members`` (role, entry, identifier): the least entry of each cluster.

    Null entries and identifiers link nothing and are dropped; repeated rows do no harm. An entry
    whose identifiers nobody shares is a cluster of its own. Both steps of a round are pre-aggregated
    minima, so an identifier of very many entries fills no task.
    """
    scratch = Scratch(members.sparkSession)
    rows = scratch.keep(members.select("role", "entry", "identifier").where("entry is not null and identifier is not null").distinct())
    labels = scratch.keep(rows.select("role", "entry").distinct().withColumn("label", F.col("entry")))
    for _ in range(max_rounds):
        least = rows.join(labels, ["role", "entry"]).groupBy("role", "identifier").agg(F.min("label").alias("label"))
        nearer = rows.join(least, ["role", "identifier"]).groupBy("role", "entry").agg(F.min("label").alias("label"))
        through = labels.select("role", F.col("entry").alias("label"), F.col("label").alias("next"))
        fresh = nearer.join(through, ["role", "label"], "left").select("role", "entry", F.least("label", F.coalesce("next", "label")).alias("label"))
        fresh = scratch.keep(fresh)
        changed = fresh.join(labels.withColumnRenamed("label", "was"), ["role", "entry"]).where("label <> was").limit(1).count()
        scratch.drop(labels)
        labels = fresh
        if not changed:
            return labels.select("role", "entry", F.col("label").alias("cluster"))
    raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
