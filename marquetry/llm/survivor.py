"""Problem 5: the best representative of a duplicate group, by iterative truth discovery.

Sources claim values for the fields of an object. In turn, every value gets the summed reliability
of the sources that claim it, and every source the share of its claims that the leading values
support, until reliabilities settle. The value with the highest support survives. A caller may rank
claims (``priority``): a higher rank then decides first and support decides among equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.session import Scratch

#: Reliability that every source starts from, and the range it stays in.
START, LOW, HIGH = 0.8, 0.05, 0.95
#: Rounds after which reliabilities move half the way.
DAMPED = 10
#: Sources held beside every task; more than that go through a shuffle join.
BROADCAST_SOURCES = 10_000


def discover(claims: DataFrame, tolerance: float = 0.005, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """(winners, reliabilities) of ``claims`` (object, field, source, value, priority, ref).

    ``winners`` has one row per object and field: value, support, priority and ref (the largest ref
    among the claims of highest priority for that value; a struct may rank them). Null values are no
    claims. Ties in priority and support go to the larger ref. An empty input gives no rows.
    ``priority`` may be any orderable type, nulls lowest. Each step is a pre-aggregated groupBy, so
    an object or source that holds a third of the claims fills no task. Rounds go on until no
    reliability moves by ``tolerance``; after DAMPED of them a source moves half the way only, which ends
    a swing between two states. Raises when ``max_rounds`` do not suffice.
    """
    scratch = Scratch(claims.sparkSession)
    rows = scratch.keep(claims.select("object", "field", "source", "value", "priority", "ref").where("value is not null"))
    trust, seen = scratch.measured(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("reliability", F.lit(START)), sources=F.count(F.lit(1)))
    sources = seen["sources"]

    def beside(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if sources <= BROADCAST_SOURCES else t

    def vote(t: DataFrame) -> DataFrame:
        """Support of every value, from the sources' log odds."""
        weighed = rows.join(beside(t.select("source", "reliability")), "source")
        odds = F.log(F.col("reliability") / (1 - F.col("reliability")))
        return weighed.groupBy("object", "field", "value").agg(F.max("priority").alias("priority"), F.round(F.sum(odds), 6).alias("support"), F.max(F.struct("priority", "ref")).alias("top"))

    def lead(votes: DataFrame) -> DataFrame:
        best = votes.groupBy("object", "field").agg(F.max(F.struct("priority", "support", F.col("top.ref").alias("ref"), "value")).alias("b"))
        return best.select("object", "field", "b.value", "b.support", "b.priority", "b.ref")

    for number in range(max_rounds):
        leading = lead(vote(trust)).select("object", "field", F.col("value").alias("truth"))
        # a claim is right when its value leads: votes per (object, field, value, source) need no join back
        judged = rows.select("object", "field", "source", "value").join(leading, ["object", "field"])
        fresh = judged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") == F.col("truth")).cast("double")).alias("r"))
        fresh = fresh.join(beside(trust.select("source", F.col("reliability").alias("was"))), "source")
        to = F.least(F.greatest("r", F.lit(LOW)), F.lit(HIGH))
        fresh, seen = scratch.measured(fresh.select("source", "n", "was", (to if number < DAMPED else (to + F.col("was")) / 2).alias("reliability")), moved=F.max(F.abs(F.col("reliability") - F.col("was"))))
        scratch.drop(trust)
        trust = fresh.drop("was")
        trust._scratch_path = fresh._scratch_path  # type: ignore[attr-defined]
        if seen["moved"] is None or seen["moved"] < tolerance:
            return lead(vote(trust)), trust
    raise RuntimeError(f"reliabilities did not settle in {max_rounds} rounds")


# Words and signs that stand for "no value" (compared in lower case, trimmed).
NO_VALUE = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "tba", "tbd", "und", "undefined", "unknown", "xx", "xxx", "zz", "...", "not available", "not applicable")
#: Years and runtimes (seconds) outside these cannot be.
YEARS, MAX_RUNTIME = (1000, 2100), 10_000_000.0


def real_text(c: Column) -> Column:
    """The trimmed text where it is a value, null where it stands for none."""
    trimmed = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    return F.when(~F.lower(trimmed).isin(*NO_VALUE), trimmed)


def real_year(c: Column) -> Column:
    return F.when(c.between(*YEARS), c.cast("string"))


def real_runtime(c: Column) -> Column:
    return F.when(~F.isnan(c) & (c > 0) & (c < MAX_RUNTIME), c.cast("string"))


FIELDS = {"title": real_text, "artist": real_text, "year": real_year, "runtime": real_runtime, "medium": real_text, "language": real_text, "country": real_text}


def match_claims(matches: DataFrame, providers: DataFrame) -> DataFrame:
    """Claims of provider_match: accepted rows, of each provider the latest, of queries with two match_id.

    A provider is the same in any case and with outer blanks; one that ``providers`` doesn't list
    ranks after all others. A null fetched_at is the earliest, a null or NaN confidence the lowest.
    Priority is (confidence, earlier registration, smaller match_id).
    """
    name = F.lower(F.regexp_replace("provider", r"^\s+|\s+$", ""))
    seq = providers.groupBy(name.alias("source")).agg(F.min("seq").alias("seq"))
    conf = F.when(F.isnan("confidence"), None).otherwise(F.col("confidence"))
    rows = matches.where(F.col("accepted")).select("query_id", "match_id", name.alias("source"), conf.alias("conf"), "fetched_at", *[real(F.col(f"signals.{f}")).alias(f) for f, real in FIELDS.items()])
    best = [F.max(F.struct("fetched_at", F.col(f).isNotNull().alias("real"), "conf", (-F.col("match_id")).alias("ref"), F.col(f).alias("value"))).alias(f) for f in FIELDS]
    latest = rows.groupBy("query_id", "source").agg(F.max(F.struct("fetched_at")).alias("last"), F.min("match_id").alias("lo"), F.max("match_id").alias("hi"), *best)
    several = latest.groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("query_id")
    latest = latest.join(several, "query_id", "left_semi").join(seq, "source", "left")
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("c")) for f in FIELDS])).alias("e")
    long = latest.select("query_id", "source", "seq", "last", entries)
    # the best row per field is of the latest fetch: structs compare by fetched_at first
    long = long.where(F.col("e.c.real") & F.col("e.c.fetched_at").eqNullSafe(F.col("last.fetched_at")))
    order = F.struct(F.col("e.c.conf").alias("conf"), (-F.coalesce("seq", F.lit(1_000_000))).alias("seq"))
    return long.select(F.col("query_id").alias("object"), F.col("e.field").alias("field"), "source", F.col("e.c.value").alias("value"), order.alias("priority"), F.col("e.c.ref").alias("ref"))
