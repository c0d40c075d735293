"""Candidate pairs from blocking keys, large blocks in tiles; a caller may have them refined by other fields first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.operators.skew import hot_split_join
from marquetry.session import Scratch

#: A block of up to this many rows gives all its pairs in one row; a larger one does so in tiles, or is refined first.
BLOCK_ROWS = 48
#: Rows of one side of a tile, in which all pairs of a large block are made.
TILE_ROWS = 1000

_PAIRS = "explode(flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(least(x, y) AS a, greatest(x, y) AS b))))) AS p"


def _small_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks known to hold BLOCK_ROWS rows at most."""
    return blocks.groupBy("key").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").selectExpr(_PAIRS).select("p.a", "p.b")


def _counted(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """``keys`` beside the rows ``n`` of their key; keys of one row leave."""
    counts, seen = scratch.measured(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), total=F.sum("n"), largest=F.max("n"))
    return scratch.keep(hot_split_join(keys, counts, ["key"], "n", seen["total"] or 1, largest=seen["largest"] or 0))


def _tiled(blocks: DataFrame, apart: Callable[[Column, Column], Column] | None) -> DataFrame:
    """All pairs of blocks (id, key, n, twin, fact, same) of any size, of which no task holds a whole one.

    A block is cut into groups of TILE_ROWS rows and every two groups meet in a tile of their own. With
    ``same`` unset, pairs of one twin leave; pairs that ``apart`` tells from their facts always do.
    """
    groups = F.ceil(F.col("n") / TILE_ROWS).cast("int")
    rows = blocks.withColumn("g", groups).withColumn("s", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    left = rows.select("key", "same", F.col("s").alias("p"), F.explode(F.sequence("s", F.col("g") - 1)).alias("q"), F.col("id").alias("i"), F.col("twin").alias("ti"), F.col("fact").alias("fi"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), "s")).alias("p"), F.col("s").alias("q"), F.col("id").alias("j"), F.col("twin").alias("tj"), F.col("fact").alias("fj"))
    met = left.join(right.hint("shuffle_merge"), ["key", "p", "q"]).where("(p < q or i < j) and (same or ti <> tj)")
    if apart:
        met = met.where(~apart(F.col("fi"), F.col("fj")))
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def _whole(alike: DataFrame, facts: DataFrame, apart: Callable[[Column, Column], Column] | None, scratch: Scratch) -> DataFrame:
    """All pairs of the blocks ``alike`` (id, key); what many blocks repeat is made once.

    Twins stand in the same blocks, so their pairs are made once a twin and not once a block. Of blocks
    with the same rows one is kept.
    """
    rows = scratch.keep(alike.select("id", "key").join(facts, "id"))
    shape = [F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.sum(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 31))).alias("y")]
    shapes = rows.groupBy("key").agg(*shape, (F.min("twin") < F.max("twin")).alias("mixed")).where("mixed")
    sizes = {"total": F.sum("n"), "largest": F.max("n")}
    mixed, seen = scratch.measured(shapes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), **sizes)
    twins = scratch.keep(rows.select("id", F.col("twin").alias("key"), "twin", "fact").distinct())
    counts, same = scratch.measured(twins.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), **sizes)
    columns = ["id", "key", "n", "twin", "fact"]
    across = hot_split_join(rows, mixed, ["key"], "n", seen["total"] or 1, largest=seen["largest"] or 0).select(*columns, F.lit(False).alias("same"))
    within = hot_split_join(twins, counts, ["key"], "n", same["total"] or 1, largest=same["largest"] or 0).select(*columns, F.lit(True).alias("same"))
    return _tiled(across, apart).unionByName(_tiled(within, apart))


def block_pairs(keys: DataFrame, facts: DataFrame, apart: Callable[[Column, Column], Column] | None = None, limit: int = BLOCK_ROWS) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids that share a blocking key.

    ``keys`` has id and key (bigint), each (id, key) once. A key of up to ``limit`` rows gives all its
    pairs at once and a larger one gives all of them in tiles: ``facts`` has id, twin (bigint, equal for
    rows whose texts are equal, so that they share keys) and fact, by which ``apart`` drops those
    pairs of large blocks that the caller would drop anyway (it is given the two facts, columns fi and fj).

    If ``keys`` has a column refs as well (array<bigint>, may be null or empty), a key of more than
    ``limit`` rows is refined before: its rows pair up only where they share one of their refs too, so
    refs are for callers to whom a pair without a common ref is no candidate.
    """
    scratch = Scratch(keys.sparkSession)
    keys = scratch.keep(keys)  # read three times, made once
    first = _counted(keys, scratch)
    pairs = _small_pairs(first.where(F.col("n") <= limit))
    alike = first.where(F.col("n") > limit)
    if "refs" in keys.columns:
        refined = alike.select("id", F.explode("refs").alias("r"), "key").select("id", F.xxhash64("key", "r").alias("key")).distinct()
        second = _counted(refined, scratch)
        pairs = pairs.unionByName(_small_pairs(second.where(F.col("n") <= limit)))
        alike = second.where(F.col("n") > limit)
    if alike.limit(1).count():
        pairs = pairs.unionByName(_whole(alike, facts, apart, scratch))
    return pairs.where("a <> b").distinct()


def keyed_pairs(asks: DataFrame, answers: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of a row of ``asks`` and one of ``answers`` (column, key) with equal keys, once a key.

    A key that many rows ask for and answer is cut into TILE_ROWS-sized groups on either side, which
    meet in tiles of their own, so that no pair is lost and no task holds a whole key.
    """
    asks, answers = scratch.keep(asks), scratch.keep(answers)
    left, right = (t.groupBy("key").agg(F.count(F.lit(1)).alias(n)) for t, n in ((asks, "x"), (answers, "y")))
    sizes = left.join(right, "key")
    cut = scratch.keep(sizes.where(F.greatest("x", "y") > TILE_ROWS).select("key", *[F.ceil(F.col(c) / TILE_ROWS).cast("int").alias(c) for c in "xy"]))
    met = asks.select("key", F.col(column).alias("i")).join(answers.select("key", F.col(column).alias("j")), "key")
    if cut.limit(1).count():
        met = asks.join(cut.select("key"), "key", "left_anti").select("key", F.col(column).alias("i")).join(answers.select("key", F.col(column).alias("j")), "key")
        spot = F.xxhash64(column, F.lit(7))
        p = asks.join(cut, "key").select("key", F.col(column).alias("i"), F.pmod(spot, "x").cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("q"))
        q = answers.join(cut, "key").select("key", F.col(column).alias("j"), F.explode(F.sequence(F.lit(0), F.col("x") - 1)).alias("p"), F.pmod(spot, "y").cast("int").alias("q"))
        met = met.select("i", "j").unionByName(p.join(q.hint("shuffle_merge"), ["key", "p", "q"]).select("i", "j"))
    return met.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
