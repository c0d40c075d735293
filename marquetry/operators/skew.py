"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows: at most HOT_SHARE keys can be.
HOT_SHARE = 2000
#: Rows of one key that a task bears beside others.
TASK_ROWS = 100_000


def hot_split_join(many: DataFrame, one: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", largest: int | None = None) -> DataFrame:
    """Join ``many`` to ``one`` (one row a key) without sending a hot key to one task.

    ``one`` holds in column ``weight`` how many rows of ``many`` its key has, and ``total`` is their
    sum, so at most HOT_SHARE keys exceed ``total / HOT_SHARE``. Those few rows are broadcast (the
    bound is HOT_SHARE rows whatever the data); all other keys go through a shuffle join. The rows of
    hot keys leave the shuffled side before it is shuffled. Keys must not be null in ``one``; rows of
    ``many`` with a null key match nothing and are dropped (inner) or kept without match (left).
    Callers that know the ``largest`` weight say so: a key of no more than TASK_ROWS rows fills no task,
    and without larger ones the join is a plain one, with the same rows.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if largest is not None and largest <= TASK_ROWS:
        return many.join(one, keys, how)
    limit = max(1, total // HOT_SHARE)
    hot = one.where(F.col(weight) > limit)
    rest = one.where(F.col(weight) <= limit)
    with_hot = many.join(F.broadcast(hot), keys, "inner")
    others = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return with_hot.unionByName(others.join(rest.hint("shuffle_merge"), keys, how))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str, scratch) -> DataFrame:
    """``df`` with the 1-based place of every row among those of its ``keys``, by ``order``, in column ``name``.

    A window over a few keys sorts each key's rows in one task. Here rows are cut into ranges of (keys,
    order), numbered within their range, and moved on by the rows of the ranges before: a range holds
    about a partition's share of the rows however few keys there are. ``order`` should tell rows apart;
    rows that tie take their places in any order, on the same side of a range's edge.
    """
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*[F.col(k) for k in keys], *order)
    held = scratch.keep(spread.withColumn("__range", F.spark_partition_id()))
    inside = held.withColumn("__place", F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order)))
    sizes = held.groupBy("__range", *keys).agg(F.count(F.lit(1)).alias("__n"))  # a row for each key and range it touches
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select("__range", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], before.alias("__before"))
    match = [F.col("l.__range") == F.col("r.__range"), *[F.col(f"l.{k}").eqNullSafe(F.col(f"r.__k{i}")) for i, k in enumerate(keys)]]
    both = inside.alias("l").join(moved.alias("r"), match)
    return both.select(*[f"l.{c}" for c in df.columns], (F.col("__place") + F.col("__before")).alias(name))
