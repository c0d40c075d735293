"""Per-key aggregates by a tree of partial states.

A plain ``groupBy(key)`` hands one reducer a partial state of every input chunk for each hot key:
with a million chunks, a million states of one key. Here the input is cut into chunks of a fixed number
of rows; each is combined where it is read (map-side), and the states climb in rounds. A round groups
by (key, part of the chunk's number), each part standing for ``fan_in`` of the round before, so no
reducer merges more than about ``fan_in`` states of a key, and ``log(chunks, fan_in)`` rounds, two at
least, end with one state a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a state is begun from rows, and how two states are merged.
_BEGIN = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


#: Rows of a chunk, and bytes that its rows take at least (for an estimate of the number of chunks).
CHUNK_ROWS, CHUNK_BYTES = 65_536, 65_536
#: Rounds at most, where the optimizer knows no size: enough for fan_in**6 chunks.
MOST_ROUNDS = 6


def rounds(chunks: int, fan_in: int) -> int:
    """Rounds that bring ``chunks`` states of a key down to one."""
    n, reach = 1, fan_in
    while reach < chunks:
        n, reach = n + 1, reach * fan_in
    return n


def estimated_chunks(df: DataFrame) -> int:
    """Chunks of ``df`` by the optimizer's estimate of its size, for which no job runs."""
    return max(1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // CHUNK_BYTES)


def tree_aggregate(df: DataFrame, keys: list[str], states: dict[str, tuple[str, Column | str]], fan_in: int = 64) -> DataFrame:
    """One row per distinct ``keys`` with the named ``states``, e.g. ``{"n": ("count", "*")}``.

    Kinds are count, sum, min and max. A null key is a key like any other (one row of nulls); an
    empty input gives no rows; repeated rows count as often as they stand; columns of ``df`` that are
    neither keys nor aggregated are never read, whatever their names.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    clash = set(keys) & set(states)
    if clash:
        raise ValueError(f"state names clash with keys: {sorted(clash)}")
    picked = df.select(*[F.col(k) for k in keys], *[(F.lit(1) if col == "*" else F.col(col) if isinstance(col, str) else col).alias(f"__in_{name}") for name, (_, col) in states.items()])
    depth = min(max(2, rounds(estimated_chunks(picked), fan_in)), MOST_ROUNDS)
    row = F.monotonically_increasing_id()  # partition and row within it
    level = picked.withColumn("__chunk", F.pmod(F.xxhash64((row / F.lit(CHUNK_ROWS)).cast("bigint")), F.lit(fan_in ** (depth - 1))))
    aggs = [_BEGIN[kind](F.col(f"__in_{name}")).alias(name) for name, (kind, _) in states.items()]
    merges = [_MERGE[kind](F.col(name)).alias(name) for name, (kind, _) in states.items()]
    for r in reversed(range(depth)):
        group = [*keys, F.pmod("__chunk", F.lit(fan_in**r)).alias("__chunk")] if r else keys
        level = level.groupBy(*group).agg(*(aggs if r == depth - 1 else merges))
    return level
