"""Watching a folder, token buckets and caches with a time to live.

Each stateful job has a batch twin with the same semantics. The batch twins read each key's events in
order as a stream over sorted partitions and hold one key's state at a time, never its events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marquetry.session import Scratch
from marquetry.sources.store import Files


def fold_sorted(df: DataFrame, key: str, order: list[str], step: Callable, start: Callable, columns: str) -> DataFrame:
    """Run ``step(state, row) -> (state, output)`` over every key's rows in ``order``.

    Rows are partitioned by key and sorted; the state is carried from batch to batch and dropped with
    its key. ``columns`` (DDL) are appended to the row.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if k != current:
                    current, state = k, start()
                state, result = step(state, row)
                out.append(result)
            yield batch.assign(**{n: [o[i] for o in out] for i, n in enumerate(names)})

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, f"{schema}, {columns}")


def bucket_step(rate: float, burst: float) -> Callable:
    """One request against a bucket (tokens, last second): spends a token or says how long to wait."""

    def step(state, row):
        now = row.second
        tokens, last = state if state is not None else (burst, now)
        tokens = min(burst, tokens + max(0.0, now - last) * rate)
        if tokens >= 1.0:
            return (tokens - 1.0, now), (True, 0.0)
        return (tokens, now), (False, (1.0 - tokens) / rate)

    return step


def token_bucket(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """Events (user_id, event_id, second) with ``granted`` and ``wait_s`` under a bucket per user."""
    return fold_sorted(events, "user_id", ["second", "event_id"], bucket_step(rate, burst), lambda: None, "granted boolean, wait_s double")


FAILED = "batch bigint, file string, error string"


def ttl_cache(events: DataFrame, ttl: float) -> DataFrame:
    """Questions (user_id, event_id, second) with ``hit``: whether an answer stored within ``ttl`` exists.

    A miss stores an answer, a hit does not renew it.
    """

    def step(stored, row):
        hit = stored is not None and row.second - stored <= ttl
        return (stored if hit else row.second), (hit,)

    return fold_sorted(events, "user_id", ["second", "event_id"], step, lambda: None, "hit boolean")


def stream_token_bucket(stream: DataFrame, rate: float, burst: float) -> DataFrame:
    """``token_bucket`` on a stream with an event time ``ts``: a bucket is keyed state.

    It expires once the watermark (ten minutes behind) shows that it has refilled, for a full bucket
    is no different from a fresh one.
    """
    step = bucket_step(rate, burst)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["second", "event_id"])
        out = []
        for row in rows.itertuples(index=False):
            held, (granted, wait) = step(held, row)
            out.append((key[0], row.event_id, granted, wait))
        state.update(held)
        full = int((held[1] + burst / rate) * 1000)
        state.setTimeoutTimestamp(max(full, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "granted", "wait_s"])

    return stream.withWatermark("ts", "10 minutes").groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint, granted boolean, wait_s double", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def watch(spark: SparkSession, folder: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, pattern: str = "*.parquet", attempts: int = 3):
    """Handle each new parquet file under ``folder`` that fits ``pattern``.

    A cycle that fails is tried again, ``attempts`` times in all; then it is recorded under ``checkpoint``
    (``failed_files`` lists its files) and the watch goes on, so that one bad file never stops it and no
    file is forgotten. ``handle`` may see a batch again and should write by its number.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        for attempt in range(attempts):
            try:
                return handle(batch, number)
            except Exception as failure:
                if attempt + 1 == attempts:
                    error = f"{type(failure).__name__}: {failure}"[:500]
                    try:  # a batch holds the few files that are new
                        names = [r[0] for r in batch.select(F.input_file_name()).distinct().collect()]
                    except Exception:  # a file that can't even be read; the batch's number tells the log which
                        names = [None]
                    spark.createDataFrame([(number, f, error) for f in names], FAILED).coalesce(1).write.mode("append").json(f"{checkpoint}-failed")

    writer = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def failed_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(batch, file, error) of the cycles that a watch gave up; read these files again with a fresh checkpoint."""
    files = Files(spark)
    where = f"{checkpoint}-failed"
    return spark.read.schema(FAILED).json(where) if files.system(where).exists(files.path(where)) else spark.createDataFrame([], FAILED)


def watched_counts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows per event type of a table read through a watch, in incremental batches."""
    scratch = Scratch(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    out = f"{scratch.root}/out"

    def handle(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    source, pattern = (folder, f"{name}.parquet") if single else (f"{folder}/{name}.parquet", "*.parquet")
    watch(spark, source, schema, handle, f"{scratch.root}/checkpoint", pattern=pattern).awaitTermination()
    if lost := failed_files(spark, f"{scratch.root}/checkpoint").first():
        raise RuntimeError(f"{lost.file} could not be read: {lost.error}")
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.max("last").alias("last_ts"))
