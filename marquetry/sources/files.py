"""Media files under a folder, rename journals, and the store's parquet sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.scalars import column
from marquetry.sources.store import Files

# File extensions by kind.
VIDEO = ("mkv", "mp4", "avi", "webm", "mov", "m4v", "ts")
AUDIO = ("mp3", "flac", "m4a", "ogg", "opus", "wav", "aac")


def scan_media_files(spark: SparkSession, root: str, skip_extras: bool = True) -> DataFrame:
    """(path, kind, extra) of the media files under ``root``; only names are read, no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = files.withColumn("kind", F.when(ext.isin(*VIDEO), "video").when(ext.isin(*AUDIO), "music")).where("kind is not null")
    kinds = kinds.withColumn("extra", column("is_extra_path", x="path"))
    return kinds.where("not extra") if skip_extras else kinds


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines journal; lines that do not parse are skipped, and an absent journal is empty."""
    if not Files(spark).system(path).exists(Files(spark).path(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_journal(records: DataFrame, path: str) -> int:
    """Replace a journal by ``records``, or remove it when none are left; returns how many there are."""
    files = Files(records.sparkSession)
    staging = f"{path}.staging-{uuid.uuid4().hex[:8]}"
    records.write.json(staging)
    count = records.sparkSession.read.schema(records.schema).json(staging).count()
    _swap(files, staging if count else None, path)
    if not count:
        files.delete(staging)
    return count


def _swap(files: Files, new: str | None, path: str) -> None:
    """Put ``new`` in the place of ``path``; what was there is kept aside until ``new`` stands."""
    fs, dst, aside = files.system(path), files.path(path), files.path(f"{path}.old-{uuid.uuid4().hex[:8]}")
    held = fs.exists(dst) and fs.rename(dst, aside)
    if new and not fs.rename(files.path(new), dst):
        if held:
            fs.rename(aside, dst)
        raise OSError(f"{new} could not be moved to {path}")
    if held:
        fs.delete(aside, True)


def write_store(df: DataFrame, path: str, declared: int, sort: list[str]) -> int:
    """Write a store table in the place of ``path``; returns the rows written.

    The table goes to a staging folder beside ``path``, sorted by ``sort`` within files (row-group
    statistics then serve lookups), and is counted against ``declared``. An empty set or a count that
    differs is refused and leaves ``path`` as it was. The old table is moved aside, not deleted, before
    the new one is renamed into place, so a crash loses neither; ``sources.store`` publishes without even
    that moment, behind a pointer.
    """
    spark = df.sparkSession
    files = Files(spark)
    staging = f"{path}.staging-{uuid.uuid4().hex[:8]}"
    df.sortWithinPartitions(*sort).write.parquet(staging)
    written = spark.read.parquet(staging).count()
    if not written or written != declared:
        files.delete(staging)
        raise ValueError(f"{written} rows written, {declared} declared")
    _swap(files, staging, path)
    return written
