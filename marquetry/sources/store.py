"""The built store on disk: published whole, opened only when whole.

A store is a folder of versions and a small text file that names the current one. A build writes a new
version beside the old and then replaces the file, which is one rename: readers see the old version or
the new, never a part, and a crash leaves the old one in place.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 1
POINTER = "CURRENT"
#: Tables of a store and the columns they are sorted by within files, so that statistics serve lookups.
TABLES = {"item": ("norm", "pk"), "ext_id": ("field", "value", "pk"), "alias": ("norm", "pk")}


@dataclass(frozen=True)
class Store:
    """An opened version: its tables, and what its build said about it."""

    folder: str
    dataset: str
    revision: str
    rows: int
    built_at: float
    item: DataFrame
    ext_id: DataFrame
    alias: DataFrame


class Files:
    """The few file operations a store needs, on whatever file system the folder is on."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def read(self, name: str) -> str | None:
        """Text of a small file; null when it isn't there."""
        fs, where = self.system(name), self.path(name)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a small file so that readers see the old text or the new."""
        aside = f"{name}.{uuid.uuid4().hex[:8]}"
        stream = self.system(name).create(self.path(aside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        overwrite = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        qualified = [self.system(name).makeQualified(self.path(x)) for x in (aside, name)]
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), self.conf).rename(*qualified, overwrite)

    def delete(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)


def publish(tables: dict[str, DataFrame], folder: str, dataset: str, revision: str, declared: int, skipped: int = 0) -> int:
    """Write a version of the store ``tables`` (item, ext_id, alias) and make it the current one.

    Returns the rows of item. They must be the ``declared`` rows less the ``skipped`` ones and more than
    none; otherwise the version is deleted, the current one stays and ValueError is raised.
    """
    spark = tables["item"].sparkSession
    files = Files(spark)
    version = f"v-{uuid.uuid4().hex[:12]}"
    for name, order in TABLES.items():
        tables[name].sortWithinPartitions(*order).write.parquet(f"{folder}/{version}/{name}")
    rows = spark.read.parquet(f"{folder}/{version}/item").count()
    if not rows or rows != declared - skipped:
        files.delete(f"{folder}/{version}")
        raise ValueError(f"{rows} items written, {declared} declared, {skipped} skipped")
    meta = {"schema": SCHEMA_VERSION, "version": version, "dataset": dataset, "revision": revision, "rows": rows, "built_at": time.time()}
    before = current(spark, folder)
    files.replace(f"{folder}/{POINTER}", json.dumps(meta))
    if before:
        files.delete(f"{folder}/{before['version']}")
    return rows


def current(spark: SparkSession, folder: str) -> dict | None:
    """What the pointer says, or null when it is absent or no JSON of this schema."""
    try:
        meta = json.loads(Files(spark).read(f"{folder}/{POINTER}") or "null")
        return meta if isinstance(meta, dict) and int(meta["schema"]) == SCHEMA_VERSION and meta["version"] else None
    except (ValueError, KeyError, TypeError):
        return None


def open_store(spark: SparkSession, folder: str) -> Store | None:
    """The current version; null when it is absent, damaged or of another schema version."""
    meta = current(spark, folder)
    if meta is None:
        return None
    try:
        tables = {name: spark.read.parquet(f"{folder}/{meta['version']}/{name}") for name in TABLES}
        if any(c not in tables[name].columns for name, order in TABLES.items() for c in order):
            return None
        return Store(folder, meta["dataset"], meta["revision"], int(meta["rows"]), float(meta["built_at"]), **tables)
    except (PySparkException, Py4JError, KeyError, ValueError, TypeError):
        return None
