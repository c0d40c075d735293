"""Sessions and the shared scratch folder.

Iterative operators cut their lineage by writing a parquet table into the folder that
``spark.checkpoint.dir`` names. On a cluster that folder is shared, so a lost executor loses no
state; only a session that names none (a local test) gets a folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("marquetry")
    settings = {
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        found = tempfile.mkdtemp(prefix="marquetry-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def rehashed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into as many partitions as the session shuffles, two a core at least.

    For aggregates whose result goes into Python: the number stands, where adaptive execution would
    merge small partitions into few tasks, and an aggregate by the same keys needs no further shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


class Scratch:
    """Tables that an operator writes between its steps.

    ``drop`` deletes one that nothing reads any more. What a result still reads stays until the session
    ends: lazily evaluated rows need it, and Spark gives no sign when they are done with. Roots are
    deleted when the driver exits.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/marquetry-{uuid.uuid4().hex[:12]}"
        self.count = 0
        atexit.register(self.close)

    def close(self) -> None:
        """Delete all tables of this scratch; harmless when the session is over already."""
        with contextlib.suppress(Exception):
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: the same rows without their lineage."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path  # type: ignore[attr-defined]
        return kept

    def measured(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict[str, object]]:
        """``keep``, and aggregates of the rows taken while they are written, without another job."""
        seen = Observation()
        kept = self.keep(df.observe(seen, *[c.alias(n) for n, c in figures.items()]))
        return kept, seen.get

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_marquetry_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="marquetry-ship-")) / "marquetry_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._marquetry_shipped = True  # type: ignore[attr-defined]


def shipped(query):
    """A registered query that sends the package before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run
