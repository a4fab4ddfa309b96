"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Settings of a session built here.  A session somebody else has built is left alone;
# these are the ones to choose there as well.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Beyond 8000 bytes the JVM does not compile a method any more.  Parsing a wide
    # row exceeds that, so let Spark split the expressions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Set to "true" where small tables are single files and many cores wait for them.
SPREAD = "spark.tidyledger.spread"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and measurements on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidyledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config(SPREAD, "true")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


LOCAL = re.compile(r"local(\[[^\]]*\])?")  # not local-cluster: its executors are processes


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="run-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate table of a run that has ended."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for a written intermediate table.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``.  Only where
    that is unset and driver and tasks are one process, as in tests, it lies in a
    temporary folder that goes with the session's process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# Shuffle files otherwise stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds within the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, purpose: str, row_group: int | None = None) -> DataFrame:
    """Write an intermediate table once and go on from it.

    For a result that several aggregates read: they scan only their columns, and
    a lost executor re-reads files instead of repeating the work before.  Rows with long
    binaries want row groups of few bytes (``row_group``): a reader holds up to 4096 rows of a group.
    """
    folder = shared_folder(df.sparkSession, purpose)
    options = {} if row_group is None else {"parquet.block.size": str(row_group)}
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.options(**options).parquet(folder)
    return df.sparkSession.read.parquet(folder)


def deliver(spark: SparkSession, staged: str, folder: str) -> None:
    """Let the files of a written table arrive in a folder; each appears there whole, and none is copied."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))
    if not system.exists(path(staged)):
        return  # no row for this arrival
    for entry in system.listStatus(path(staged)):
        name = entry.getPath().getName()
        if not name.startswith(("_", ".")) and not system.rename(entry.getPath(), path(f"{folder}/{uuid.uuid4().hex}-{name}")):
            raise RuntimeError(f"{entry.getPath()} did not arrive in {folder}")


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Let ``DataFrame.checkpoint`` write below the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoint"))
