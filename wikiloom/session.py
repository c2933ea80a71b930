"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# What the jobs count on. Joins carry no broadcast hint: Spark broadcasts a side
# when its known size is under the threshold, and otherwise shuffles both sides and
# lets adaptive execution split the partitions of hot keys.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# For a join whose large side should lose most rows before it is shuffled, whatever Spark takes its size for.
RUNTIME_FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def build_session(name: str = "wikiloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may start in any folder.

    The archive is served by the driver, so its own folder for temporary files will do.
    """
    package = Path(__file__).resolve().parent
    if any(f.endswith(f"/{package.name}.zip") for f in spark.sparkContext.listFiles):
        return
    base = Path(tempfile.mkdtemp(prefix="run-")) / package.name
    spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))


def checkpoint_root(spark: SparkSession) -> str:
    """The folder shared by all executors, as the session names it.

    A local folder is made only where the session names none and all its tasks run in the
    driver, as in tests. On a cluster each machine would write to its own, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root and not context.getCheckpointDir():
        context.setCheckpointDir(root)
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        context.setCheckpointDir(root)
    return root


@contextlib.contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans that are made and run inside, then as before."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


# The folder that scratch tables of the current thread go to, where one is set.
_FOLDER: ContextVar[str | None] = ContextVar("scratch_folder", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, or in the scratch folder that is open."""
    folder = _FOLDER.get() or checkpoint_root(spark).rstrip("/")
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch_folder(spark: SparkSession, label: str, keep: bool = False) -> Iterator[str]:
    """Scratch tables made inside share a folder, which is deleted at the end unless ``keep`` is set.

    What is read from them must be stored elsewhere by then. With ``keep`` the caller deletes it, with ``delete``.
    """
    folder = scratch_path(spark, label)
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        if not keep:
            delete(spark, folder)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of scratch tables."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def claim(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if there is one already."""
    system, target = _file_system(spark, path)
    if system.exists(target):
        return False
    system.create(target, False).close()
    return True


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For a table that several branches of a plan read, and for the reduced side of a
    join. It is worked out once and survives lost executors. Its true size is known when
    the join is planned, so a large other side is not shuffled to find out. And if it is
    too large to be broadcast, both sides are shuffled for the join alone, which is
    what lets adaptive execution split hot keys: it leaves a join alone whose side comes
    straight from an aggregate on the join keys.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
