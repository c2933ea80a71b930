"""Catalogue files: CSV in and out, and Parquet snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wikiloom.schemas import CATALOG_COLUMNS, CATALOG_CSV

_CSV = {"header": "true", "escape": '"', "multiLine": "true"}


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of catalogue files with their order; short rows carry ``_corrupt_record``.

    With ``multiLine`` each file is read whole by one task, so the generated id follows
    the order in the file; files count in the order of their names. Store the rows as a
    snapshot, which numbers them, before other jobs extend them.
    """
    rows = (
        spark.read.options(**_CSV, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
        .schema(CATALOG_CSV)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
        .withColumn("place", F.monotonically_increasing_id())
    )
    return rows.withColumn("seq", F.struct("file", "place")).drop("file", "place")


def well_formed_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("_corrupt_record").isNull()).select("seq", *CATALOG_COLUMNS)


def quarantined_rows(rows: DataFrame) -> DataFrame:
    """Short rows with what could be read of them."""
    return rows.filter(F.col("_corrupt_record").isNotNull()).select(
        "seq", *CATALOG_COLUMNS, "_corrupt_record"
    )


def write_csv(catalog: DataFrame, path: str, order: list[str]) -> None:
    """Catalogue as CSV part files whose names follow the order."""
    (
        catalog.orderBy(*order)
        .select(*CATALOG_COLUMNS)
        .write.options(header="true", escape='"', emptyValue="")
        .csv(path)
    )


def write_snapshot(catalog: DataFrame, root: str, order: list[str]) -> str:
    """A new numbered snapshot under ``root``, rows renumbered in order.

    Nothing is overwritten: readers go on with the snapshot before until the new one is
    complete.
    """
    spark = catalog.sparkSession
    number = max(_complete_snapshots(spark, root), default=-1) + 1
    path = f"{root.rstrip('/')}/snapshot-{number:012d}"
    (
        catalog.orderBy(*order)
        .select(F.monotonically_increasing_id().alias("seq"), *CATALOG_COLUMNS)
        .write.mode("overwrite")
        .parquet(path)
    )
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The latest complete snapshot under ``root``."""
    numbers = _complete_snapshots(spark, root)
    if not numbers:
        raise FileNotFoundError(f"no complete catalogue snapshot under {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/snapshot-{max(numbers):012d}")


def _complete_snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the snapshots whose writing finished."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/snapshot-*/_SUCCESS")
    files = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [
        int(status.getPath().getParent().getName().rsplit("-", 1)[1])
        for status in files.globStatus(marks) or []
    ]


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A project dump file by its own header; every column is text."""
    return spark.read.options(**_CSV).csv(path)
