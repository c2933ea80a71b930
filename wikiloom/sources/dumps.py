"""Project dumps as files.

Each file of a folder is one project's dump, a CSV whose first record names its columns; columns
differ between files. Spark's reader cuts records and fields, so a dump never is one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wikiloom.operators.harvest import MISSING_SOURCE, named_fields


def _width(spark: SparkSession, folder: str) -> int:
    """At least the number of columns of the widest header."""
    lines = spark.read.text(folder)
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    return (lines.agg(F.max(commas)).first()[0] or 0) + 1


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """``source, seq, values``: a source is named like its file without what follows the first dot."""
    width = _width(spark, folder)
    names = [f"c{i}" for i in range(width)]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(folder, header=False, multiLine=True, escape='"')
    # A file is one split, and its records have rising numbers without gaps.
    return rows.select(
        F.substring_index("_metadata.file_name", ".", 1).alias("source"), F.monotonically_increasing_id().alias("seq"),
        F.array(*[F.coalesce(n, F.lit("")) for n in names]).alias("values"),
    )


def _headers(records: DataFrame) -> DataFrame:
    first = records.groupBy("source").agg(F.min(F.struct("seq", "values")).alias("first"))
    return first.select("source", F.col("first.seq").alias("start"), F.col("first.values").alias("columns"))


def _is_missing() -> Column:
    return F.contains(F.get("columns", F.lit(0)), F.lit(MISSING_SOURCE))


def read_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """``source, line_no`` and the columns in use of all dumps in a folder, as ``harvest.dump_rows`` has them."""
    records = _records(spark, folder)
    rows = records.join(_headers(records).filter(~_is_missing()), "source").filter(F.col("seq") > F.col("start"))
    numbered = rows.withColumn("line_no", (F.col("seq") - F.col("start") - 1).cast("int"))
    return named_fields(numbered, ["source", "line_no"])


def missing_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose dump says that they do not exist."""
    return _headers(_records(spark, folder)).filter(_is_missing()).select("source")
