"""The endpoint catalogue: load, combine, extend, report.

A catalogue table has ``seq`` (file order) and the four text columns
``referenceid, endpoint, resolverid, displaycolor``. Which of several rows wins is
decided by ``seq`` alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from wikiloom.functions.text import colour_number, derived_colour
from wikiloom.functions.urls import DISABLED
from wikiloom.schemas import CATALOG_COLUMNS
from wikiloom.session import staged

# Fixed value: the mark for a colour to be generated.
RANDOM_COLOUR = "!random"


def _blank_filled(catalog: DataFrame) -> DataFrame:
    """The CSV reader gives NULL for blank fields; blanks are empty text here."""
    return catalog.select(
        "seq", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in CATALOG_COLUMNS]
    )


def load(catalog: DataFrame, mode: str = "default") -> DataFrame:
    """Endpoints that a catalogue enables.

    Disabled rows are dropped. Of several rows with one ``referenceid`` the first is
    kept; ``mode="reference"`` drops only the second one and keeps the later ones.
    """
    enabled = _blank_filled(catalog).filter(F.col("referenceid") != DISABLED)
    by_order = Window.partitionBy("referenceid").orderBy("seq")
    # Rank filters of this form cut each group before the shuffle, so a referenceid
    # that holds much of the table sends at most two rows per task.
    if mode == "reference":
        second = (
            enabled.select("referenceid", "seq")
            .withColumn("rank", F.row_number().over(by_order))
            .filter("rank = 2")
            .select("seq")
        )
        kept = enabled.join(second, "seq", "left_anti")
    else:
        kept = (
            enabled.withColumn("rank", F.row_number().over(by_order))
            .filter("rank = 1")
            .drop("rank")
        )
    literal = F.when(
        F.col("displaycolor") != RANDOM_COLOUR, colour_number(F.col("displaycolor"))
    )
    source = (
        F.when(F.col("displaycolor") == RANDOM_COLOUR, "random")
        .when(literal.isNull(), "undecodable")
        .otherwise("literal")
    )
    return kept.select(
        "seq",
        "referenceid",
        "endpoint",
        "resolverid",
        F.coalesce(literal, derived_colour(F.col("referenceid"))).alias("color"),
        source.alias("color_source"),
    )


def combine(catalogs: Sequence[DataFrame]) -> DataFrame:
    """Several catalogues as one, in the given order; ``priority`` is the file's place."""
    marked = [c.withColumn("priority", F.lit(i)) for i, c in enumerate(catalogs)]
    return reduce(DataFrame.unionByName, marked)


def load_combined(catalogs: Sequence[DataFrame], mode: str = "default") -> DataFrame:
    """Endpoints enabled by several catalogues taken as one file.

    The two order columns are packed as a struct, which sorts as they do.
    """
    packed = combine(catalogs).withColumn("seq", F.struct("priority", "seq"))
    return load(packed, mode).select(
        F.col("seq.priority").alias("priority"),
        F.col("seq.seq").alias("seq"),
        "referenceid",
        "endpoint",
        "resolverid",
        "color",
        "color_source",
    )


def unknown_endpoints(new: DataFrame, catalog: DataFrame, distinct: bool = False) -> DataFrame:
    """New rows whose exact URL is in no catalogue row, disabled rows included.

    The new rows stay a bag; ``distinct=True`` keeps the first of each URL.
    """
    known = catalog.select(F.coalesce("endpoint", F.lit("")).alias("endpoint")).distinct()
    fresh = new.join(staged(known, "known"), "endpoint", "left_anti").select(*new.columns)
    if distinct:
        order = [c for c in ("source", "seq", "pos") if c in new.columns]
        first = Window.partitionBy("endpoint").orderBy(*order)
        fresh = (
            fresh.withColumn("rank", F.row_number().over(first)).filter("rank = 1").drop("rank")
        )
    return fresh


# Order of an extended catalogue: old rows, then new ones by where they were found.
EXTENDED_ORDER = ["part", "source", "seq", "pos"]


def extend(catalog: DataFrame, new: DataFrame, distinct: bool = False) -> DataFrame:
    """The catalogue followed by the new endpoints it lacks.

    ``new`` has ``referenceid, endpoint, resolverid, color`` and its order ``source,
    seq, pos`` (``source`` and ``pos`` may be left out); a NULL colour is written as the
    random mark, others as ``#rrggbb``.
    """
    nowhere = {"source": F.lit(""), "pos": F.lit(0)}
    text = F.coalesce(
        F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("color").cast("long"))), 6, "0")),
        F.lit(RANDOM_COLOUR),
    )
    added = (
        unknown_endpoints(new, catalog, distinct)
        .withColumns({k: v for k, v in nowhere.items() if k not in new.columns})
        .withColumns({"part": F.lit(1), "displaycolor": text})
    )
    old = _blank_filled(catalog).withColumns({**nowhere, "part": F.lit(0)})
    columns = [*EXTENDED_ORDER, *CATALOG_COLUMNS]
    return old.select(*columns).unionByName(added.select(*columns))


def load_report(catalog: DataFrame, mode: str = "default") -> DataFrame:
    """Rows loaded, and how many ids occur more than once; disabled rows not counted."""
    per_id = (
        _blank_filled(catalog)
        .filter(F.col("referenceid") != DISABLED)
        .groupBy("referenceid")
        .agg(F.count("*").alias("n"))
    )
    kept = F.lit(1) if mode == "default" else F.when(F.col("n") == 1, 1).otherwise(F.col("n") - 1)
    return per_id.agg(
        F.coalesce(F.sum(kept), F.lit(0)).cast("long").alias("loaded"),
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
    )


def export_report(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """How many rows the catalogue had and how many ``extend`` adds, in one row."""
    return (
        extend(catalog, new)
        .agg(
            F.count_if(F.col("part") == 0).alias("previous_rows"),
            F.count_if(F.col("part") == 1).alias("new_rows"),
        )
    )
