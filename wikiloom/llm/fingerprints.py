"""Document fingerprints by winnowing.

Rolling hashes of all runs of ``K`` characters; of each ``WINDOW`` such hashes in a row the least
is kept, the rightmost of equal ones, with its position. So two texts that share
``WINDOW + K - 1`` characters in a row share a kept hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wikiloom.llm.common import U64, Rolling, arrow_map, fields, shuffle_partitions, window_min

K = 16
WINDOW = 50

#: Ranges of ids at most; more rows make longer ranges, which are sorted with spilling.
RANGES = 2048

_PLACE = U64(0xFFFFFFFF)


def winnow(text: str, rolling: Rolling, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (32 bits) and their positions.

    A text shorter than ``k`` has one hash of its whole; one of fewer than ``window`` runs has their
    least; an empty one has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
    hashes = rolling.grams(codes, min(k, len(codes)))
    # The position counts down in the low half, so of equal hashes the rightmost is least.
    packed = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype=U64))
    least = window_min(packed, min(window, len(hashes)))
    keep = np.ones(len(least), dtype=bool)
    keep[1:] = least[1:] != least[:-1]
    least = least[keep]
    return (least >> U64(32)).astype(np.uint32), (_PLACE - (least & _PLACE)).astype(np.uint32)


def as_text(hashes: np.ndarray, places: np.ndarray) -> str:
    """Hash and position of each kept run, eight hexadecimal digits each."""
    pairs = np.empty((len(hashes), 2), dtype=">u4")
    pairs[:, 0], pairs[:, 1] = hashes, places
    return pairs.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of the distinct kept hashes; 1 for two empty texts."""
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - shared
    return shared / union if union else 1.0


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``fingerprint``, replacing a column of this name; NULL texts are empty."""
    kept = docs.drop("fingerprint")
    place = kept.columns.index(text)
    schema = fields(kept.schema, "fingerprint string")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            marks = [as_text(*winnow(t or "", rolling, k, window)) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], names=schema.names)

    return arrow_map(kept, mark, schema)


# -- the document and an edited copy of it --------------------------------------------


def _ranges(docs: DataFrame, id: str, text: str, ranges: int) -> DataFrame:
    """Documents by ranges of ids, each range closed by the first document of the next one.

    Columns ``id, text, part, own``; ``own`` is false for the closing document. Ids are split at
    quantiles, so a range is a bounded share of the rows however many there are; all that
    goes to the driver is one id per range.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = rows.filter("id IS NOT NULL").approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(cuts, dtype=np.float64)).astype(np.int64)

    @F.pandas_udf(T.IntegerType())
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    # NULL ids come before all others.
    part = F.when(F.col("id").isNull(), -1).otherwise(part_of(F.coalesce("id", F.lit(0))))
    parts = rows.select("id", part.alias("part")).groupBy("part").agg(F.min("id").alias("id"))
    firsts = sorted(((r["part"], r["id"]) for r in parts.collect()), key=lambda r: r[0])
    if not firsts:
        return rows.select("id", "text", F.lit(0).alias("part"), F.lit(True).alias("own"))
    placed = rows.withColumn("part", part).withColumn("own", F.lit(True))
    closing = rows.sparkSession.createDataFrame(
        [(firsts[(i + 1) % len(firsts)][1], part) for i, (part, _) in enumerate(firsts)],
        fields(T.StructField("first", docs.schema[id].dataType), "part int"),
    )
    ends = rows.join(F.broadcast(closing), F.col("id").eqNullSafe(F.col("first"))).select("id", "text", "part", F.lit(False).alias("own"))
    return placed.unionByName(ends)


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each document and of an edited copy, and how alike they are.

    In the copy the last ``floor(n_chars / 2)`` characters are replaced by the first as many, or
    all, of the next document by ascending id; after the last comes the first. NULL
    texts are empty. A NULL id stands before all others. Rows that repeat an id stand next to
    each other, in order of their texts; after the last document comes the first row of the first id.
    ``near_edited`` and ``near_next`` are the shared parts of the kept hashes, of the
    document with its edited copy and with the next document.
    """
    spark = docs.sparkSession
    tasks = shuffle_partitions(spark)
    placed = _ranges(docs, id, text, min(4 * tasks, RANGES))
    ordered = placed.repartition(tasks, "part").sortWithinPartitions(F.col("part"), F.col("own").desc(), F.col("id").asc_nulls_first(), "text")
    added = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = fields(docs.schema[id], added)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()

        def row(doc: int | None, text: str, marks, following: str, next_marks) -> tuple:
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            edited_marks = winnow(edited, rolling, k, window)
            return (
                doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(*marks),
                as_text(*edited_marks), likeness(marks[0], edited_marks[0]), likeness(marks[0], next_marks[0]),
            )

        held = None  # the document that waits for its next one
        for batch in batches:
            rows = []
            for doc, text, part, own in zip(*[c.to_pylist() for c in batch.columns]):
                marks = winnow(text, rolling, k, window)
                if held is not None and held[3] == part:
                    rows.append(row(*held[:3], text, marks))
                held = (doc, text, marks, part) if own else None
            columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, kinds)], names=schema.names)

    kinds = [pa.int64() if docs.schema[id].dataType == T.LongType() else pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return arrow_map(ordered, mark, schema)
