"""What the operators share: bounded Arrow batches, word bounds, rolling hashes, minimisers.

Texts are handled as arrays of bytes or code points, a document at a time, so a task holds
one Arrow batch of documents and the arrays of one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wikiloom.session import configured, staged

BATCH_ROWS = 512

U64 = np.uint64


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of few rows, as a text may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


#: Spark removes the shuffle files of a query when the query ends.
_SHUFFLES_REMOVED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored and read back, and the shuffle files behind it removed."""
    with configured(df.sparkSession, _SHUFFLES_REMOVED):
        return staged(df, label)


def fields(*parts: T.StructType | T.StructField | str) -> T.StructType:
    """A schema of the given ones in a row; texts are DDL."""
    found: list[T.StructField] = []
    for part in parts:
        if isinstance(part, T.StructField):
            found.append(part)
        else:
            found += (T.StructType.fromDDL(part) if isinstance(part, str) else part).fields
    return T.StructType(found)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else ''."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(found, upper, upper.lower())


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; '' without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


# -- words ----------------------------------------------------------------------


def byte_class(separators: bytes) -> np.ndarray:
    """Per byte value whether it belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


WHITE = bytes([0x20, *range(0x09, 0x0E)])


def word_bounds(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after each."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = is_word[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


# -- hashes ---------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Hashes of any ranges of a sequence, from prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        powers = np.ones(size + 1, dtype=U64)
        inverse = np.ones(size + 1, dtype=U64)
        powers[1:] = U64(self.BASE)
        inverse[1:] = U64(pow(self.BASE, -1, 1 << 64))
        self.powers = np.multiply.accumulate(powers)
        self.inverse = np.multiply.accumulate(inverse)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.powers):
            self._grow(1 << (len(values) + 1).bit_length())
        sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum((values.astype(U64) + U64(1)) * self.powers[: len(values)], out=sums[1:])
        return sums

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair; equal ranges have equal hashes."""
        return mix((prefix[ends] - prefix[starts]) * self.inverse[starts] + (ends - starts).astype(U64))

    def grams(self, values: np.ndarray, width: int) -> np.ndarray:
        """Hash of each run of ``width`` values."""
        prefix = self.prefix(values)
        starts = np.arange(max(len(values) - width + 1, 0))
        return self.ranges(prefix, starts, starts + width)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.ranges(self.prefix(data), starts, ends)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if span < width:
        values = np.minimum(values[: len(values) - (width - span)], values[width - span :])
    return values


_HIGH = U64(0xFFFFFFFF00000000)
_LOW = U64(0xFFFFFFFF)


def minimisers(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run of ``width`` grams the place of its least one, and the distinct places.

    Of equal grams the leftmost counts, so equal runs have their least gram at the same
    distance from their start, wherever they stand.
    """
    if len(grams) < width:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    packed = (grams & _HIGH) | np.arange(len(grams), dtype=U64)
    places = (window_min(packed, width) & _LOW).astype(np.int64)
    keep = np.ones(len(places), dtype=bool)
    keep[1:] = places[1:] != places[:-1]
    return places, places[keep]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists cut from one array of values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a run of ``length`` from one of ``starts``."""
    steps = np.zeros(total + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, total), -1)
    return np.cumsum(steps[:-1]) > 0
