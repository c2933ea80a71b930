"""Places where a long repetition must show, and which of them recur.

Each run of ``length`` units (words or bytes) picks the least hashed gram within it, its
anchor. Equal runs pick the same anchor at the same distance from their start, so a run can
only be repeated if its anchor's gram occurs again. This leaves a small part of the
places to compare, and grams are counted with partial sums before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wikiloom.llm.common import Rolling, arrow_map, joined, minimisers, settled
from wikiloom.session import RUNTIME_FILTER, configured

#: Units of a text, as numbers: ``(data, rolling) -> array``.
Units = Callable[[bytes, Rolling], np.ndarray]


#: Keys remembered by a task, so its memory is bounded; a forgotten one is read again.
SEEN = 1_000_000


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``docs`` with ``__key``, a hash of id and text, so rows that repeat both share a key."""
    return docs.withColumn("__key", F.xxhash64(F.col(id), F.col(text)))


def recurring(docs: DataFrame, units: Units, length: int, gram: int, text: str, once: bool = False) -> DataFrame:
    """``__key, __anchors``: per key the hashes of its anchors that occur more than once.

    With ``once`` a task reads the first document of each key only. An anchor of a document is one row, with the number
    of its places, so a document that repeats a phrase makes no crowd.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        seen: set[int] = set()
        for batch in batches:
            hashes, owners, times = [], [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t and key not in seen:
                    if once:
                        seen = seen if len(seen) < SEEN else set()
                        seen.add(key)
                    grams = rolling.grams(units(t.encode("utf-8", "surrogatepass"), rolling), gram)
                    places = minimisers(grams, length - gram + 1)[1]
                    own, n = np.unique(grams[places], return_counts=True)
                    hashes.append(own)
                    times.append(n)
                    owners.append(np.full(len(own), key, dtype=np.int64))
            columns = joined(hashes, np.uint64).view(np.int64), joined(owners, np.int64), joined(times, np.int64).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "__key", "times"])

    rows = settled(arrow_map(docs.select("__key", text), find, "anchor long, __key long, times int"), "anchors")
    # Partial sums come before the shuffle, so a frequent anchor is one row of each task.
    again = settled(rows.groupBy("anchor").agg(F.sum("times").alias("times")).filter("times > 1").select("anchor"), "again")
    with configured(docs.sparkSession, RUNTIME_FILTER):
        # Anchors that occur once are dropped by a Bloom filter where they are read.
        own = rows.select("anchor", "__key").join(again, "anchor", "left_semi")
        return settled(own.groupBy("__key").agg(F.collect_set("anchor").alias("__anchors")), "recurring")
