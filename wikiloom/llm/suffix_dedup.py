"""Repeated byte strings by suffix arrays.

A string is ``LENGTH`` bytes; each holds a gram of ``GRAM`` bytes that stands for it (see
``anchors``). Around each anchor that recurs the strings it stands for are one segment of
less than twice their length. Equal segments are folded, segments of one anchor meet in a
task, and tasks sort bounded batches of them: the segments are cut into phrases, and a suffix
array of the phrases is built by linear grouping (``gsaca``). Two equal strings start with equal
bytes up to a phrase, have equal phrases in the middle, which then lie in one interval of the
suffix array, and end with equal bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wikiloom.llm.anchors import keyed, recurring
from wikiloom.llm.common import U64, Rolling, arrow_map, fields, minimisers, mix, settled, shuffle_partitions
from wikiloom.llm.gsaca import common_prefixes, suffix_array
from wikiloom.session import delete, scratch_folder

LENGTH = 200
GRAM = 64

#: Bytes of segments that a suffix array is built for at once, if one anchor has no more.
BATCH_BYTES = 1 << 21

#: A phrase starts behind white space or three bytes with a rare hash; nothing further back counts.
CONTEXT = 3


def byte_values(data: bytes, rolling: Rolling) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8)


def _phrase_starts(data: np.ndarray) -> np.ndarray:
    """Whether a phrase starts at each place, judged by the three bytes before."""
    starts = np.zeros(len(data) + 1, dtype=bool)
    if len(data) >= CONTEXT:
        a, b, c = (data[i : len(data) - 2 + i].astype(np.uint32) for i in range(CONTEXT))
        rare = ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) >> 26) == 0
        starts[CONTEXT:] = rare | (c == 0x20) | ((c >= 0x09) & (c <= 0x0D))
    return starts


def repeated_starts(segments: list[bytes], length: int, rolling: Rolling) -> list[np.ndarray]:
    """Per segment the starts of strings that start more than once in the segments."""
    lengths = np.array([len(s) for s in segments], dtype=np.int64)
    offsets = np.zeros(len(segments) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    prefix = rolling.prefix(data)
    owner = np.repeat(np.arange(len(segments)), lengths)

    # Phrases, with a symbol of its own behind each segment.
    is_start = _phrase_starts(data)[:-1]
    for d in range(CONTEXT):
        near = offsets[:-1] + d
        is_start[near[near < offsets[1:]]] = d == 0
    firsts = np.flatnonzero(is_start)
    ends = np.append(firsts[1:], len(data))
    hashes = rolling.ranges(prefix, firsts, ends)
    of = owner[firsts] if len(firsts) else firsts
    symbols = np.unique(hashes, return_inverse=True)[1] + len(segments)
    place = np.arange(len(firsts)) + of  # one more symbol for each segment before
    text = np.empty(len(firsts) + len(segments), dtype=np.int64)
    closing = np.ones(len(text), dtype=bool)
    closing[place] = False
    text[place] = symbols
    text[closing] = np.arange(len(segments))
    sa, rank = suffix_array(text)
    lcp = common_prefixes(text.tolist(), sa, rank)
    rank = np.array(rank, dtype=np.int64)

    # Starts of strings, and where their first and last phrases start.
    counts = np.maximum(lengths - length + 1, 0)
    starts = np.repeat(offsets[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # Borders at the first bytes of a segment are not judged by content and do not count.
    judged = np.flatnonzero(is_start & (np.arange(len(data)) - offsets[:-1][owner] >= CONTEXT)) if len(data) else firsts
    number = np.searchsorted(firsts, judged)
    low = np.searchsorted(judged, starts + CONTEXT, side="left")
    high = np.searchsorted(judged, starts + length, side="left") - 1
    inside = (low <= high) & (low < len(judged))
    key = np.zeros(len(starts), dtype=U64)
    bare = starts[~inside]
    key[~inside] = rolling.ranges(prefix, bare, bare + length)
    s, lo, hi = starts[inside], low[inside], high[inside]
    head = rolling.ranges(prefix, s, judged[lo])
    tail = rolling.ranges(prefix, judged[hi], s + length)
    middle = number[hi] - number[lo]
    ranks = rank[place[number[lo]]]
    interval = np.zeros(len(s), dtype=np.int64)
    order = np.argsort(middle, kind="stable")
    edges = np.flatnonzero(np.diff(np.append(middle[order], -1), prepend=-1)) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:]):
        some = order[a:b]
        interval[some] = np.cumsum(lcp < middle[some[0]])[ranks[some]]
    key[inside] = mix(mix(mix(head + tail * U64(3)) + interval.astype(U64)) + middle.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[back] > 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    return [np.flatnonzero(again[bounds[i] : bounds[i + 1]]) for i in range(len(segments))]


def _runs(starts: np.ndarray) -> np.ndarray:
    """First and last of each run of neighbouring starts, one after the other."""
    if not len(starts):
        return np.zeros(0, dtype=np.int32)
    breaks = np.flatnonzero(np.diff(starts) != 1)
    firsts = starts[np.concatenate(([0], breaks + 1))]
    lasts = starts[np.concatenate((breaks, [len(starts) - 1]))]
    return np.stack([firsts, lasts], axis=1).ravel().astype(np.int32)


def segments(rows: DataFrame, length: int, gram: int, text: str) -> DataFrame:
    """``anchor, segment, __key, start``: the strings that each recurring anchor stands for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [])
            for key, t, anchors in zip(*[c.to_pylist() for c in batch.columns]):
                data = t.encode("utf-8", "surrogatepass")
                grams = rolling.grams(np.frombuffer(data, dtype=np.uint8), gram)
                places = minimisers(grams, length - gram + 1)[0]
                edges = np.flatnonzero(np.diff(places)) + 1
                firsts = np.concatenate(([0], edges))
                lasts = np.concatenate((edges - 1, [len(places) - 1]))
                hashes = grams[places[firsts]].view(np.int64)
                known = np.isin(hashes, np.array(anchors, dtype=np.int64))
                for anchor, a, b in zip(hashes[known].tolist(), firsts[known].tolist(), lasts[known].tolist()):
                    for column, value in zip(found, (anchor, data[a : b + length], key, a)):
                        column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], names=["anchor", "segment", "__key", "start"])

    return arrow_map(rows.select("__key", text, "__anchors"), cut, "anchor long, segment binary, __key long, start int")


def sorted_segments(distinct: DataFrame, length: int) -> DataFrame:
    """``anchor, hash, runs``: starts of repeated strings in each distinct segment of an anchor.

    ``distinct`` has ``anchor, hash, n, segment`` with ``n`` the number of equal segments. Segments of
    an anchor are in one partition next to each other; those without company need no sorting.
    """
    ordered = distinct.repartition(shuffle_partitions(distinct.sparkSession), "anchor").sortWithinPartitions("anchor", "hash")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        ready: list[tuple] = []  # whole groups
        group: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            alone = {i for i, r in enumerate(ready) if (i == 0 or ready[i - 1][0] != r[0]) and (i + 1 == len(ready) or ready[i + 1][0] != r[0])}
            among = [i for i in range(len(ready)) if i not in alone]
            starts = dict(zip(among, repeated_starts([ready[i][3] for i in among], length, rolling))) if among else {}
            runs = []
            for i, (_, _, n, segment) in enumerate(ready):
                whole = np.array([0, len(segment) - length], dtype=np.int32)
                runs.append(whole if n > 1 else _runs(starts[i]) if i in starts else whole[:0])
            columns = [pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.int64()), pa.array(runs, pa.list_(pa.int32()))]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=["anchor", "hash", "runs"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if group and group[0][0] != row[0]:
                    ready += group
                    group = []
                    if size >= BATCH_BYTES:
                        yield out()
                        size = 0
                group.append(row)
                size += len(row[3])
        ready += group
        yield out()

    return arrow_map(ordered.select("anchor", "hash", "n", "segment"), sort, "anchor long, hash long, runs array<int>")


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256``, and ``kept`` if wanted.

    Texts are their UTF-8 bytes. A byte is removed if it lies in a string of ``length`` bytes that also
    starts elsewhere, in this document or another; all occurrences go, and strings are judged
    on the input. ``n_spans`` counts the runs of removed bytes; ``kept`` are the other bytes. A NULL
    text is empty. Rows that repeat an id and a text are documents of their own, so their strings
    recur. No row is lost; columns of the new names are replaced.
    """
    kept = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept)
    rows = keyed(kept, id, text)
    spark = docs.sparkSession
    with scratch_folder(spark, "anchors", keep=True) as scratch:
        anchors = recurring(rows, byte_values, length, gram, text)
    found = settled(segments(rows.join(anchors, "__key"), length, gram, text).withColumn("hash", F.xxhash64("segment")), "segments")
    delete(spark, scratch)
    distinct = found.groupBy("anchor", "hash").agg(F.count("*").alias("n"), F.first("segment").alias("segment"))
    sorted_out = settled(sorted_segments(distinct, length).filter(F.size("runs") > 0), "runs")
    shifted = F.transform("runs", lambda r: r + F.col("start"))
    spans = (
        found.select("anchor", "hash", "__key", "start").join(sorted_out, ["anchor", "hash"])
        .groupBy("__key").agg(F.flatten(F.collect_list(shifted)).alias("__spans"))
    )
    place = kept.columns.index(text)
    marked = rows.join(settled(spans, "spans"), "__key", "left").select(*kept.columns, "__spans")
    schema = fields(kept.schema, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [], [])
            for t, spans in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                left, n_removed, n_spans = data, 0, 0
                if spans:
                    steps = np.zeros(len(data) + 1, dtype=np.int32)
                    pairs = np.array(spans, dtype=np.int64).reshape(-1, 2)
                    np.add.at(steps, pairs[:, 0], 1)
                    np.add.at(steps, pairs[:, 1] + length, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    left = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                    n_removed = int(gone.sum())
                    n_spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
                for column, value in zip(found, (len(data), n_removed, n_spans, hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            columns = [pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns[: 4 + with_kept]], names=schema.names)

    return arrow_map(marked, remove, schema)
