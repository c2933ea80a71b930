"""Near copies by SimHash fingerprints, with sharded BK-trees.

A bit of a fingerprint is set if it is set in over half of the hashes of the text's word shingles. Equal
fingerprints are one. Fingerprints within a few bits are found by BK-trees: a node's children are
keyed by their Hamming distance to it, so by the triangle inequality a search follows only
edges whose key is within the radius of the distance to the node.

Each shard has a tree of its own. Shards are made so that no search has to visit all of them: the bits are cut
into one part more than the radius, and two fingerprints within the radius agree in one part at
least. So a shard holds the fingerprints with one value of one part. A shard of over ``SHARD`` fingerprints is cut
again by parts of the bits that are left, and so on. With so few bits left that there are not more than
``SHARD`` different values, a shard cannot be larger; so every tree has a bound, whatever the
data. Trees are built in tasks and never pass through the driver, as fingerprints of all documents must not.

Of the links in a shard a spanning forest goes on, at most one link for each fingerprint in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wikiloom.llm.common import U64, arrow_map, shuffle_partitions
from wikiloom.llm.jaccard_join import components
from wikiloom.session import staged

WORDS = 3
RADIUS = 2
SEED = 42
BITS = 64

#: Fingerprints of one tree.
SHARD = 1024

#: Hashes whose bits are counted at once.
_COUNTED = 1 << 15

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each run of ``words`` words joined by spaces; of the whole sequence if it has fewer words."""
    # Without an argument, bytes are split at the white space of ASCII.
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros(0, dtype=U64)
    width = min(words, len(found))
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - width + 1].tolist()
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]
    return np.array(hashes, dtype=U64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero without hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _COUNTED):
        part = hashes[i : i + _COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Fingerprints by their Hamming distances."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.below: list[dict[int, int]] = []

    def add(self, code: int) -> None:
        place = len(self.codes)
        if place:
            node = 0
            while True:
                distance = (code ^ self.codes[node]).bit_count()
                child = self.below[node].setdefault(distance, place)
                if child == place:
                    break
                node = child
        self.codes.append(code)
        self.below.append({})

    def within(self, code: int, radius: int) -> list[int]:
        """Places of all fingerprints at most ``radius`` bits away."""
        found = []
        open_nodes = [0] if self.codes else []
        while open_nodes:
            node = open_nodes.pop()
            distance = (code ^ self.codes[node]).bit_count()
            if distance <= radius:
                found.append(node)
            below = self.below[node]
            open_nodes += [below[d] for d in range(distance - radius, distance + radius + 1) if d in below]
        return found


def forest(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of different fingerprints within the radius that hold together what all of them hold together."""
    tree, parents, links = BKTree(), list(range(len(codes))), []

    def root(i: int) -> int:
        while parents[i] != i:
            parents[i] = i = parents[parents[i]]
        return i

    for i, code in enumerate(codes):
        for j in tree.within(code, radius):
            a, b = root(i), root(j)
            if a != b:
                parents[a] = b
                links.append((code, codes[j]))
        tree.add(code)
    return links


def _parts(mask: int, count: int) -> list[int]:
    """The set bits of a mask dealt to ``count`` masks, as evenly as can be."""
    bits = [1 << i for i in range(BITS) if mask >> i & 1]
    return [sum(bits[len(bits) * i // count : len(bits) * (i + 1) // count]) for i in range(count)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _tree_links(shards: DataFrame, radius: int) -> DataFrame:
    """``a, b`` of linked fingerprints; ``shards`` has ``shard, code``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, last = [], None

        def links() -> pa.RecordBatch:
            pairs = np.array(forest(codes, radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            for shard, code in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64).tolist()):
                if shard != last:
                    if len(codes) > 1:
                        yield links()
                    codes, last = [], shard
                codes.append(code)
        if len(codes) > 1:
            yield links()

    ordered = shards.select("shard", "code").repartition(shuffle_partitions(shards.sparkSession), "shard")
    return arrow_map(ordered.sortWithinPartitions("shard", "code"), search, "a long, b long")


def near_links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that hold together all fingerprints ``code`` that chains of at most ``radius`` bits hold together."""
    open_shards = codes.select("code", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("path"))
    masks, links = [(1 << BITS) - 1], None
    while True:
        parts = [_parts(mask, radius + 1) for mask in masks]

        def value(i: int):
            mine = F.array(*[F.lit(_signed(p[i])) for p in parts])
            return F.col("code").bitwiseAND(F.element_at(mine, F.col("path") + 1))

        dealt = F.array(*[
            F.struct(F.xxhash64("shard", F.lit(i), value(i)).alias("shard"), (F.col("path") * (radius + 1) + i).alias("path"))
            for i in range(radius + 1)
        ])
        dealt_out = staged(open_shards.select("code", F.explode(dealt).alias("s")).select("code", "s.shard", "s.path"), "shards")
        sizes = staged(dealt_out.groupBy("shard").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        found = _tree_links(dealt_out.join(sizes.filter(F.col("size") <= SHARD), "shard", "left_semi"), radius)
        found = staged(found.distinct(), "links")
        links = found if links is None else links.union(found)
        large = sizes.filter(F.col("size") > SHARD)
        if large.isEmpty():
            return links
        open_shards = dealt_out.join(large, "shard", "left_semi")
        masks = [mask & ~part for mask, own in zip(masks, parts) for part in own]


def near_copies(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row.

    Words are runs without ASCII white space, A-Z lower-cased. All shingles of ``words`` words count, repeats
    included; with fewer words the whole sequence is the one shingle. Without words, and for NULL,
    the fingerprint is zero, and it is linked like any other. Documents link if their fingerprints differ in
    ``radius`` bits or fewer; ``component_id`` is the least id that links reach, the document's own
    included. Rows that repeat an id count one by one. A row with a NULL id gets the least other id of its
    component, or NULL. ``docs`` may have any other columns; they are not passed on.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(codes, dtype=U64).view(np.int64))], names=["id", "code"])

    given = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = staged(arrow_map(given, marks, f"id {given.schema['id'].dataType.simpleString()}, code long"), "fingerprints")
    codes = staged(rows.groupBy("code").agg(F.min("id").alias("least")), "codes")
    parts = components(near_links(codes, radius))
    joined = codes.join(parts.withColumnRenamed("sid", "code"), "code", "left").select("code", "least", F.coalesce("part", "code").alias("part"))
    lowest = joined.groupBy("part").agg(F.min("least").alias("component_id"))
    classes = staged(joined.join(lowest, "part").select("code", "component_id"), "classes")
    digits = F.lower(F.lpad(F.hex("code"), BITS // 4, "0"))
    return rows.join(classes, "code", "left").select(F.col("id").alias(id), digits.alias("fingerprint"), "component_id")
