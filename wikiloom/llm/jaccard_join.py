"""Near copies by the Jaccard likeness of word n-grams, with signature trees.

Two sets that are alike enough share one of their first shingles, if all shingles are put in one
order and so many are taken of each set that the rest cannot hold all that must be shared.
The order is by hash, but shingles of very many sets come last, so frequent passages put
no crowd together. Sets that share such a shingle meet in a group, as bitmaps with their sizes.
There a signature tree is built: its nodes hold the OR of the bitmaps below and the range of
sizes. Pairs of nodes are descended together and dropped if the largest possible overlap is
too small for any pair below.

First each set goes to the groups of its few least shared shingles, then the groups that still hold
several clusters are descended, without the sets that no other of the group
can be linked with, by the places that the shingle has in them. A pair that bitmaps allow puts two clusters of its group together and pairs within a
cluster are skipped, so a crowd gives as many pairs as members and not all. A large group is cut into blocks by the
hash of the set: blocks are descended one by one, then one member of each cluster of each block, and only groups that are
not yet one cluster by then have their blocks meet in pairs. All links lie
within clusters. The sets of a cluster are sent to one task, once, or to blocks of tasks if there are
very many, where a tree over them is descended again and pairs are checked on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wikiloom.llm.common import U64, WHITE, Rolling, arrow_map, byte_class, fields, joined, mix, settled, shuffle_partitions, word_bounds
from wikiloom.session import RUNTIME_FILTER, configured, staged

WORDS = 5
PERCENT = 75

#: Shingles of more sets than this come last, unless they are too many to be sent around.
FREQUENT = 200
MOST_FREQUENT = 1_000_000

#: Groups of the first round that each set goes to.
FIRST = 3
LEAF = 64

#: Sets of a group, and shingles of these, that are descended in one tree; larger groups are cut into blocks.
GROUP = 1000
GROUP_SHINGLES = 1 << 25

#: Sets of a cluster that meet in one task; larger clusters are cut into blocks that meet in pairs.
BLOCK = 4000

#: Links of which one task works out the components.
FEW = 1 << 16

#: For the join of a cluster's sets with their texts: Spark drops texts of other documents by a Bloom filter
#: of ids before it shuffles, also where its default takes the texts for too few. The filter has a fixed
#: 1 MB; with many millions of near copies it lets most through and the join costs a shuffle of the texts.
PRUNED = RUNTIME_FILTER

_WORD = byte_class(WHITE)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingles(text: str | None, words: int, rolling: Rolling) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8)
    hashes = rolling.words(data, *word_bounds(data, _WORD))
    return np.unique(rolling.grams(hashes, min(words, len(hashes)))) if len(hashes) else hashes


def identity(found: np.ndarray) -> int:
    """One number for a set; equal sets only are expected to share it."""
    with np.errstate(over="ignore"):
        return int((mix(found).sum() * U64(0x9E3779B97F4A7C15) + U64(len(found))).view(np.int64)) if len(found) else 0


def least_overlap(a, b, percent: int):
    """Shared shingles that two sets of these sizes need: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which linked sets share one: all but what must be shared, and one more."""
    return n - (-(-percent * n // 100)) + 1


#: Bits of the place of a shingle in a set, below the set's size in one number.
PLACE_BITS = 31


def meeting(places: np.ndarray, parts: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a group may be linked with one of another part for which the group's shingle is the first they share.

    ``places`` are sizes and places as ``PLACE_BITS`` has them. All that two sets share is from the first shared shingle
    on, so as much as ``least_overlap`` asks for must be left there in both.
    """
    sizes, at = places >> PLACE_BITS, places & (1 << PLACE_BITS) - 1
    reach = 100 * sizes - (100 + percent) * at
    fits = percent * sizes[None, :] <= reach[:, None]
    return (fits & fits.T & (parts[:, None] != parts[None, :])).any(axis=1)


def bitmap(found: np.ndarray) -> bytes:
    """Bits of the hashes; as many as the size asks for, a power of two."""
    bits = 64 << max(0, (len(found) * 4 - 1).bit_length() - 6)
    marks = np.zeros(bits, dtype=np.uint8)
    marks[(found >> U64(7)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(marks).tobytes()


# -- signature trees ---------------------------------------------------------------------


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap at a smaller size: bits a multiple of the size apart fall together."""
    bits = np.frombuffer(bitmap, dtype=np.uint64)
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


class Node:
    """Members, the OR of their bitmaps, their range of sizes, and two nodes below or none.

    ``slack`` is the most by which a member's size exceeds its number of bits. ``small`` says whether a
    member is of the smaller of the two classes of sizes in the tree.
    """

    __slots__ = ("members", "union", "least", "most", "slack", "small", "below", "part")

    def __init__(self, members: np.ndarray, tree: Tree):
        own = tree.bits[members]
        sizes = tree.sizes[members]
        self.members = members
        self.union = np.bitwise_or.reduce(own, axis=0)
        self.least, self.most = int(sizes.min()), int(sizes.max())
        self.slack = int((sizes - tree.ones[members]).max())
        self.small = bool(tree.small[members].any())
        parts = tree.parts[members]
        self.part = int(parts[0]) if (parts == parts[0]).all() else None
        self.below: tuple[Node, Node] | None = None
        if len(members) > LEAF:
            if self.least * 5 < self.most * 4:
                order = members[np.argsort(sizes, kind="stable")]
            else:
                # Cut by likeness to the first member and to the one least like it.
                to_first = _ones(own & own[0])
                to_far = _ones(own & own[int(np.argmin(to_first))])
                order = members[np.argsort(to_far - to_first, kind="stable")]
            half = len(order) // 2
            self.below = Node(order[:half], tree), Node(order[half:], tree)


class Tree:
    """Signature tree of one group; bitmaps are folded to one size."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[bytes], small: np.ndarray, parts: np.ndarray):
        least = min(map(len, bitmaps)) // 8
        self.bits = np.stack([_folded(b, least) for b in bitmaps])
        self.ones = _ones(self.bits)
        self.sizes, self.small, self.parts = sizes, small, parts
        self.root = Node(np.arange(len(sizes)), self)


class Parts:
    """Which parts belong together."""

    def __init__(self) -> None:
        self.parents: dict[int, int] = {}

    def root(self, p: int) -> int:
        parents = self.parents
        while (up := parents.get(p, p)) != p:
            parents[p] = parents.get(up, up)
            p = up
        return p

    def join(self, p: int, q: int) -> None:
        self.parents[max(p, q)] = min(p, q)


def _descend(tree: Tree, parts: Parts, percent: int, merging: bool, check: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Pairs of members of different parts whose bitmaps allow the overlap they need."""
    sizes, bits, ones = tree.sizes, tree.bits, tree.ones

    def one_part(node: Node) -> int | None:
        if node.part is None and merging:
            roots = {parts.root(p) for p in tree.parts[node.members].tolist()}
            if len(roots) == 1:
                node.part = roots.pop()
        return None if node.part is None else parts.root(node.part)

    todo = [(tree.root, tree.root)]
    while todo:
        a, b = todo.pop()
        if not (a.small or b.small):
            continue
        p = one_part(a)
        if p is not None and (a is b or p == one_part(b)):
            continue
        if a is not b:
            if 100 * a.most < percent * b.least or 100 * b.most < percent * a.least:
                continue
            # Two members share the bits of at most what both unions have, and besides at most
            # as many shingles as fell on the same bits.
            overlap = int(_ones(a.union & b.union)) + min(a.slack, b.slack)
            if overlap < least_overlap(a.least, b.least, percent):
                continue
        if a.below is None and b.below is None:
            for n, i in enumerate(a.members.tolist()):
                others = a.members[n + 1 :] if a is b else b.members
                if not len(others):
                    continue
                shared = _ones(bits[others] & bits[i])
                overlap = np.minimum(sizes[i] - ones[i], sizes[others] - ones[others]) + shared
                fits = (overlap >= least_overlap(sizes[i], sizes[others], percent)) & (tree.small[others] | tree.small[i])
                fits &= (100 * sizes[i] >= percent * sizes[others]) & (100 * sizes[others] >= percent * sizes[i])
                for j in others[fits].tolist():
                    p, q = parts.root(int(tree.parts[i])), parts.root(int(tree.parts[j]))
                    if p != q and check(i, j):
                        yield i, j
                        if merging:
                            parts.join(p, q)
        elif a is b:
            x, y = a.below
            todo += [(x, y), (y, y), (x, x)]
        elif b.below is None or a.below is not None and len(a.members) >= len(b.members):
            todo += [(a.below[1], b), (a.below[0], b)]
        else:
            todo += [(a, b.below[1]), (a, b.below[0])]


def _leaf_pairs(sizes: list[int], bitmaps: list[bytes], parts: list[int], percent: int, merging: bool, check: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """As ``_descend`` for members that make one leaf, each two at the smaller size of their bitmaps."""
    known = Parts()
    numbers = [int.from_bytes(b, "little") for b in bitmaps]
    lengths = [len(b) for b in bitmaps]
    for j in range(1, len(sizes)):
        for i in range(j):
            if 100 * sizes[i] < percent * sizes[j] or 100 * sizes[j] < percent * sizes[i]:
                continue
            p, q = known.root(parts[i]), known.root(parts[j])
            if p == q:
                continue
            x, y = (i, j) if lengths[i] <= lengths[j] else (j, i)
            a, b, length = numbers[x], numbers[y], lengths[y]
            while length > lengths[x]:
                length //= 2
                b = b >> 8 * length | b & (1 << 8 * length) - 1
            overlap = (a & b).bit_count() + min(sizes[x] - a.bit_count(), sizes[y] - b.bit_count())
            if overlap >= least_overlap(sizes[i], sizes[j], percent) and check(i, j):
                yield i, j
                if merging:
                    known.join(p, q)


def candidate_pairs(
    sizes: np.ndarray, bitmaps: list[bytes], parts: np.ndarray, percent: int, merging: bool = True, check: Callable[[int, int], bool] | None = None
) -> list[tuple[int, int]]:
    """Pairs of places of different parts that may be linked.

    With ``merging`` a pair puts its two parts together, so pairs form a forest; without, all are
    given. ``check`` has the last word on a pair. Sets that are alike have bitmaps of one size or of neighbouring ones, so
    there is a tree for each two neighbouring sizes.
    """
    if len(bitmaps) <= LEAF:
        return list(_leaf_pairs(sizes.tolist(), bitmaps, parts.tolist(), percent, merging, check or (lambda i, j: True)))
    lengths = np.array([len(b) for b in bitmaps])
    known = Parts()
    pairs: list[tuple[int, int]] = []
    for length in np.unique(lengths).tolist():
        chosen = np.flatnonzero((lengths == length) | (lengths == 2 * length))
        if len(chosen) < 2:
            continue
        tree = Tree(sizes[chosen], [bitmaps[i] for i in chosen.tolist()], lengths[chosen] == length, parts[chosen])
        passes = (lambda i, j: True) if check is None else lambda i, j, c=chosen: check(int(c[i]), int(c[j]))
        pairs += [(int(chosen[i]), int(chosen[j])) for i, j in _descend(tree, known, percent, merging, passes)]
    return pairs


# -- jobs -----------------------------------------------------------------------------------


def _prefixes(docs: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    """``id, mark, n, sid, keys, bits``; keys and bits where a task meets the set first.

    ``mark`` is a hash of the text, by which rows of one id are told apart.
    ``frequent`` is a broadcast sorted array of shingles that come last in the order.
    """
    schema = fields(docs.schema["id"], "mark long, n long, sid long, keys array<long>, bits binary")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        last = frequent.value
        seen: set[int] = set()
        for batch in batches:
            sizes, sids, keys, bits = [], [], [], []
            for t in batch.column(2).to_pylist():
                found = shingles(t, words, rolling)
                sid = identity(found)
                sizes.append(len(found))
                sids.append(sid)
                if not len(found) or sid in seen:
                    keys.append(None)
                    bits.append(None)
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sid)
                most = prefix_length(len(found), percent)
                if len(last):
                    is_last = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
                    found_first = np.concatenate((found[~is_last], found[is_last])) if is_last.any() else found
                else:
                    found_first = found
                keys.append(found_first[:most].view(np.int64))
                bits.append(bitmap(found))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "n", "sid", "keys", "bits"])

    return arrow_map(docs.select("id", F.xxhash64("text").alias("mark"), "text"), find, schema)


def _frequent(prefixes: DataFrame) -> np.ndarray:
    """Shingles of very many sets, at most ``MOST_FREQUENT``; fewer by a higher limit."""
    counted = prefixes.select(F.explode("keys").alias("key")).groupBy("key").count().filter(F.col("count") > FREQUENT)
    counted = settled(counted, "frequent")
    limit, n = FREQUENT, counted.count()
    while n > MOST_FREQUENT:
        limit *= 2
        n = counted.filter(F.col("count") > limit).count()
    # Bounded by MOST_FREQUENT numbers.
    keys = [r[0] for r in counted.filter(F.col("count") > limit).select("key").collect()]
    return np.sort(np.array(keys, dtype=np.int64).view(U64))


def _pairs(groups: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs that put clusters ``part`` of a group together; ``key, x, y, sid, part, n, bits``.

    A group is what has one ``key, x, y``.
    """
    tasks = shuffle_partitions(groups.sparkSession)
    names = ["key", "x", "y"]
    ordered = groups.repartition(tasks, *names).sortWithinPartitions(*names, "sid").select(*names, "sid", "part", "n", "bits")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: set[tuple[int, int]] = set()

        def close() -> None:
            if len(group) > 1:
                sids = [r[3] for r in group]
                parts = np.array([r[4] for r in group], dtype=np.int64)
                sizes = np.array([r[5] for r in group], dtype=np.int64)
                for i, j in candidate_pairs(sizes, [r[6] for r in group], parts, percent):
                    found.add((min(sids[i], sids[j]), max(sids[i], sids[j])))
            group.clear()

        def out() -> pa.RecordBatch:
            a, b = zip(*found) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if group and group[0][:3] != row[:3]:
                    close()
                    if len(found) > 50_000:
                        yield out()
                group.append(row)
        close()
        yield out()

    return arrow_map(ordered, find, "a long, b long").distinct()


def _parts_of(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """``members`` with the part of their set in ``clusters``, or their own where it has none."""
    found = members.join(clusters.withColumnRenamed("part", "now"), "sid", "left")
    return found.withColumn("part", F.coalesce("now", "part")).drop("now")


def _mixed(members: DataFrame) -> DataFrame:
    """Groups ``key`` that hold several clusters."""
    ends = members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return ends.filter("low <> high").select("key")


def _meeting(members: DataFrame, percent: int) -> DataFrame:
    """``members``, ``key, sid, place, part``, of groups of at most ``GROUP``, without those that ``meeting`` rules out."""
    ordered = members.repartition(shuffle_partitions(members.sparkSession), "key").sortWithinPartitions("key", "sid")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = rows.column(0).to_numpy()
            # The last group may go on in the next batch.
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            whole = int(ends[-1]) if len(ends) else 0
            yield from chosen(rows.slice(0, whole), ends)
            rest = rows.slice(whole)
        if rest is not None:
            yield from chosen(rest, np.array([len(rest)]))

    def chosen(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        places, parts = rows.column(2).to_numpy(), rows.column(3).to_numpy()
        starts = [0, *ends[:-1].tolist()]
        kept = joined([meeting(places[a:b], parts[a:b], percent) for a, b in zip(starts, ends.tolist())], bool)
        yield from rows.filter(pa.array(kept)).combine_chunks().to_batches()

    return arrow_map(ordered, find, members.schema)


def _group_pairs(members: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs that put clusters ``part`` of the groups ``key, sid, n, part`` together, by bitmaps ``sid, bits``.

    Each two members of a group are in one cluster by these pairs, or their bitmaps do not allow a link. A group of more than
    ``GROUP`` members or ``GROUP_SHINGLES`` shingles is never gathered in a task, only its blocks and each two of them.
    """
    size = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES))
    large = staged(members.groupBy("key").agg(size.alias("blocks")).filter("blocks > 1"), "large")
    if large.isEmpty():
        whole = members.withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
        return settled(_pairs(whole.join(bits, "sid"), percent), "pairs")

    block = F.coalesce(F.pmod(F.xxhash64("sid"), F.col("blocks")), F.lit(0))
    dealt = members.join(large, "key", "left").withColumn("x", block)
    pairs = settled(_pairs(dealt.withColumn("y", F.col("x")).join(bits, "sid"), percent), "pairs")
    cut = staged(_parts_of(dealt.filter("blocks > 1"), components(pairs)), "cut")

    # One member of each cluster of each block, where these are few enough to meet.
    several = cut.join(staged(_mixed(cut), "mixed"), "key", "left_semi")
    chosen = staged(several.groupBy("key", "x", "part").agg(F.min(F.struct("sid", "n")).alias("one")).select("key", "part", "one.*"), "chosen")
    few = chosen.groupBy("key").agg(size.alias("blocks")).filter("blocks = 1").select("key")
    meeting = chosen.join(staged(few, "few"), "key", "left_semi").withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    pairs = staged(pairs.union(settled(_pairs(meeting.join(bits, "sid"), percent), "pairs")), "pairs")
    cut = staged(_parts_of(cut, components(pairs)), "cut")

    # What is still apart may be linked by other members.
    left = cut.join(staged(_mixed(cut), "mixed"), "key", "left_semi")
    if left.isEmpty():
        return pairs
    met = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("x <> other")
    met = met.select("key", F.least("x", "other").alias("x"), F.greatest("x", "other").alias("y"), "sid", "n", "part")
    return pairs.union(settled(_pairs(met.join(bits, "sid"), percent), "pairs"))


def _members(clusters: DataFrame, prefixes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``sid, part, blocks, items``: the sets of clusters ``sid, part``, once each, and the number of blocks of the cluster."""
    places = prefixes.filter("bits IS NOT NULL").groupBy("sid").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("row")).select("sid", "row.id", "row.mark").join(clusters, "sid")
    members = clusters.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # The filter says what all rows have, but tells Spark that this side may prune the other.
    few = settled(places.join(members, "part"), "places").filter("blocks >= 1")
    # A row of the set is told by its id and its text, so many rows of one id are no crowd.
    marked = docs.select("id", F.xxhash64("text").alias("mark"), "text")
    texts = marked.join(few, ["id", "mark"]).select("sid", "part", "blocks", "text")
    # Sets of rows without an id only are found by the hash of a text.
    nameless = docs.filter("id IS NULL").select(F.xxhash64("text").alias("mark"), "text").dropDuplicates(["mark"])
    texts = texts.union(nameless.join(few.filter("id IS NULL"), "mark").select("sid", "part", "blocks", "text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [])
            for sid, part, blocks, t in zip(*[c.to_pylist() for c in batch.columns]):
                items = shingles(t, words, rolling)
                if identity(items) == sid:  # an id may stand for several texts
                    for column, value in zip(found, (sid, part, blocks, items.tobytes())):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], names=["sid", "part", "blocks", "items"])

    return arrow_map(texts, whole, "sid long, part long, blocks long, items binary").dropDuplicates(["sid"])


def _meetings(sets: DataFrame, *more: str) -> DataFrame:
    """Members of each two blocks of a cluster, ``x`` and ``y``, next to each other in one task; ``own`` is a member's block.

    Each block meets each block of its cluster, itself included.
    """
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    met = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "sid", "items", "own", *more)
    return met.repartition(shuffle_partitions(sets.sparkSession), "part", "x", "y").sortWithinPartitions("part", "x", "y", "sid")


def _links(clusters: DataFrame, prefixes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: links that connect what is linked in each cluster ``sid, part``, by whole sets."""
    ordered = _meetings(_members(clusters, prefixes, docs, words)).drop("own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def close() -> pa.RecordBatch:
            sids = [r[3] for r in group]
            items = [np.frombuffer(r[4], dtype=np.uint64) for r in group]
            group.clear()

            def linked(i: int, j: int) -> bool:
                shared = len(np.intersect1d(items[i], items[j], assume_unique=True))
                return 100 * shared >= percent * (len(items[i]) + len(items[j]) - shared)

            sizes = np.array([len(x) for x in items], dtype=np.int64)
            pairs = candidate_pairs(sizes, [bitmap(x) for x in items], np.arange(len(items)), percent, check=linked) if items else []
            columns = [pa.array([sids[p[side]] for p in pairs], pa.int64()) for side in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if group and group[0][:3] != row[:3]:
                    yield close()
                group.append(row)
        yield close()

    return arrow_map(ordered, compare, "a long, b long")


def linked_rows(sets: list[np.ndarray], rows: np.ndarray, blocks: np.ndarray, percent: int) -> np.ndarray:
    """Per set the number of rows of all other sets that it is linked with.

    If members are of two blocks, only links between these count. Shared shingles are counted over the lists of
    sets that hold each shingle, so a pair costs no more than what it shares.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    places = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(places, kind="stable")]
    held = np.bincount(places)
    firsts = np.cumsum(held) - held
    ends = np.cumsum(sizes)
    across = len(np.unique(blocks)) > 1
    found = np.zeros(len(sets), dtype=np.int64)
    for i, end in enumerate(ends.tolist()):
        own = places[end - sizes[i] : end]
        counts = held[own]
        at = np.repeat(firsts[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(holders[at], minlength=len(sets))
        linked = 100 * shared >= percent * (sizes[i] + sizes - shared)
        linked[i] = False
        if across:
            linked &= blocks != blocks[i]
        found[i] = rows[linked].sum()
    return found


def _link_counts(classes: DataFrame, weights: DataFrame, prefixes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``sid, others``: the rows of other sets that each set of the classes ``sid, part`` is linked with."""
    sets = _members(classes, prefixes, docs, words).join(weights, "sid")
    ordered = _meetings(sets, "rows").select("part", "x", "y", "sid", "items", "own", "rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def close() -> pa.RecordBatch:
            sids = [r[3] for r in group]
            items = [np.frombuffer(r[4], dtype=np.uint64) for r in group]
            own, rows = (np.array([r[i] for r in group], dtype=np.int64) for i in (5, 6))
            # Two blocks that meet where one is empty have no links between them.
            apart = bool(group) and group[0][1] != group[0][2]
            none = not group or (apart and len(np.unique(own)) == 1)
            group.clear()
            others = np.zeros(len(sids), dtype=np.int64) if none else linked_rows(items, rows, own, percent)
            return pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(others)], names=["sid", "others"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if group and group[0][:3] != row[:3]:
                    yield close()
                group.append(row)
        yield close()

    return arrow_map(ordered, count, "sid long, others long").groupBy("sid").agg(F.sum("others").alias("others"))


def _least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the links, and the least end that each one reaches."""
    ends, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    to = np.arange(len(ends))
    while (to[x] != to[y]).any():
        low = np.minimum(to[x], to[y])
        for side in (to[x], to[y]):
            np.minimum.at(to, side, low)
        # What is pointed at is never greater, so pointers end at the least of a tree.
        while (to != to[to]).any():
            to = to[to]
    return ends, ends[to]


def _few_components(links: DataFrame) -> DataFrame:
    """``sid, part`` of at most ``FEW`` links, by one task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        a, b = (joined([r.column(i).to_numpy() for r in read], np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _least_reached(a, b)], names=["sid", "part"])

    return arrow_map(links.select("a", "b").coalesce(1), find, "sid long, part long")


def components(links: DataFrame) -> DataFrame:
    """``sid, part`` of all linked sets: the least set that links reach. ``links`` are a stored table.

    Each round maps every set to the least of itself and its neighbours and draws the
    links between what they are mapped to, which at least halves the sets that are left of a component. Once no more
    than ``FEW`` links are left, whatever the size of the input, one task works out the rest.
    """
    edges = links.filter("a <> b").select("a", "b")
    labels = None
    while edges.count() > FEW:
        if labels is None:
            edges = staged(edges.distinct(), "edges")
        ends = edges.union(edges.select("b", "a")).toDF("u", "v")
        near = staged(ends.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "near")
        labels = near.toDF("sid", "part") if labels is None else _moved(labels, near.toDF("part", "to"))
        moved = edges.join(near.toDF("a", "a2"), "a").join(near.toDF("b", "b2"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        edges = staged(moved.filter("a <> b").distinct(), "edges")
    rest = staged(_few_components(edges), "rest")
    return rest if labels is None else _moved(labels, rest.toDF("part", "to"))


def _moved(labels: DataFrame, to: DataFrame) -> DataFrame:
    """``labels`` with parts mapped by ``part, to``."""
    return staged(labels.join(to, "part", "left").select("sid", F.coalesce("to", "part").alias("part")), "labels")


def _linked(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What ``_prefixes`` says of each row ``id, text``, and ``sid, part`` of all sets that are linked with others."""
    context = rows.sparkSession.sparkContext
    nothing = context.broadcast(np.zeros(0, dtype=U64))
    frequent = _frequent(_prefixes(rows, words, percent, nothing))
    prefixes = staged(_prefixes(rows, words, percent, context.broadcast(frequent)), "prefixes")

    exploded = prefixes.filter("keys IS NOT NULL").select("sid", "n", F.posexplode("keys").alias("place", "key"))
    exploded = exploded.select("sid", "key", (F.shiftleft("n", PLACE_BITS) + F.col("place")).alias("place"))
    # Least and greatest have partial aggregates, so a shingle of very many sets is one row of each task.
    ends = exploded.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high"))
    several = settled(ends.filter("low <> high").select("key"), "several")
    with configured(rows.sparkSession, PRUNED):
        # The filter says what all rows have, but lets Spark drop lone shingles by a Bloom filter before they are dealt.
        both = exploded.join(several.filter("key IS NOT NULL"), "key", "left_semi")
        shared = settled(both.select("key", "sid", "place").distinct(), "shared")
    bits = prefixes.filter("bits IS NOT NULL").join(shared.select("sid").distinct(), "sid", "left_semi")
    bits = staged(bits.groupBy("sid").agg(F.first("bits").alias("bits")), "bits")

    size = F.shiftright("place", PLACE_BITS).alias("n")
    first = shared.groupBy("sid", size).agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST).alias("keys"))
    first = staged(first.select(F.explode("keys").alias("key"), "sid", "n", F.col("sid").alias("part")), "first")
    pairs = _group_pairs(first, bits, percent)
    clusters = components(pairs)

    # Groups of several clusters, without the sets that none of another cluster can be linked with there; linked sets
    # meet in the group of the first shingle that they share. Then groups of the same sets are looked at once.
    placed = settled(_parts_of(shared.withColumn("part", F.col("sid")), clusters), "placed")
    ends = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("members"))
    mixed = settled(ends.filter("low <> high").select("key", "members"), "mixed")
    held = settled(placed.join(mixed, "key").select("key", "sid", "place", "part", "members"), "held")
    large = held.filter(F.col("members") > GROUP).drop("members")
    met = settled(_meeting(held.filter(F.col("members") <= GROUP).drop("members"), percent).union(large), "met")
    alike = met.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("sid")).alias("who"))
    chosen = alike.groupBy("members", "who").agg(F.min("key").alias("key")).select("key")
    chosen = staged(met.join(settled(chosen, "chosen"), "key", "left_semi").select("key", "sid", size, "part"), "second")
    more = _group_pairs(chosen, bits, percent)
    if not more.isEmpty():
        clusters = components(pairs.union(more))
    with configured(rows.sparkSession, PRUNED):
        links = settled(_links(clusters, prefixes, rows, words, percent), "links")
    parts = components(links)
    return prefixes, parts


def near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of each document.

    A document's set are its distinct runs of ``words`` words, ASCII letters lower-cased; with
    fewer words the whole sequence is its one shingle, and without words the set is empty and
    linked with nothing. Two documents link if the sets share ``percent`` of their union or
    more; ``component_id`` is the least id that links reach, the document's own included.
    ``n_links`` is the number of other rows that the row is linked with.
    Documents with equal sets are handled as one. Rows that repeat an id count one by one. A NULL id
    gets the least other id of its component, or NULL. NULL texts are empty.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    prefixes, parts = _linked(rows, words, percent)
    sets = prefixes.filter("n > 0").groupBy("sid").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    sets = staged(sets, "sets")
    parts = staged(parts, "parts")
    with configured(docs.sparkSession, PRUNED):
        counts = settled(_link_counts(parts, sets.select("sid", "rows").join(parts.select("sid"), "sid"), prefixes, rows, words, percent), "counts")
    sets = sets.join(parts, "sid", "left").join(counts, "sid", "left")
    sets = sets.select("sid", "least", F.coalesce("part", "sid").alias("part"), (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    least = sets.groupBy("part").agg(F.min("least").alias("component_id"))
    classes = staged(sets.join(least, "part").select("sid", "component_id", "n_links"), "classes")
    found = prefixes.join(classes, "sid", "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def survivors(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, and all rows without words.

    It is the row of the least id, rows without an id last, and of the least hash of the text among rows of that id.
    Of rows that are equal in both, one stays. Rows are judged one by one: what another row of the same id is a copy of
    does not matter.
    """
    prefixes, parts = _linked(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), words, percent)
    rows = prefixes.filter("n > 0").join(parts, "sid", "left").select(F.coalesce("part", "sid").alias("part"), "id", "mark")
    keys = settled(rows.groupBy("part", "id", "mark").count(), "keys")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    best = keys.groupBy("part").agg(F.min(order).alias("best")).select("part", "best.id", "best.mark")
    best = staged(best.toDF("part", "best_id", "best_mark"), "best")
    is_best = F.col("id").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark"))
    judged = staged(keys.join(best, "part").select("id", "mark", "count", is_best.alias("kept")), "judged")
    gone = judged.filter("NOT kept").select("id", "mark")
    again = staged(judged.filter("kept AND count > 1").select("id", "mark"), "again")

    def chosen(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        # Copies are many, so both sides are dealt anew at any size.
        keys = keys.hint("merge")
        return rows.join(keys, rows["__id"].eqNullSafe(keys["id"]) & (rows["__mark"] == keys["mark"]), how)

    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(id).alias("__id"), F.xxhash64(text).alias("__mark"))
    left = chosen(marked, gone, "left_anti")
    if not again.isEmpty():
        # Partial aggregates leave one row of each in a task before the shuffle.
        one = chosen(left, again, "left_semi").groupBy("__id", "__mark").agg(F.first("row").alias("row"))
        left = chosen(left, again, "left_anti").select("row").union(one.select("row"))
    return left.select("row.*")
