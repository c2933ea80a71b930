"""Hard negatives by inner products, over Hilbert-ordered blocks with zone maps.

Vectors of whole numbers are put in the order of a Hilbert curve through all dimensions and cut into Parquet
blocks, a row each. A block's zone map holds the least and the greatest number of each dimension and of the
labels. For an anchor, interval arithmetic over a zone map bounds the inner products with all of the
block's rows from both sides, so a block is read only if some window of scores that the anchor still needs can
hold one of its rows.

All of it is exact. An anchor's positives are sought first, in the window above the score of the worst of those found in
its own block. The positives then set the windows for negatives. Anchors travel in chunks, in the same order. A chunk meets
the zone maps page by page, and only the blocks that come out of it are sent to the tasks of the chunk, likeliest first. There the
bounds are tried again, by anchor and with what is found by then. A task keeps the best few rows of each window, so what it
returns grows with anchors and not with blocks. Nothing passes through the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from wikiloom.llm.common import arrow_map, shuffle_partitions
from wikiloom.session import staged

#: Rows of a block, anchors of a chunk, zone maps of a page.
BLOCK, CHUNK, PAGE = 2048, 2048, 4096

#: Bits of each dimension in the place on the curve.
CURVE_BITS = 4

#: Zone maps tried at once against a chunk.
_TRIED = 256

_LEAST, _MOST = -(1 << 62), 1 << 62


# -- the curve -------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve as rows of bytes, most significant first.

    ``cells`` has a row per point, of numbers below 2**bits. Each lower bit of a point is read in the frame that the bits above
    it turn it to; then the Gray code gives the order.
    """
    points = np.ascontiguousarray(cells.T).astype(np.uint8)
    dims = len(points)
    if not dims:
        return np.zeros((len(cells), 0), dtype=np.uint8)
    first = points[0]
    for bit in range(bits - 1, 0, -1):
        low = np.uint8((1 << bit) - 1)
        for axis in points:
            is_set = (axis >> bit & 1).astype(bool)
            swapped = np.where(is_set, 0, (first ^ axis) & low).astype(np.uint8)
            axis ^= swapped
            first ^= np.where(is_set, low, swapped).astype(np.uint8)
    for i in range(1, dims):
        points[i] ^= points[i - 1]
    turned = np.zeros_like(first)
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where(points[-1] >> bit & 1, np.uint8((1 << bit) - 1), np.uint8(0))
    points ^= turned
    planes = np.stack([points >> bit & 1 for bit in range(bits - 1, -1, -1)])
    return np.packbits(planes.reshape(bits * dims, -1).T, axis=1)


# -- matrices in columns ---------------------------------------------------------------


def _bytes(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they all fit in."""
    most = int(np.abs(values).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return values.astype(kind).tobytes()


def _matrix(data: bytes, rows: int, dims: int) -> np.ndarray:
    if not rows * dims:
        return np.zeros((rows, dims), dtype=np.int64)
    return np.frombuffer(data, dtype=f"<i{len(data) // (rows * dims)}").reshape(rows, dims).astype(np.int64)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both."""
    bound = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 56:
        return left @ right.T
    raise OverflowError("inner products beyond 2**56")


def bounds(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with anything inside each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, least) + products(down, most), products(up, most) + products(down, least)


BLOCKS = "place long, dims int, n int, rows binary, ids binary, labels binary, marks binary, q binary, least binary, most binary, low_label long, high_label long"


def _blocks(ordered: DataFrame) -> DataFrame:
    """Blocks of rows ``row, id, label, is_anchor, dims, q`` in the order given, per task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def block(parts: list[tuple]) -> pa.RecordBatch:
            nonlocal made
            rows, ids, labels, marks = (np.concatenate([p[i] for p in parts]) for i in range(4))
            q = np.concatenate([p[4] for p in parts])
            values = [
                base + made, q.shape[1], len(q), rows.tobytes(), ids.tobytes(), labels.tobytes(), marks.astype(np.uint8).tobytes(),
                _bytes(q), q.min(axis=0).tobytes(), q.max(axis=0).tobytes(), int(labels.min()), int(labels.max()),
            ]
            made += 1
            names = [field.split()[0] for field in BLOCKS.split(", ")]
            kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
            types = [kinds[field.split()[1]] for field in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        def size() -> int:
            return sum(len(p[4]) for p in held)

        for batch in batches:
            flat = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]]
            lists = batch.column(5)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(flat[4], dtype=np.int64)])
            turns = [0, *(np.flatnonzero(np.diff(flat[4])) + 1).tolist(), batch.num_rows]
            for a, b in zip(turns, turns[1:]):
                dims = int(flat[4][a]) if a < b else 0
                if held and a < b and held[0][4].shape[1] != dims:
                    yield block(held)
                    held = []
                while a < b:
                    end = min(b, a + BLOCK - size())
                    q = values[offsets[a] : offsets[end]].reshape(end - a, dims)
                    held.append((*[f[a:end] for f in flat[:4]], q))
                    a = end
                    if size() == BLOCK:
                        yield block(held)
                        held = []
        if held:
            yield block(held)

    return arrow_map(ordered.select("row", "id", "label", "is_anchor", "dims", "q"), cut, BLOCKS)


def _anchors(blocks: DataFrame, positives: int) -> DataFrame:
    """Anchors with the score of the worst of the positives in their own block, if there are enough."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                chosen = np.flatnonzero(np.frombuffer(b["marks"], dtype=np.uint8))
                if not len(chosen):
                    continue
                q, labels = _matrix(b["q"], b["n"], b["dims"]), _longs(b["labels"])
                scores = products(q[chosen], q)
                scores[labels[chosen][:, None] != labels[None, :]] = _LEAST
                scores[np.arange(len(chosen)), chosen] = _LEAST
                place = max(b["n"] - positives, 0)
                floors = np.partition(scores, place, axis=1)[:, place] if b["n"] >= positives else np.full(len(chosen), _LEAST)
                columns = [
                    pa.array(np.full(len(chosen), b["place"])), pa.array(_longs(b["rows"])[chosen]), pa.array(_longs(b["ids"])[chosen]),
                    pa.array(labels[chosen]), pa.array(np.full(len(chosen), b["dims"], dtype=np.int32)),
                    pa.array([x.tobytes() for x in q[chosen]], pa.binary()), pa.array(floors),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "row", "id", "label", "dims", "q", "floor"])

    return arrow_map(blocks, pick, "place long, row long, id long, label long, dims int, q binary, floor long")


CHUNKS = "chunk long, dims int, n int, rows binary, labels binary, q binary, lows binary, highs binary"


def _chunks(anchors: DataFrame) -> DataFrame:
    """Chunks of anchors ``place, row, label, dims, q, lows, highs``, each with as many windows as its widest anchor.

    A window that an anchor lacks is one that nothing fits.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[dict] = []

        def chunk() -> pa.RecordBatch:
            nonlocal made
            windows = max(len(r["lows"]) for r in held)
            lows = np.array([r["lows"] + [_MOST] * (windows - len(r["lows"])) for r in held], dtype=np.int64)
            highs = np.array([r["highs"] + [_LEAST] * (windows - len(r["highs"])) for r in held], dtype=np.int64)
            q = np.stack([_longs(r["q"]) for r in held])
            rows, labels = (np.array([r[c] for r in held], dtype=np.int64) for c in ("row", "label"))
            values = [[base + made], [held[0]["dims"]], [len(held)], *[[v] for v in (rows.tobytes(), labels.tobytes(), _bytes(q), lows.tobytes(), highs.tobytes())]]
            made += 1
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[f.split()[0] for f in CHUNKS.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == CHUNK or held[0]["dims"] != row["dims"]):
                    yield chunk()
                    held = []
                held.append(row)
        if held:
            yield chunk()

    ordered = anchors.repartitionByRange("dims", "place", "row").sortWithinPartitions("dims", "place", "row")
    return arrow_map(ordered.select("row", "label", "dims", "q", "lows", "highs"), cut, CHUNKS)


def _reading(chunks: DataFrame, blocks: DataFrame, same: bool, spread: int) -> DataFrame:
    """``chunk, place, reach``: blocks that some anchor of the chunk must read, with the greatest score they may hold."""
    zones = blocks.select("place", "dims", "least", "most", "low_label", "high_label")
    page = F.struct("dims", F.shiftright("place", 32).alias("part"), F.floor(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)) / PAGE).alias("page"))
    pages = zones.groupBy(page.alias("page")).agg(F.collect_list(F.struct("place", "least", "most", "low_label", "high_label")).alias("zones"))
    pages = staged(pages.select("page.dims", F.pmod(F.xxhash64("page"), F.lit(spread)).alias("slot"), "zones"), "pages")
    met = chunks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<long>")))
    met = met.join(pages, ["dims", "slot"]).select("chunk", "dims", "n", "labels", "q", "lows", "highs", "zones")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                q, labels = _matrix(m["q"], m["n"], m["dims"]), _longs(m["labels"])
                lows, highs = (_longs(m[c]).reshape(m["n"], -1) for c in ("lows", "highs"))
                for i in range(0, len(m["zones"]), _TRIED):
                    zones = m["zones"][i : i + _TRIED]
                    least, most = (np.stack([_longs(z[c]) for z in zones]) for c in ("least", "most"))
                    low, high = bounds(q, least, most)
                    fits = np.zeros(low.shape, dtype=bool)
                    for w in range(lows.shape[1]):
                        fits |= (high >= lows[:, w, None]) & (low <= highs[:, w, None])
                    first, last = (np.array([z[c] for z in zones], dtype=np.int64) for c in ("low_label", "high_label"))
                    inside = (first <= labels[:, None]) & (labels[:, None] <= last)
                    fits &= inside if same else ~(inside & (first == last))
                    reach = np.where(fits, high, _LEAST).max(axis=0)
                    needed = np.flatnonzero(fits.any(axis=0))
                    places = np.array([z["place"] for z in zones], dtype=np.int64)
                    columns = [np.full(len(needed), m["chunk"]), places[needed], reach[needed]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "place", "reach"])

    return arrow_map(met, choose, "chunk long, place long, reach long")


def _best(anchors: DataFrame, blocks: DataFrame, pages: int, same: bool, count: int) -> DataFrame:
    """``row, window, rank, score, id``: of each anchor and window the best ``count`` rows, of the same label or of others."""
    spark = anchors.sparkSession
    parallel = shuffle_partitions(spark)
    chunks = staged(_chunks(anchors), "chunks")
    pairs = staged(_reading(chunks, blocks, same, max(1, min(parallel, pages))), "reading")
    # Few chunks are dealt to several tasks each, by blocks.
    slices = max(1, -(-2 * parallel // max(chunks.count(), 1)))
    own = pairs.join(blocks.select("place", "dims", "n", "rows", "ids", "labels", "q", "least", "most"), "place").select(
        "chunk", F.pmod(F.xxhash64("place"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), (-F.col("reach")).alias("turn"),
        "dims", "n", "rows", "ids", "labels", "q", F.col("least").alias("a"), F.col("most").alias("b"),
    )
    asking = chunks.join(pairs.select("chunk").distinct(), "chunk", "left_semi").select(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("turn"),
        "dims", "n", "rows", F.lit(None).cast("binary").alias("ids"), "labels", "q", F.col("lows").alias("a"), F.col("highs").alias("b"),
    )
    work = asking.unionByName(own).repartition(parallel, "chunk", "slice").sortWithinPartitions("chunk", "slice", "kind", "turn")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Search | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                # One row at a time: a batch of blocks unpacked at once would be large.
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["kind"] == 0:
                    if state is not None:
                        yield state.result()
                    state = _Search(row, same, count)
                else:
                    state.read(row)
        if state is not None:
            yield state.result()

    found = arrow_map(work, search, "row long, window int, score long, id long")
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


class _Search:
    """The best rows so far of each window of a chunk of anchors."""

    def __init__(self, chunk: dict, same: bool, count: int):
        n = chunk["n"]
        self.same, self.count = same, count
        self.rows, self.labels = _longs(chunk["rows"]), _longs(chunk["labels"])
        self.q = _matrix(chunk["q"], n, chunk["dims"])
        self.floors = _longs(chunk["a"]).reshape(n, -1).copy()
        self.highs = _longs(chunk["b"]).reshape(n, -1)
        self.found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def read(self, block: dict) -> None:
        dims = block["dims"]
        low, high = bounds(self.q, _longs(block["a"]).reshape(1, dims), _longs(block["b"]).reshape(1, dims))
        asking = np.flatnonzero(((high >= self.floors) & (low <= self.highs)).any(axis=1))
        if not len(asking):
            return
        ids, labels = _longs(block["ids"]), _longs(block["labels"])
        scores = products(self.q[asking], _matrix(block["q"], block["n"], dims))
        fits = (labels[None, :] == self.labels[asking][:, None]) == self.same
        fits &= _longs(block["rows"])[None, :] != self.rows[asking][:, None]
        for w in range(self.floors.shape[1]):
            inside = fits & (scores >= self.floors[asking, w, None]) & (scores <= self.highs[asking, w, None])
            for i in np.flatnonzero(inside.any(axis=1)).tolist():
                chosen = np.flatnonzero(inside[i])
                self._add(int(asking[i]), w, scores[i, chosen], ids[chosen])

    def _add(self, anchor: int, window: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if (anchor, window) in self.found:
            before = self.found[anchor, window]
            scores, ids = np.concatenate([before[0], scores]), np.concatenate([before[1], ids])
        best = np.lexsort((ids, -scores))[: self.count]
        self.found[anchor, window] = scores[best], ids[best]
        if len(best) == self.count:
            self.floors[anchor, window] = scores[best[-1]]

    def result(self) -> pa.RecordBatch:
        found = [(self.rows[a], w, s, i) for (a, w), (scores, ids) in self.found.items() for s, i in zip(scores.tolist(), ids.tolist())]
        columns = list(zip(*found)) if found else [[], [], [], []]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["row", "window", "score", "id"])


def _windows(positives: DataFrame, low: int, high: int) -> DataFrame:
    """``row, lows, highs`` of the windows that an anchor's positives set, in their order."""
    ranked = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("own"))

    def least(p: Column) -> Column:
        return -F.floor(-p.score * low / F.lit(100).cast("decimal(3,0)")).cast("long")

    def most(p: Column) -> Column:
        return F.floor(p.score * high / F.lit(100).cast("decimal(3,0)")).cast("long")

    return ranked.select("row", F.transform("own", least).alias("lows"), F.transform("own", most).alias("highs"))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "q", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has whole-numbered ``id`` and ``label`` and vectors of whole numbers. A row's score is its inner product with the anchor; higher
    scores come first, ties by smaller id. An anchor's positives are its first other rows of the same label. For each of
    them, its negatives are the first rows of other labels with a score of ``low`` to ``high`` percent of the positive's.

    Rows without id, label or vector take no part. Rows are told apart as rows, so a repeated row may be
    the positive of its copy, and each copy of an anchor is one. Vectors of another length than the anchor's have no score with it. Inner products must stay below
    2**56. Other columns are not read. Without anchors, or without rows, there is no result.
    """
    given = rows.select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        F.size(vector).alias("dims"), F.col(vector).cast("array<long>").alias("q"),
    ).filter("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    span = given.agg(F.min(F.array_min("q")).alias("least"), F.max(F.array_max("q")).alias("most")).first()
    least, most = span["least"] or 0, span["most"] or 0
    width = max(most - least, 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            values = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(dims, dtype=np.int64)])
            cells = ((values - least) / width * ((1 << CURVE_BITS) - 1) + 0.5).astype(np.uint8)
            keys: list[bytes] = [b""] * len(dims)
            for size in np.unique(dims).tolist():
                own = np.flatnonzero(dims == size)
                table = cells[(offsets[own][:, None] + np.arange(size)[None, :])] if size else np.zeros((len(own), 0), dtype=np.uint8)
                for i, key in zip(own.tolist(), hilbert_keys(table, CURVE_BITS)):
                    keys[i] = key.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])

    placed = arrow_map(given, keyed, "id long, label long, is_anchor boolean, dims int, q array<long>, key binary")
    placed = staged(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
    # The number of the row parts equal vectors, so no vector is one task's work.
    ordered = placed.repartitionByRange("dims", "key", "row").sortWithinPartitions("dims", "key", "row")
    blocks = staged(_blocks(ordered), "blocks")
    pages = blocks.agg(F.count_distinct("dims", F.shiftright("place", 32), F.floor(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)) / PAGE))).first()[0]
    anchors = staged(_anchors(blocks, positives), "anchors")

    asking = anchors.withColumns({"lows": F.array("floor"), "highs": F.array(F.lit(_MOST))})
    near = staged(_best(asking, blocks, pages, same=True, count=positives), "positives")
    asking = anchors.join(staged(_windows(near, low, high), "windows"), "row")
    far = staged(_best(asking, blocks, pages, same=False, count=negatives), "negatives")
    chosen = near.select("row", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        far.join(chosen, ["row", "window"])
        .join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
