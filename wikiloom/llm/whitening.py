"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The fit list, each distinct vector once, is stored as blocks of rows. One step takes a right vector v and
makes, block by block, u = Xv and Xᵀu of the centred rows; a task returns one vector of
as many numbers as there are dimensions. A left vector has as many entries as there are rows, so
it is never stored: it is always X times a short vector p, and p, with Xᵀu, is what the driver keeps. All products with
earlier left vectors follow from them, so both sides are reorthogonalised in full (twice) on short vectors,
and the data are read once a step. The result is X V = U B with an upper bidiagonal B as small as the
number of dimensions. Its singular vectors and values give components and deviations.

Steps go on until V spans all dimensions. A single start misses directions of equal deviation; where a chain ends
early, another start orthogonal to all of V is taken, so none is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.llm.common import arrow_map, fields
from wikiloom.session import staged

COMPONENTS = 16

#: Components with less of the largest variance than this are rounding, not data.
NEGLIGIBLE = 1e-12

#: Of the largest deviation: what is left of a new left or right vector when nothing is left but rounding. A left
#: one comes from squares, so less of it can be told from rounding.
_TINY_LEFT, _TINY_RIGHT = 1e-7, 1e-12


def is_complete(vector: str | Column) -> Column:
    """Whether a vector is there and has no null and no non-finite entry."""
    column = F.col(vector) if isinstance(vector, str) else vector
    whole = F.forall(column, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(whole, F.lit(False))


def stepped(vector: str, scale: int, shift: int = 0) -> Column:
    """Entries as whole numbers: floor(scale * entry) + shift."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with their ``sums``, and per component a unit vector, its variance and its share of all."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, values: np.ndarray) -> np.ndarray:
        return (values * self.n - self.sums) / self.n

    def apply(self, values: np.ndarray) -> np.ndarray:
        return self.centred(values) @ self.components.T / np.sqrt(self.variances)

    def deviations(self, values: np.ndarray) -> list[int]:
        """Exact sums of squares of n * x - S."""
        off = values * self.n - self.sums
        most = int(np.abs(off).max(initial=0))
        if most * most * max(off.shape[1], 1) < 1 << 63:
            return (off * off).sum(axis=1).tolist()
        wide = off.astype(object)
        return [int(x) for x in (wide * wide).sum(axis=1)]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _packed(rows: DataFrame, dims: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column(0), dims)
                yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["block"])

    return arrow_map(rows.select("x"), pack, "block binary")


def _total(blocks: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum of ``part`` of all blocks: each task returns its own sum. None without blocks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                own = part(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, dims))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([str(total.dtype)])], names=["total", "kind"])

    parts = [np.frombuffer(bytes(r[0]), dtype=r[1]) for r in arrow_map(blocks, add, "total binary, kind string").collect()]
    return np.sum(parts, axis=0) if parts else None


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V, a row each, and B of X V = U B; ``product`` gives Xᵀ(Xv)."""
    random = np.random.default_rng(0)
    rights = np.zeros((0, dims))
    # Left vectors u as p with u = Xp, and Xᵀu.
    lefts, images = np.zeros((0, dims)), np.zeros((0, dims))
    small = np.zeros((dims, dims))
    largest = 0.0

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - rights.T @ (rights @ v)
        return v

    def start() -> np.ndarray:
        v = orthogonal(random.standard_normal(dims))
        v /= np.linalg.norm(v)
        v = orthogonal(v)
        return v / np.linalg.norm(v)

    def apart(left: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """X left without the left vectors so far, with its image and length."""
        for _ in range(2):
            known = lefts @ image
            left, image = left - lefts.T @ known, image - images.T @ known
        return left, image, float(np.sqrt(max(left @ image, 0.0)))

    v = start()
    for k in range(dims):
        image, left = product(v), v
        rights = np.vstack([rights, v])
        whole = float(np.sqrt(max(v @ image, 0.0)))
        largest = max(largest, whole)
        left, image, alpha = apart(left, image)
        if alpha < 0.1 * whole:
            # Little is left of Xv, and of its digits, so its product is made anew.
            left, image, alpha = apart(left, product(left))
        if alpha <= _TINY_LEFT * largest:
            # Xv lies in the span of the left vectors.
            alpha, left, image = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            left, image = left / alpha, image / alpha
        lefts, images = np.vstack([lefts, left]), np.vstack([images, image])
        small[k, k] = alpha
        if k + 1 < dims:
            onward = orthogonal(image - alpha * v)
            beta = float(np.linalg.norm(onward))
            if beta <= _TINY_RIGHT * largest:
                v = start()
            else:
                small[k, k + 1] = beta
                v = orthogonal(onward / beta)
                v /= np.linalg.norm(v)
    return rights, small


def usual_length(rows: DataFrame, vector: str) -> int | None:
    """The most frequent length of vectors, of two the larger; None without rows."""
    sizes = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return sizes["size"] if sizes else None


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors, whole numbers all of one length; None if they do not vary."""
    dims = usual_length(rows, vector)
    if not dims:
        return None
    distinct = rows.filter(F.size(vector) == dims).select(F.col(vector).alias("x")).distinct()
    blocks = staged(_packed(distinct, dims), "vectors")
    sums = _total(blocks, dims, lambda x: np.append(x.sum(axis=0), len(x)))
    n, sums = int(sums[-1]), sums[:-1].copy()

    def centred(x: np.ndarray) -> np.ndarray:
        return (x * n - sums) / n

    spread = float(_total(blocks, dims, lambda x: np.array([np.square(centred(x)).sum()]))[0])
    if spread == 0:
        return None

    def product(v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            own = centred(x)
            return own.T @ (own @ v)

        return _total(blocks, dims, part)

    rights, small = bidiagonalise(product, dims)
    _, deviations, turns = np.linalg.svd(small)
    variances = deviations**2 / n
    kept = min(components, int((variances > NEGLIGIBLE * variances[0]).sum()))
    axes = turns[:kept] @ rights
    axes /= np.linalg.norm(axes, axis=1, keepdims=True)
    model = Whitening(n, sums, axes, variances[:kept], variances[:kept] * n / spread, float("nan"))

    def covariance(x: np.ndarray) -> np.ndarray:
        own = model.apply(x)
        return np.append(own.T @ own, own.sum(axis=0))

    found = _total(blocks, dims, covariance)
    mean = found[-kept:] / n
    error = np.abs(found[:-kept].reshape(kept, kept) / n - np.outer(mean, mean) - np.eye(kept)).max()
    return Whitening(n, sums, axes, variances[:kept], model.explained, float(error))


def whiten(rows: DataFrame, model: Whitening | None, vector: str) -> DataFrame:
    """``rows`` without their vectors, with ``whitened`` (one number per component) and ``deviation`` (sum of (n * x - S) ** 2).

    Rows whose vector has another length than the model's give no row. A model of None gives no rows.
    """
    others = [c for c in rows.columns if c != vector]
    kept = rows.select(F.struct(*others).alias("row"), F.col(vector).alias("x"))
    shape = fields(kept.schema["row"], "whitened array<double>, deviation decimal(38,0)")
    if model is None:
        empty = kept.filter("false").select("row", F.lit(None).cast("array<double>").alias("whitened"), F.lit(None).cast("decimal(38,0)").alias("deviation"))
        return empty.select(*[F.col(f"row.{c}").alias(c) for c in others], "whitened", "deviation")
    dims = model.components.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(1), dims)
            white = model.apply(values)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), white.shape[1]).cast(pa.list_(pa.float64()))
            exact = pa.array([Decimal(d) for d in model.deviations(values)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, exact], names=["row", "whitened", "deviation"])

    found = arrow_map(kept.filter(F.size("x") == dims), apply, shape)
    return found.select(*[F.col(f"row.{c}").alias(c) for c in others], "whitened", "deviation")


def fit_and_whiten(rows: DataFrame, vector: str, components: int = COMPONENTS) -> DataFrame:
    """One row per row and component: the other columns, and ``component, n, deviation, whitened, explained, identity_error``.

    ``rows`` has complete vectors of whole numbers (see ``is_complete``, ``stepped``). Each distinct vector counts once in the fit, and each
    row, repeats included, is whitened. Only the most frequent length of vectors takes part. Components that
    do not vary are left out, so a table of one distinct vector, like an empty one, gives no rows; fewer dimensions than ``components``
    give fewer. Any other column may be NULL. Numbers are meant to be below 2**31 times the number of rows below 2**31.
    """
    model = fit(rows, vector, components)
    found = whiten(rows, model, vector)
    others = [c for c in rows.columns if c != vector]
    long = found.select(*others, "deviation", F.posexplode("whitened").alias("place", "value"))
    shares = F.array(*[F.lit(float(x)) for x in (model.explained if model else [])]).cast("array<double>")
    return long.select(
        *others, (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.get(shares, F.col("place")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).cast("double").alias("identity_error"),
    )
