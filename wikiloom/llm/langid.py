"""Language identification by character n-grams.

Multinomial logistic regression on hashed TF-IDF n-grams. Document frequencies are counted over
all training rows. The weights are learnt from a bounded sample of them by follow the
regularised leader with an elastic net, which leaves most weights at zero, and a temperature
fitted on rows kept out of that makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from wikiloom.llm.common import U64, arrow_map, fields, mix

UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 20


@dataclass
class Settings:
    """``sample`` bounds the rows that weights are learnt from, ``languages`` their labels."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    sample: int = 3000
    languages: int = 500
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01
    calibration: float = 0.2


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings = field(default_factory=Settings)


def term_counts(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text and how often each occurs."""
    total = np.zeros(1 << settings.bits, dtype=np.int64)
    overlap = max(settings.orders) - 1
    lowered = text.lower()
    for at in range(0, max(len(lowered) - overlap, 1), _CHUNK):
        codes = np.frombuffer(
            lowered[at : at + _CHUNK + overlap].encode("utf-32-le", "surrogatepass"), dtype=np.uint32
        ).astype(U64)
        last = at + _CHUNK + overlap >= len(lowered)
        gram = np.zeros_like(codes)
        for n in range(1, overlap + 2):
            gram = gram[: len(codes) - n + 1] * U64(0x100000001B3) + codes[n - 1 :] + U64(1)
            if n in settings.orders:
                used = gram if last else gram[:_CHUNK]
                hashed = mix(used + U64(n << 56)) >> U64(64 - settings.bits)
                total += np.bincount(hashed.astype(np.int64), minlength=len(total))
    places = np.flatnonzero(total)
    return places, total[places]


def _features(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[places]
    norm = np.sqrt(values @ values)
    return values / norm if norm else values


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; the last place of ``z`` and ``n`` is the bias."""
    size = 1 << s.bits
    z, n = np.zeros((size + 1, labels)), np.zeros((size + 1, labels))

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * s.l1 - z[at]
        return np.where(np.abs(z[at]) <= s.l1, 0.0, shrunk / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for places, values, label in rows:
            at = np.append(places, size)
            x = np.append(values, 1.0)[:, None]
            w = weights(at)
            error = _softmax((w * x).sum(axis=0))
            error[label] -= 1
            gradient = x * error
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / s.alpha
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    w = weights(slice(None))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(10), 120))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", settings: Settings | None = None) -> Model | None:
    """A model from all rows with a language and a letter in the text; None if there are none.

    Counts cover all rows. The sample takes about as many texts of each language, chosen by a
    hash of the text, each text once, and ``settings.sample`` rows at most. There may be
    ``settings.languages`` languages at most; more raise a ValueError.
    """
    s = settings or Settings()
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    tally = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.count_distinct(F.xxhash64("text")).alias("texts"))
    tally = tally.limit(s.languages + 1).collect()
    counted = {r["lang"]: r["rows"] for r in tally}
    if not counted:
        return None
    if len(counted) > s.languages:
        raise ValueError(f"more than {s.languages} languages")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << s.bits, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total[term_counts(t, s)[0]] += 1
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(total[places])], names=["place", "n"])

    found = arrow_map(rows.select("text"), frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(1 << s.bits)
    frequency[found["place"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=float)
    idf = np.log((1 + sum(counted.values())) / (1 + frequency)) + 1

    share = s.sample / len(counted)
    buckets = 1 << 30
    cut = F.create_map(*[x for k, n in ((r["lang"], r["texts"]) for r in tally) for x in (F.lit(k), F.lit(int(min(1.0, share / n) * buckets)))])
    sample = rows.withColumn("h", F.xxhash64("text")).filter(F.pmod("h", F.lit(buckets)) < cut[F.col("lang")])
    # Copies of a text share its hash; one of them is drawn.
    sample = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [term_counts(t, s) for t in batch.column(1).to_pylist()]
            places = pa.array([p.astype(np.int32) for p, _ in each], pa.list_(pa.int32()))
            counts = pa.array([c.astype(np.int32) for _, c in each], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), places, counts], names=["lang", "h", "places", "counts"])

    drawn = arrow_map(sample.select("lang", "text", "h"), terms, "lang string, h long, places array<int>, counts array<int>").collect()
    languages = sorted(counted)
    number = {k: i for i, k in enumerate(languages)}
    # What is fetched is the bound on average; what is over it goes.
    drawn = sorted(drawn, key=lambda r: (r["h"], r["lang"]))[: s.sample]
    examples = []
    for r in drawn:
        places = np.array(r["places"], dtype=np.int64)
        examples.append((places, _features(places, np.array(r["counts"]), idf), number[r["lang"]]))
    step = max(2, round(1 / s.calibration))
    kept = [e for i, e in enumerate(examples) if i % step == 0] if len(examples) >= 10 * step else []
    learnt = [e for i, e in enumerate(examples) if i % step] if kept else examples
    weights, bias = _follow_the_leader(learnt, len(languages), s)
    logits = np.array([v @ weights[p] + bias for p, v, _ in kept])
    temperature = _temperature(logits, np.array([label for _, _, label in kept], dtype=int))
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), bias, temperature, s)


def predict(text: str | None, model: Model | None) -> tuple[str, float]:
    """Language and its probability; ``und`` and 0 without text, letter or model."""
    if model is None or not text or not _LETTER.search(text):
        return UNKNOWN, 0.0
    places, counts = term_counts(text, model.settings)
    logits = _features(places, counts, model.idf) @ model.weights[places] + model.bias
    p = _softmax(logits / model.temperature)
    best = int(np.argmax(p))
    return model.languages[best], float(p[best])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    The whole text is read. A NULL text, or one without a letter, is ``und`` with score 0. Equal
    texts get equal predictions. Ties go to the language that sorts first. No row is lost.
    """
    # Bounded by the settings: weights of 2**bits terms for at most ``languages`` labels.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index(text)
    schema = fields(kept.schema, "lang_pred string, score double")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [predict(t, model) for t in batch.column(place).to_pylist()]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(kept, label, schema)
