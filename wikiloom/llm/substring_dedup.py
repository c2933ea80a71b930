"""Repeated passages by phrase automata.

A window is ``WINDOW`` words in a row; each holds a phrase of ``PHRASE`` words that stands for
it (see ``anchors``). Phrases that recur are confirmed first. Each batch of documents then
is a shard: its recurring phrases are compiled into an Aho-Corasick automaton, and its
documents are streamed through that to locate every occurrence. Windows around located phrases
are counted exactly, and the words of those that recur are removed. Equal texts are told by
their hash and give their windows once, as recurring ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wikiloom.llm.anchors import SEEN, recurring
from wikiloom.llm.common import WHITE, Rolling, arrow_map, byte_class, covered, fields, minimisers, settled, word_bounds
from wikiloom.session import delete, scratch_folder

WINDOW = 35
PHRASE = 12

_WORD = byte_class(WHITE)


def word_hashes(data: bytes, rolling: Rolling) -> np.ndarray:
    array = np.frombuffer(data, dtype=np.uint8)
    return rolling.words(array, *word_bounds(array, _WORD))


def _automaton(phrases: set[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase in phrases:
        automaton.add_word(phrase, True)
    automaton.make_automaton()
    return automaton


def _spaced(words: list[bytes]) -> str:
    """Words with one space around each, so phrases match whole words."""
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "


def _located(automaton: ahocorasick.Automaton, text: str, phrase: int) -> np.ndarray:
    """Numbers of the words where phrases start."""
    ends = np.fromiter((end for end, _ in automaton.iter(text)), dtype=np.int64)
    if not len(ends):
        return ends
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.unique(np.searchsorted(np.flatnonzero(codes == 0x20), ends)) - phrase


def candidates(rows: DataFrame, window: int, phrase: int, text: str) -> DataFrame:
    """``rows`` without anchors, with ``__hashes, __starts`` of the windows around located phrases.

    A copied text gives its windows where a task meets it first, and no starts.
    """
    kept = rows.drop("__anchors")
    wanted = [*[kept.columns.index(c) for c in (text, "__key", "__copied")], len(kept.columns)]
    schema = fields(kept.schema, "n_words long, __hashes array<long>, __starts array<int>")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        seen: set[int] = set()
        for batch in batches:
            documents, phrases = [], set()
            for t, key, copied, anchors in zip(*[batch.column(i).to_pylist() for i in wanted]):
                data = (t or "").encode("utf-8", "surrogatepass")
                words = data.split()
                runs = None
                if anchors and key not in seen:
                    if copied:
                        seen = seen if len(seen) < SEEN else set()
                        seen.add(key)
                    hashes = word_hashes(data, rolling)
                    grams = rolling.grams(hashes, phrase)
                    places, distinct = minimisers(grams, window - phrase + 1)
                    known = np.array(anchors, dtype=np.int64).view(np.uint64)
                    for at in distinct[np.isin(grams[distinct], known)].tolist():
                        phrases.add(_spaced(words[at : at + phrase]))
                    runs = hashes, places
                documents.append((words, runs, copied))
            automaton = _automaton(phrases) if phrases else None
            n_words, hashes_out, starts_out = [], [], []
            for words, runs, copied in documents:
                n_words.append(len(words))
                starts = np.zeros(0, dtype=np.int64)
                found = np.zeros(0, dtype=np.int64)
                if runs is not None and automaton is not None:
                    starts = np.flatnonzero(np.isin(runs[1], _located(automaton, _spaced(words), phrase)))
                    found = rolling.ranges(rolling.prefix(runs[0]), starts, starts + window).view(np.int64)
                hashes_out.append(found)
                starts_out.append(starts[: 0 if copied else None].astype(np.int32))
            columns = [*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(hashes_out, pa.list_(pa.int64())), pa.array(starts_out, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(rows.select(*kept.columns, "__anchors"), locate, schema)


def _cut(data: bytes, removed: np.ndarray) -> str:
    """The text without removed words and what stands between neighbouring ones."""
    starts, ends = word_bounds(np.frombuffer(data, dtype=np.uint8), _WORD)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], removed.astype(np.int8), [0]))))
    kept, place = [], 0
    for first, last in zip(edges[::2], edges[1::2] - 1):
        kept.append(data[place : starts[first]])
        place = ends[last]
    kept.append(data[place:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def find_repeats(
    docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id: str = "doc_id", text: str = "text", with_text: bool = False
) -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept_sha256``, and ``clean_text`` if wanted.

    Words are cut at ASCII white space. A word is removed if it lies in a window whose words
    also start elsewhere, in this document or another; all occurrences go. ``kept_sha256``
    is of the kept words joined by one space; ``clean_text`` keeps the white space of the text.
    NULL and empty texts have no words. Rows that repeat an id and a text are documents of their
    own, so their windows recur. No row is lost; columns of the new names are replaced.
    """
    added = ["n_words", "n_removed", "kept_sha256", *["clean_text"] * with_text]
    kept = docs.drop(*added)
    rows = kept.withColumn("__key", F.xxhash64(F.col(text)))
    spark = docs.sparkSession
    with scratch_folder(spark, "phrases", keep=True) as phrases:
        anchors = recurring(rows, word_hashes, window, phrase, text, once=True)
    copies = rows.groupBy("__key").count().filter("count > 1").select("__key", F.lit(True).alias("__copied"))
    joined = rows.join(anchors.join(copies, "__key", "full"), "__key", "left")
    located = candidates(joined.withColumn("__copied", F.coalesce("__copied", F.lit(False))), window, phrase, text)
    found = settled(located, "windows")
    delete(spark, phrases)
    times = F.when(F.col("__copied"), 2).otherwise(1)
    again = found.select(times.alias("times"), F.explode("__hashes").alias("__hashes")).groupBy("__hashes").agg(F.sum("times").alias("times"))
    again = again.filter("times > 1").select("__hashes")
    windows = found.filter("NOT __copied").select("__key", F.explode(F.arrays_zip("__hashes", "__starts")).alias("w")).select("__key", "w.__hashes", "w.__starts")
    repeated = windows.join(again, "__hashes", "left_semi").groupBy("__key").agg(F.collect_set("__starts").alias("__removed"))
    touched = F.size("__starts") > 0
    plain = [*[F.col(c) for c in kept.columns], "n_words", "__copied"]
    apart = found.filter(touched).select("__key", *plain).join(settled(repeated, "repeats"), "__key", "left").select(*plain, "__removed")
    whole = found.filter(~touched).select(*plain, F.lit(None).cast("array<int>").alias("__removed"))
    place = kept.columns.index(text)
    schema = fields(kept.schema, "n_words long, n_removed long, kept_sha256 string" + ", clean_text string" * with_text)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, clean = [], [], []
            for t, copied, starts in zip(batch.column(place).to_pylist(), *[c.to_pylist() for c in batch.columns[-2:]]):
                data = (t or "").encode("utf-8", "surrogatepass")
                words = data.split()
                removed = np.full(len(words), copied and len(words) >= window)
                if starts:
                    removed = covered(np.array(starts, dtype=np.int64), window, len(words))
                if removed.any():
                    words = [w for w, r in zip(words, removed.tolist()) if not r]
                counts.append(int(removed.sum()))
                hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if with_text:
                    clean.append(_cut(data, removed) if removed.any() else t)
            columns = [*batch.columns[:-2], pa.array(counts, pa.int64()), pa.array(hashes, pa.string())]
            if with_text:
                columns.append(pa.array(clean, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(apart.unionByName(whole), remove, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, **options) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; a document that nothing is left of goes."""
    found = find_repeats(docs, window, phrase, with_text=True, **options)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))
    return found.filter(~emptied).withColumn("text", F.col("clean_text")).select(*docs.columns)
