"""Benchmark decontamination by a generalised suffix automaton.

The automaton holds every run of words of every item. A document's words are fed to it, and
at each word it knows the longest run that ends there and occurs in an item. Where that
is as long as the limit, the words are a hit, and the automaton's state tells in which items
the run occurs. Only stretches whose short runs all occur in items are fed to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wikiloom.llm.common import arrow_map, byte_class, fields, word_bounds
from wikiloom.session import staged

WINDOW = 10

#: Words of items in one automaton. Benchmarks beyond it are split into several, and each
#: document meets them one after the other.
AUTOMATON_WORDS = 50_000

#: Automata that a task holds at once; more take another pass over the documents.
TOGETHER = 4

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(
    0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)
_SEPARATORS = bytes(b for b in range(256) if _TABLE[b] == 0x20)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """A generalised suffix automaton over the words of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        texts = []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if words:
                texts.append((item, words))
                last = 0
                for word in words:
                    last = self._extend(last, word)
        # A word run of the limit's length belongs to one state, the first on the way up whose
        # shorter runs lie below the limit.
        states = len(self.next)
        order = sorted(range(1, states), key=self.length.__getitem__)
        self.at_limit = [-1] * states
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.at_limit[s] = self.at_limit[up] if self.length[up] >= window else s
        self.items: list[set[str] | None] = [None] * states
        self.short: list[list[tuple[int, str]]] = [[] for _ in range(states)]
        self.shortest = window
        for item, words in texts:
            self._mark(item, words)
        # Nearest state on the way up that is a whole item shorter than the limit.
        self.short_up = [-1] * states
        for s in order:
            self.short_up[s] = s if self.short[s] else self.short_up[self.link[s]]
        self.q = min(3, self.shortest)
        keys = {self._key(words[i : i + self.q]) for _, words in texts for i in range(len(words) - self.q + 1)}
        self.keys = np.array(sorted(keys), dtype=np.int64)

    def _extend(self, last: int, word: int) -> int:
        following = self.next[last].get(word)
        if following is not None:
            if self.length[following] == self.length[last] + 1:
                return following
            return self._split(last, word, following)
        state = self._new(self.length[last] + 1, {})
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at == -1:
            self.link[state] = 0
        else:
            following = self.next[at][word]
            fits = self.length[following] == self.length[at] + 1
            self.link[state] = following if fits else self._split(at, word, following)
        return state

    def _new(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, at: int, word: int, state: int) -> int:
        copy = self._new(self.length[at] + 1, dict(self.next[state]))
        self.link[copy] = self.link[state]
        self.link[state] = copy
        while at != -1 and self.next[at].get(word) == state:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _mark(self, item: str, words: list[int]) -> None:
        state = 0
        for place, word in enumerate(words, 1):
            state = self.next[state][word]
            if place >= self.window:
                found = self.at_limit[state]
                if self.items[found] is None:
                    self.items[found] = set()
                self.items[found].add(item)
        if len(words) < self.window:
            self.short[state].append((len(words), item))
            self.shortest = min(self.shortest, len(words))

    def _key(self, words) -> int:
        key = 0
        for w in words:
            key = key << 21 | (w + 1 & 0x1FFFFF)
        return key

    def match(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit, and the items whose runs occur."""
        n, q = len(words), self.q
        if n < self.shortest or not len(self.keys):
            return None, set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=n)
        key = np.zeros(n - q + 1, dtype=np.int64)
        for j in range(q):
            key = key << 21 | (ids[j : n - q + 1 + j] + 1)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = np.zeros(len(key) + 2, dtype=np.int8)
        known[1:-1] = self.keys[place] == key
        edges = np.flatnonzero(np.diff(known))
        starts, ends = edges[::2], edges[1::2] + q - 1
        long = ends - starts >= self.shortest
        if not long.any():
            return None, set()
        steps = np.zeros(n + 1, dtype=np.int32)
        items: set[str] = set()
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            self._feed(ids[start:end].tolist(), start, steps, items)
        hit = np.cumsum(steps[:-1]) > 0
        return (hit, items) if items else (None, items)

    def _feed(self, ids: list[int], start: int, steps: np.ndarray, items: set[str]) -> None:
        following, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for end, word in enumerate(ids, start + 1):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            if matched >= window:
                up = link[state]
                at = self.at_limit[up] if length[up] >= window else state
                items |= self.items[at]
                steps[end - window] += 1
                steps[end] -= 1
            at = self.short_up[state]
            while at > 0:
                for size, item in self.short[at]:
                    if size <= matched:
                        items.add(item)
                        steps[end - size] += 1
                        steps[end] -= 1
                at = self.short_up[link[at]] if link[at] > 0 else -1


def _cut(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between neighbouring ones."""
    data = text.encode("utf-8", "surrogatepass")
    starts, ends = word_bounds(np.frombuffer(data, dtype=np.uint8), byte_class(_SEPARATORS))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    kept, place = [], 0
    for first, last in zip(edges[::2], edges[1::2] - 1):
        kept.append(data[place : starts[first]])
        place = ends[last]
    kept.append(data[place:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def _groups(items: DataFrame, id: str, text: str, window: int, limit: int) -> list[DataFrame]:
    """Items in groups that fit an automaton; long items in overlapping pieces.

    The bound is on white-space words, at most as many as bytes of the item's words.
    """
    named = items.select(F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, words in zip(batch.column(0).to_pylist(), map(words_of, batch.column(1).to_pylist())):
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), limit // 2):
                    part = words[at : at + limit // 2 + window - 1]
                    found.append((item, b" ".join(part).decode("utf-8", "surrogatepass"), len(part)))
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["item", "text", "n"])

    cut = staged(arrow_map(named, pieces, "item string, text string, n long"), "items")
    total = cut.agg(F.sum("n")).first()[0] or 0
    groups = -(-total // (limit // 2))
    return [cut.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).select("item", "text") for g in range(groups)]


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    with_text: bool = False, automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, hit_items``, and ``clean_text`` if wanted.

    A window is ``window`` words of an item in a row, or a whole item of fewer words. A word
    of a document is hit if it lies in an occurrence of one. ``hit_items`` are the ids, as
    sorted distinct strings, of items with an occurring window. ``clean_text`` is the text without
    hit words. NULL and wordless texts hit nothing, and items without words have no
    windows; an item without an id is called ``null``. Rows of equal item ids are one item. No row of
    ``docs`` is lost; columns of the new names are replaced.
    """
    added = ["n_words", "n_hit", "hit_items", *["clean_text"] * with_text]
    context = docs.sparkSession.sparkContext
    groups = _groups(items, item_id, item_text, window, automaton_words)
    rounds = [groups[i : i + TOGETHER] for i in range(0, len(groups), TOGETHER)] or [[]]
    kept = docs.drop(*added)
    found = kept.withColumns({"__spans": F.array().cast("array<int>"), "hit_items": F.array().cast("array<string>")})
    for i, own in enumerate(rounds):
        # Each group is bounded by ``automaton_words``, and so is what is fetched and broadcast for a round.
        shared = [context.broadcast([tuple(r) for r in g.collect()]) for g in own]
        found = _pass(found, kept.columns.index(text), shared, window, i == len(rounds) - 1, with_text)
        if i < len(rounds) - 1:
            # Stored, so the next round neither repeats this one nor needs its automata.
            found = staged(found, "round")
            for sent in shared:
                sent.destroy()
    return found.select(*kept.columns, *added)


def _pass(found: DataFrame, place: int, shared: list, window: int, last: bool, with_text: bool) -> DataFrame:
    """Add what some automata find to the spans of hit words and the items."""
    added = ["n_words long, n_hit long" + ", clean_text string" * with_text] if last else []
    schema = fields(found.schema, *added)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(s.value, window) for s in shared]
        for batch in batches:
            spans, hit_items, n_words, n_hit, clean = [], [], [], [], []
            before = zip(batch.column(place).to_pylist(), *[c.to_pylist() for c in batch.columns[-2:]])
            for t, old_spans, old_items in before:
                words = words_of(t)
                hit = np.zeros(len(words), dtype=bool)
                for at in range(0, len(old_spans), 2):
                    hit[old_spans[at] : old_spans[at + 1]] = True
                items_found = set(old_items)
                for automaton in automata:
                    new, names = automaton.match(words)
                    if new is not None:
                        hit |= new
                        items_found |= names
                spans.append(np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).astype(np.int32))
                hit_items.append(sorted(items_found))
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                if with_text and last:
                    clean.append(_cut(t, hit) if n_hit[-1] else t)
            columns = [*batch.columns[:-2], pa.array(spans, pa.list_(pa.int32())), pa.array(hit_items, pa.list_(pa.string()))]
            if last:
                columns += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
                if with_text:
                    columns.append(pa.array(clean, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(found, match, schema)


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_hit: float = 0.5, **options) -> DataFrame:
    """``docs`` with the hit words cut from ``text``.

    A document of which more than ``most_hit`` of the words are hit goes as a whole. Documents
    without a hit stay as they are.
    """
    found = find_contamination(docs, items, window, with_text=True, **options)
    mostly = F.col("n_hit") > most_hit * F.col("n_words")
    return found.filter(~mostly).withColumn("text", F.col("clean_text")).select(*docs.columns)
