"""Byte-pair encoding of distinct words along a prefix trie, and decoding.

The last token of the encoding of a prefix, with the encoding of what stands before that token,
is the encoding of the prefix. So a trie node needs one token only: the one that ends at
it and may follow the last token of the node where it starts. Two tokens may follow each
other if byte-pair merging of their joined bytes gives just them. The distinct words of a batch are
walked in sorted order, which is a depth-first walk of their trie: a word starts
at the node it shares with the word before, so a shared prefix is encoded once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wikiloom.llm.common import arrow_map, fields

#: Words remembered by a task; beyond that it starts anew, so its memory is bounded.
REMEMBERED = 400_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in files of byte-level vocabularies.

    Printable bytes stand for themselves; the others are numbered from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieEncoder:
    """Encodes and decodes as the tokenizers library does with a byte-level vocabulary file."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        self.ids = {raw[token]: i for token, i in spec["model"]["vocab"].items()}
        self.bytes = {i: token for token, i in self.ids.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = self.ids[raw[left]], self.ids[raw[right]]
            whole = self.ids[raw[left] + raw[right]]
            self.merged.setdefault((a, b), (rank, whole))
            self.halves.setdefault(whole, (rank, a, b))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(pattern)
        # Lengths of tokens by their last two bytes, long ones first: what can end at a node.
        endings: dict[bytes, set[int]] = {}
        for token in self.ids:
            endings.setdefault(token[-2:], set()).add(len(token))
        self.endings = {k: sorted(v, reverse=True) for k, v in endings.items()}
        self.valid: dict[int, bool] = {}
        self.remembered = remembered
        self.known: dict[str, tuple[str, int, bytes]] = {}

    # -- pairs of tokens ----------------------------------------------------------

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two tokens to the end.

        The merges that built both tokens are undone, the latest first, and each time the
        tokens at the border must not have a merge that would have come before the one undone.
        """
        key = left << 32 | right
        known = self.valid.get(key)
        if known is not None:
            return known
        merged, halves = self.merged, self.halves
        a, b, limit = left, right, (1 << 60, 0)
        kept = True
        while True:
            pair = merged.get((a, b))
            # At equal ranks the merge further left comes first.
            if pair is not None and (pair[0], 1) < limit:
                kept = False
                break
            of_a, of_b = halves.get(a), halves.get(b)
            if of_a is None and of_b is None:
                break
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                limit, a = (of_a[0], 0), of_a[2]
            else:
                limit, b = (of_b[0], 2), of_b[1]
        self.valid[key] = kept
        return kept

    # -- words --------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> None:
        """Encode distinct words and remember ids as text, their number, and the decoded bytes."""
        encoded = sorted((w.encode(), w) for w in words)
        last: list[int] = [-1]  # per node of the current path its last token
        before: list[int] = [0]  # and the node where that token starts
        path = b""
        ids, endings, may_follow = self.ids, self.endings, self._may_follow
        for data, word in encoded:
            shared = 0
            most = min(len(path), len(data))
            if path[:most] == data[:most]:
                shared = most
            else:
                while path[shared] == data[shared]:
                    shared += 1
            del last[shared + 1 :], before[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                lengths = endings.get(data[max(end - 2, 0) : end])
                found = None
                for source in (lengths, (1,)):
                    for length in source or ():
                        start = end - length
                        if start < 0:
                            continue
                        token = ids.get(data[start:end])
                        if token is not None and (start == 0 or may_follow(last[start], token)):
                            found = (token, start)
                            break
                    if found:
                        break
                last.append(found[0])
                before.append(found[1])
            path = data
            tokens = []
            node = len(data)
            while node:
                tokens.append(last[node])
                node = before[node]
            tokens.reverse()
            decoded = b"".join(map(self.bytes.__getitem__, tokens))
            self.known[word] = (",".join(map(str, tokens)), len(tokens), decoded)

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens are words of their own."""
        if self.splitter is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        parts: list[str] = []
        place = 0
        for match in self.splitter.finditer(text):
            parts += self.words.findall(text[place : match.start()])
            parts.append(match[0])
            place = match.end()
        return parts + self.words.findall(text[place:])

    def encode(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """Per text its words as (ids, number, decoded bytes)."""
        if len(self.known) > self.remembered:
            self.known = {}
            self.valid = {}
        for content, i in self.special.items():
            self.known[content] = (str(i), 1, self.bytes[i])
        documents = [self.pieces(t) for t in texts]
        new = set().union(*documents).difference(self.known) if documents else set()
        self.encode_words(list(new))
        known = self.known
        return [list(map(known.__getitem__, d)) for d in documents]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False
) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of each document, and ``ids`` if wanted.

    Ids are those of the tokenizers library without added special tokens; special strings in a
    text are special tokens. ``ids_sha256`` is of the decimal ids joined by commas,
    ``decoded_sha256`` of the text decoded from the ids. A NULL text is empty and has no
    tokens. There is one row per row of ``docs``, with the id and the columns ``keep``.
    """
    names = [id, *[c for c in keep if c != id]]
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    schema = fields(*[docs.schema[c] for c in names], added)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts, id_hashes, decoded, lists = [], [], [], []
            for words in encoder.encode(texts):
                joined = ",".join([w[0] for w in words])
                counts.append(sum([w[1] for w in words]))
                id_hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                whole = b"".join([w[2] for w in words]).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(whole.encode()).hexdigest())
                if with_ids:
                    lists.append(np.array(joined.split(",") if joined else [], dtype=np.int32))
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(id_hashes), pa.array(decoded)]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(docs.select(*names, docs[text].alias("__text")), encode, schema)
