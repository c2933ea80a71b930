"""Token counts of a piece model, without ids.

Pieces of the model never join a space to what stands before it, which is checked on its
vocabulary. So a text falls into pre-tokens, each a run of spaces with the word behind it,
which are encoded independently. A task counts the pieces of each distinct pre-token once,
joins these counts to the frequencies of the pre-tokens in each document and adds them up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wikiloom.llm.common import arrow_map, fields

#: Pre-tokens remembered by a task; beyond that it starts anew, so its memory is bounded.
REMEMBERED = 1_000_000

_SPACE = "▁"
_PRE_TOKENS = re.compile(" *[^ ]+| +$")


class PieceCounter:
    """Numbers of pieces of texts by a sentencepiece model with a dummy prefix."""

    def __init__(self, model: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.remembered = remembered
        # The mark of a pre-token alone, as behind a last space, is one piece.
        self.counts: dict[str, int] = {"": 1}
        for i in range(self.processor.get_piece_size()):
            if _SPACE in self.processor.id_to_piece(i).lstrip(_SPACE):
                raise ValueError(f"piece {i} joins pre-tokens")

    def frequencies(self, text: str) -> Counter:
        """Pre-tokens of a text, without the first space of each."""
        if not text:
            return Counter()
        text = text.replace(_SPACE, " ")
        words = text.split(" ")
        if "" in words:
            words = [w[1:] for w in _PRE_TOKENS.findall(" " + text)]
        return Counter(words)

    def count(self, texts: list[str]) -> list[int]:
        documents = [self.frequencies(t) for t in texts]
        if len(self.counts) > self.remembered:
            self.counts = {"": 1}
        new = list(set().union(*documents).difference(self.counts)) if documents else []
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.counts.update(zip(part, map(len, self.processor.encode(part, num_threads=1))))
        counts = self.counts
        return [sum([n * counts[w] for w, n in d.items()]) for d in documents]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each document.

    Tokens are counted as the model's library gives them, without begin and end. A NULL or empty
    text has none. There is one row per row of ``docs``, also for repeated or NULL ids.
    """
    schema = fields(docs.schema[id], "n_bytes long, n_tokens long, over_limit boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = np.array(counter.count(texts), dtype=np.int64)
            n_bytes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
            columns = [batch.column(0), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=[id, "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select(id, text), count, schema)
