"""Word-list filters over texts.

Short lists are arguments, and expressions of the plan. Long ones are tables. A table of words to be found
inside texts is looked for by automata over blocks of bounded size: a pass over the texts for each block, whose plan has
the same size whatever the number of words. A table of elements to be found in lists is joined with the elements.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.session import RUNTIME_FILTER, configured, staged

# Characters of the words of one block, the bound of what is fetched by the driver and sent to executors at once.
BLOCK_CHARACTERS = 4_000_000


def contains_any(
    text: Column, words: Sequence[str], case_sensitive: bool = True, spaced: bool = False
) -> Column:
    """Whether a text contains any of the words.

    ``spaced`` asks for a space on both sides of a word.
    """
    if not case_sensitive:
        text, words = F.lower(text), [w.lower() for w in words]
    if spaced:
        words = [f" {w} " for w in words]
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def with_any_word(texts: DataFrame, column: str, words: Sequence[str], **options: bool) -> DataFrame:
    return texts.filter(contains_any(F.col(column), words, **options))


def holds_any(items: Column, wanted: Column | Sequence[str]) -> Column:
    """Whether a list holds any of the wanted elements, by equality."""
    if not isinstance(wanted, Column):
        wanted = F.array(*[F.lit(w) for w in wanted]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(items, wanted), F.lit(False))


def holds(items: Column, word: str) -> Column:
    return F.coalesce(F.array_contains(items, word), F.lit(False))


# -- tables of words ------------------------------------------------------------------


def _blocks(words: DataFrame) -> Iterator[list[str]]:
    """The words of a table in pieces of bounded size, one at a time."""
    block, size = [], 0
    for row in words.toLocalIterator():
        if block and size + len(row[0]) > BLOCK_CHARACTERS:
            yield block
            block, size = [], 0
        block.append(row[0])
        size += len(row[0])
    if block:
        yield block


def found_words(
    texts: DataFrame, words: DataFrame, id: str, column: str, case_sensitive: bool = True, spaced: bool = False
) -> DataFrame:
    """The id and ``word`` of each text and each word it contains, wherever it stands, each pair once.

    ``words`` has a column ``word``; NULL words and texts are left out, and the empty word is in every text. ``spaced`` asks for
    a space on both sides of a word. Without ``case_sensitive`` both sides, and the words of the result, are in lower case.
    """
    spark = texts.sparkSession
    word = F.col("word") if case_sensitive else F.lower("word")
    wanted = staged(words.select(word.alias("word")).filter("word IS NOT NULL").distinct(), "words")
    text = F.col(column) if case_sensitive else F.lower(column)
    given = texts.filter(F.col(column).isNotNull()).select(F.col(id).alias("id"), text.alias("text"))
    kind = f"id {given.schema['id'].dataType.simpleString()}, word string"
    passes = []
    for block in _blocks(wanted):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for listed in sent.value:
                if listed or spaced:
                    automaton.add_word(f" {listed} " if spaced else listed, listed)
            has_words = len(automaton) > 0
            if has_words:
                automaton.make_automaton()
            everywhere = [] if spaced or "" not in sent.value else [""]
            for batch in batches:
                places, hits = [], []
                for place, own in enumerate(batch.column(1)):
                    found = {w for _, w in automaton.iter(own.as_py())} if has_words else set()
                    found.update(everywhere)
                    places += [place] * len(found)
                    hits += sorted(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(hits, pa.string())], names=["id", "word"])

        passes.append(staged(given.mapInArrow(search, kind), "found"))
        sent.destroy()
    if not passes:
        return given.select(F.col("id").alias(id), F.lit("").alias("word")).filter("false")
    return reduce(DataFrame.unionByName, passes).withColumnRenamed("id", id)


def with_any_listed_word(texts: DataFrame, words: DataFrame, id: str, column: str, **options: bool) -> DataFrame:
    """Texts that contain a word of a table; ids tell texts apart."""
    found = found_words(texts, words, id, column, **options).select(id).distinct()
    return texts.join(staged(found, "listed"), id, "left_semi")


def holding_listed(rows: DataFrame, wanted: DataFrame, id: str, items: str) -> DataFrame:
    """Rows whose list ``items`` holds an element of the table ``wanted``, by equality; NULLs equal nothing.

    ``wanted`` has a column ``item``. Ids tell rows apart. Elements are joined where they are read if the table is small; of
    a large one Spark sends a Bloom filter ahead, so that few elements are shuffled.
    """
    listed = staged(wanted.select("item").filter("item IS NOT NULL").distinct(), "wanted")
    each = rows.select(F.col(id).alias("id"), F.explode(F.array_distinct(items)).alias("item"))
    with configured(rows.sparkSession, RUNTIME_FILTER):
        found = staged(each.join(listed, "item", "left_semi").select(F.col("id").alias(id)).distinct(), "holding")
    return rows.join(found, id, "left_semi")
