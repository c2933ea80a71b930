"""A training corpus from raw documents: five stages, each written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. All but the
last return the columns of ``documents``, with ``n_chars`` of the text they leave.

Other columns are not carried on. Documents without a letter go in the first stage, so NULL and
empty texts go there. Ids are meant to be unique, but near copies are told by row: of rows that repeat an id, or have
none, one of each group stays like of others, and a row without a near copy stays whatever else has its id. Without
documents there is no row.

A stage's output is stored before the next one runs. So a stage first deletes the scratch tables of those before it, but
for such as its input is still read from.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wikiloom.llm import bpe_trie, decontaminate, jaccard_join, langid, substring_dedup
from wikiloom.llm.common import is_held_out
from wikiloom.session import delete, scratch_folder, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A document whose language is less certain goes.
LEAST_SCORE = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders with scratch tables of stages that have run.
_left: list[str] = []


def _stage(function: Stage) -> Stage:
    """A stage that leaves no more on disk than its own scratch tables, until the next stage runs."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # What stores the stage's output takes its shuffle files away with it.
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        read = docs.inputFiles()
        for folder in list(_left):
            if not any(folder in file for file in read):
                delete(spark, folder)
                _left.remove(folder)
        with scratch_folder(spark, function.__name__, keep=True) as folder:
            _left.append(folder)
            return function(spark, docs, sf_dir)

    return run


def _documents(found: DataFrame) -> DataFrame:
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the model is sure enough of."""
    model = langid.train(docs.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))))
    found = langid.identify(docs, model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least id, rows without an id last."""
    return jaccard_join.survivors(docs).select(*COLUMNS)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages."""
    return _documents(substring_dedup.remove_repeats(docs))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontaminate.remove_contamination(docs, items))


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with hashes of them and of the text decoded from them."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    return bpe_trie.encode_documents(docs, path, pattern, keep=("lang", "source"), with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encoding),
]

#: SQL cannot express the language model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage{i}")
    return docs
