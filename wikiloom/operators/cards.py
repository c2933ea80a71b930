"""Outcomes of query messages, and the cards shown for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions.urls import host_of
from wikiloom.operators.resolvers import CARD

# Fixed value: pictures wider than this ratio are shown large.
WIDE_PICTURE = 1.75


def answers_of(looked_up: DataFrame, cards: DataFrame) -> DataFrame:
    """One outcome per distinct (wiki, query).

    ``looked_up`` has ``wiki_key, query, endpoint, resolver, color``; ``cards`` has a row for each request with a hit.
    """
    outcome = (
        F.when(F.col("endpoint").isNull(), "unknown_prefix")
        .when(F.col("resolver").isNull(), "unknown_resolver")
        .when(F.col("hit").isNull(), "no_result")
        .otherwise("result")
    )
    found = cards.withColumn("hit", F.lit(True))
    return looked_up.join(found, ["endpoint", "query", "resolver"], "left").select(
        "wiki_key", "query", "endpoint", "color", "article_id", *CARD, outcome.alias("answer")
    )


def outcomes(routed: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per query message, with its outcome and card."""
    outcome = (
        F.when(F.size("words") == 1, "no_wiki_prefix")
        .when(F.size("words") == 2, "no_query")
        .otherwise(F.col("answer"))
    )
    # Messages without a query have no answer. A key of their own spreads them, where NULL would gather them in one task.
    no_query = F.concat(F.lit("\0"), F.col("event_id").cast("string"))
    asked = routed.filter(F.col("route") == "query").select(
        "event_id", "ts", "words", "wiki_key", "query", F.coalesce("wiki_key", no_query).alias("key"), F.coalesce("query", no_query).alias("text")
    )
    return (
        asked.join(answers.withColumnsRenamed({"wiki_key": "key", "query": "text"}), ["key", "text"], "left")
        .withColumn("outcome", outcome)
        .drop("key", "text")
    )


def card_columns() -> dict[str, Column]:
    """The parts of a result card, from the columns of ``outcomes``."""
    footer = F.concat(
        F.lit("From "),
        host_of(F.col("endpoint")),
        F.lit(" | Requested "),
        F.date_format("ts", "MM/dd/yyyy"),
    )
    # A picture without a size could not be read, and is not shown.
    ratio = F.when(F.col("thumb_url") != "", F.try_divide("thumb_w", "thumb_h"))
    return {
        "title": F.col("title"),
        "title_link": F.col("page_url"),
        "summary": F.col("summary"),
        "color": F.col("color"),
        "footer": footer,
        "image_url": F.when(ratio > WIDE_PICTURE, F.col("thumb_url")),
        "thumbnail_url": F.when(ratio <= WIDE_PICTURE, F.col("thumb_url")),
    }


def result_cards(answered: DataFrame) -> DataFrame:
    """What is shown for each message with a result."""
    return answered.filter(F.col("outcome") == "result").select(
        "event_id", *[column.alias(name) for name, column in card_columns().items()]
    )
