"""Answers for a stream of messages."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wikiloom.operators import cards, catalog as catalogs, resolvers, routing
from wikiloom.operators.resolvers import CARD, REGISTRY, Resolver
from wikiloom.plans.answer import answer_messages, looked_up_requests, shown_answers
from wikiloom.session import exists, scratch_folder, staged

_REQUEST = ["endpoint", "query", "resolver"]


def route_stream(
    messages: DataFrame,
    catalog: Callable[[], DataFrame],
    articles: DataFrame,
    sink: str,
    checkpoint: str,
    prefix: str = routing.DEFAULT_PREFIX,
    trigger: dict | None = None,
    kept: str | None = None,
    registry: Mapping[str, Resolver] = REGISTRY,
) -> StreamingQuery:
    """Answer each micro-batch of messages, appending to the Parquet folder ``sink``.

    ``catalog`` is called once per micro-batch, so messages see the catalogue that is
    current when they are answered. Each micro-batch replaces its own folder, so one
    that is run again after a failure leaves no duplicates. Its scratch tables go when it is stored.

    With a folder ``kept``, what a request was answered with is kept there, requests without a hit included, and a
    request of an earlier micro-batch is not resolved again. Kept answers do not depend on the catalogue, which
    is looked up anew, but on ``articles``: start with another folder when these change.
    """
    spark = messages.sparkSession

    def answer(batch: DataFrame, batch_id: int) -> None:
        with scratch_folder(spark, f"batch{batch_id}"):
            if kept is None:
                answered = answer_messages(batch, catalog(), articles, prefix, registry)
            else:
                answered = _with_kept_answers(batch, batch_id, catalog(), articles, prefix, kept, registry)
            answered.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        messages.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def kept_answers(spark: SparkSession, kept: str, before: int | None = None) -> DataFrame | None:
    """``endpoint, query, resolver``, the card of each, ``hit``, and the micro-batch that asked first; None if there are none.

    With ``before`` only those of earlier micro-batches, so that one that is run again sees what it saw at first.
    """
    if not exists(spark, kept):
        return None
    rows = spark.read.option("basePath", kept).parquet(f"{kept}/batch_id=*")
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def _with_kept_answers(
    batch: DataFrame, batch_id: int, catalog: DataFrame, articles: DataFrame, prefix: str, kept: str, registry: Mapping[str, Resolver]
) -> DataFrame:
    spark = batch.sparkSession
    routed = routing.route(batch, prefix)
    looked_up = looked_up_requests(routed, catalogs.load(catalog), registry)
    asked = staged(looked_up.filter("resolver IS NOT NULL").select(*_REQUEST).distinct(), "asked")

    before = kept_answers(spark, kept, batch_id)
    fresh = asked if before is None else staged(asked.join(before.select(*_REQUEST), _REQUEST, "left_anti"), "fresh")
    own = f"{kept}/batch_id={batch_id}"
    found = resolvers.resolve(fresh, articles, registry).withColumn("hit", F.lit(True))
    answers = fresh.join(staged(found, "found"), _REQUEST, "left").withColumn("hit", F.col("hit").isNotNull())
    answers.select(*_REQUEST, "article_id", *CARD, "hit").write.mode("overwrite").parquet(own)

    known = spark.read.parquet(own)
    if before is not None:
        known = known.unionByName(before.select(*known.columns).join(asked, _REQUEST, "left_semi"))
    answered = cards.answers_of(looked_up, staged(known.filter("hit").drop("hit"), "known"))
    return shown_answers(cards.outcomes(routed, staged(answered, "answers")))
