"""Chat messages to answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from wikiloom.operators import cards, catalog, resolvers, routing
from wikiloom.operators.resolvers import REGISTRY, Answering, Resolver
from wikiloom.session import staged
from wikiloom.sources import responses

# Stored requests ``endpoint, query, resolver`` to cards.
Resolving = Callable[[DataFrame], DataFrame]


def looked_up_requests(
    routed: DataFrame, endpoints: DataFrame, registry: Iterable[str] = REGISTRY
) -> DataFrame:
    """Distinct requests with their endpoint and resolver, as a stored table."""
    asked = routing.with_endpoint(routing.requests_of(routed), endpoints)
    return staged(routing.with_resolver(asked, registry), "requests")


def answer_table(routed: DataFrame, endpoints: DataFrame, resolving: Resolving, names: Iterable[str]) -> DataFrame:
    """Everything that depends on the request alone, worked out once per request.

    ``resolving`` gives cards for requests; ``names`` are the ids of its resolvers.
    """
    looked_up = looked_up_requests(routed, endpoints, names)
    return staged(cards.answers_of(looked_up, resolving(looked_up)), "answers")


def message_outcomes(
    messages: DataFrame,
    endpoints: DataFrame,
    articles: DataFrame,
    prefix: str = routing.DEFAULT_PREFIX,
    registry: Mapping[str, Resolver] = REGISTRY,
) -> DataFrame:
    """One row per query message with outcome and card fields, from a table of articles."""
    return outcomes_with(messages, endpoints, lambda asked: resolvers.resolve(asked, articles, registry), registry, prefix)


def outcomes_with(
    messages: DataFrame, endpoints: DataFrame, resolving: Resolving, names: Iterable[str], prefix: str = routing.DEFAULT_PREFIX
) -> DataFrame:
    routed = routing.route(messages, prefix)
    return cards.outcomes(routed, answer_table(routed, endpoints, resolving, names))


def answer_messages(
    messages: DataFrame,
    raw_catalog: DataFrame,
    articles: DataFrame,
    prefix: str = routing.DEFAULT_PREFIX,
    registry: Mapping[str, Resolver] = REGISTRY,
) -> DataFrame:
    """The whole way from a raw catalogue and messages to one answer per query message."""
    return shown_answers(message_outcomes(messages, catalog.load(raw_catalog), articles, prefix, registry))


def answer_from_tables(
    messages: DataFrame,
    raw_catalog: DataFrame,
    tables: Mapping[str, DataFrame],
    registry: Mapping[str, Answering],
    prefix: str = routing.DEFAULT_PREFIX,
) -> DataFrame:
    """The same with resolvers over any tables, each a function from requests and tables to cards."""
    found = outcomes_with(
        messages, catalog.load(raw_catalog), lambda asked: resolvers.resolve_with(asked, tables, registry), registry, prefix
    )
    return shown_answers(found)


def answer_from_responses(
    messages: DataFrame,
    raw_catalog: DataFrame,
    fetched: DataFrame,
    pictures: DataFrame | None = None,
    prefix: str = routing.DEFAULT_PREFIX,
) -> DataFrame:
    """The same from what an outside fetcher got for the request plan: ``fetched`` has ``url, body``.

    ``pictures`` has ``url, width, height`` of the pictures that could be read; without it none is shown.
    """
    tables = {"responses": fetched} | ({} if pictures is None else {"pictures": pictures})
    return answer_from_tables(messages, raw_catalog, tables, responses.REGISTRY, prefix)


def requests_to_fetch(
    messages: DataFrame, raw_catalog: DataFrame, fetched: DataFrame | None = None, prefix: str = routing.DEFAULT_PREFIX
) -> DataFrame:
    """``kind, url`` of all requests that answering the messages takes, as far as it can be told by now.

    Searches come first. A page request follows once the response of its search is in ``fetched``. With
    ``responses.unfetched`` an outside fetcher gets what is left, adds what it got, and asks again until nothing is left.
    """
    asked = looked_up_requests(routing.route(messages, prefix), catalog.load(raw_catalog), responses.REGISTRY)
    return responses.request_plan(asked, fetched)


def shown_answers(answered: DataFrame) -> DataFrame:
    """Outcome of each message, and the parts of its card if it has one."""
    is_result = F.col("outcome") == "result"
    shown = [F.when(is_result, c).alias(name) for name, c in cards.card_columns().items()]
    return answered.select("event_id", "outcome", *shown)
