"""Resolvers: requests and tables to one card per distinct (endpoint, query).

In general a resolver is a function from requests ``endpoint, query, resolver`` and tables by name to cards;
``resolve_with`` gives each its own requests. Those of article tables say which articles their search looks at and what
they show as summary; ``REGISTRY`` maps ids to them, and all of them share one search over the articles. Those of
fetched responses are in ``sources.responses``.

``articles`` has ``article_id, host, page_url, title, section_text, abstract_text, ns,
quality, thumb_url, thumb_w, thumb_h``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions.text import before_last_sentence, whole_sentences
from wikiloom.functions.urls import host_of
from wikiloom.operators import search
from wikiloom.session import staged

Tables = Mapping[str, DataFrame]

# Requests and tables to cards: ``endpoint, query, resolver, article_id`` and the columns of CARD.
Answering = Callable[[DataFrame, Tables], DataFrame]

CARD = ["title", "summary", "thumb_url", "page_url", "thumb_w", "thumb_h"]

# What the servers are asked for.
EXTRACT_LENGTH = 1200
ABSTRACT_LENGTH = 500
SEARCH_NAMESPACES = (0, 14)
SEARCH_QUALITY = 1


@dataclass(frozen=True)
class Resolver:
    """Two expressions over the articles."""

    searched: Callable[[], Column]
    summary: Callable[[], Column]


def _extract() -> Column:
    """The lead text, with runs of four dots as one."""
    lead = F.left(F.coalesce("abstract_text", F.lit("")), F.lit(EXTRACT_LENGTH))
    return F.replace(lead, F.lit("...."), F.lit("."))


def _first_text(trim: Callable[[Column], Column]) -> Column:
    """The first text of the first section, or else the trimmed abstract."""
    section = F.coalesce("section_text", F.lit(""))
    abstract = F.left("abstract_text", F.lit(ABSTRACT_LENGTH))
    return F.when(section != "", section).otherwise(trim(abstract))


def _quality_articles() -> Column:
    return F.col("ns").isin(*SEARCH_NAMESPACES) & (F.col("quality") >= SEARCH_QUALITY)


GENERIC = Resolver(lambda: F.lit(True), _extract)
WIKIA = Resolver(_quality_articles, lambda: _first_text(whole_sentences))
# Cuts an abstract before its last sentence instead of behind it.
WIKIA_REFERENCE = Resolver(_quality_articles, lambda: _first_text(before_last_sentence))

# Ids of the resolvers, in order of registration.
REGISTRY: Mapping[str, Resolver] = {"generic": GENERIC, "wikia": WIKIA}


def resolve(
    requests: DataFrame, articles: DataFrame, registry: Mapping[str, Resolver] = REGISTRY
) -> DataFrame:
    """Search for each request, then fetch the winning pages.

    ``requests`` has ``endpoint, query, resolver`` and should be a stored table.
    """
    asked = (
        requests.filter(F.col("resolver").isin(*registry))
        .select("endpoint", "query", "resolver", host_of(F.col("endpoint")).alias("host"))
        .distinct()
    )
    searched = reduce(
        or_, [(F.col("resolver") == name) & r.searched() for name, r in registry.items()]
    )
    collections = staged(asked.select("host", "resolver").distinct(), "collections")
    searchable = (
        articles.join(collections, "host")
        .filter(searched)
        .select("host", "resolver", "article_id", "title", F.col("abstract_text").alias("lead"))
    )
    hits = search.top1(asked, searchable, keys=["host", "resolver"])
    summary = F.coalesce(
        *[F.when(F.col("resolver") == name, r.summary()) for name, r in registry.items()]
    )
    winners = staged(asked.join(hits, ["host", "resolver", "query"]), "winners")
    return (
        articles.join(winners, ["host", "article_id"])
        .withColumn("summary", summary)
        .withColumn("thumb_url", F.coalesce("thumb_url", F.lit("")))
        .select("endpoint", "query", "resolver", "article_id", *CARD)
    )


def over_articles(registry: Mapping[str, Resolver] = REGISTRY) -> Answering:
    """All resolvers of a registry, over the table ``articles``."""
    return lambda requests, tables: resolve(requests, tables["articles"], registry)


def resolve_with(requests: DataFrame, tables: Tables, registry: Mapping[str, Answering]) -> DataFrame:
    """Cards of all requests, each from the resolver it names; requests of other resolvers have none."""
    parts = [
        answering(requests.filter(F.col("resolver") == name), tables).select("endpoint", "query", "resolver", "article_id", *CARD)
        for name, answering in registry.items()
    ]
    if not parts:
        raise ValueError("no resolver is registered")
    return reduce(DataFrame.unionByName, parts)
