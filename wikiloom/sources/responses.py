"""Fetched search and page responses to cards, and what is still to be fetched.

``responses`` has ``url, body``, one row per fetched URL. Requests are matched with
their response by the URL of the request plan; a missing or unreadable response leaves
the request without a card. Bodies are read where they are stored, and only the few
fields in use are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wikiloom import schemas
from wikiloom.functions.text import before_last_sentence, whole_sentences
from wikiloom.operators import routing
from wikiloom.operators.resolvers import Answering, Tables
from wikiloom.session import staged


def _of_kind(responses: DataFrame, mark: str, response: Column) -> DataFrame:
    """Responses to requests whose URL holds ``mark``, read by an expression."""
    return responses.filter(F.contains("url", F.lit(mark))).select("url", response.alias("r"))


def _xml(schema: str) -> Column:
    return F.from_xml("body", schema, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})


def _searches(requests: DataFrame, resolver: str) -> DataFrame:
    asked = requests.select("endpoint", "query").distinct().withColumn("resolver", F.lit(resolver))
    return staged(routing.search_requests(asked), "searches")


def generic_hits(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Title of the first search hit per (endpoint, query)."""
    found = _of_kind(responses, "&list=search&", _xml(schemas.SEARCH_XML)).select(
        "url", F.get(F.col("r.query.search.p"), F.lit(0))["_title"].alias("title")
    )
    return (
        found.filter(F.col("title").isNotNull())
        .join(_searches(requests, "generic"), "url")
        .select("endpoint", "query", "resolver", "title")
    )


def generic_cards(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Cards from a search response and a page-info response each."""
    hits = staged(generic_hits(requests, responses), "hits")
    asked = hits.select("endpoint", "resolver", "title").distinct()
    fetches = routing.page_requests(
        asked.withColumn("article_id", F.lit(None).cast("long")), keep=["title"]
    )
    extract = F.coalesce("page.extract._VALUE", F.lit(""))
    pages = (
        _of_kind(responses, "?action=query&titles=", _xml(schemas.PAGE_XML))
        .select("url", F.col("r.query.pages.page").alias("page"))
        .filter(F.col("page").isNotNull())
        .select(
            "url",
            F.replace(extract, F.lit("...."), F.lit(".")).alias("summary"),
            F.coalesce("page.thumbnail._source", F.lit("")).alias("thumb_url"),
            F.col("page._fullurl").alias("page_url"),
        )
        .join(staged(fetches, "fetches"), "url")
    )
    return hits.join(pages, ["endpoint", "title"]).select(
        "endpoint", "query", "title", "summary", "thumb_url", "page_url"
    )


def wikia_hits(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Page id of the search hit per (endpoint, query)."""
    found = (
        _of_kind(responses, "/Search/List?query=", F.from_json("body", schemas.SEARCH_JSON))
        .filter("r.total <> 0")
        .select("url", F.get(F.col("r.items"), F.lit(0))["id"].alias("article_id"))
    )
    return (
        found.filter(F.col("article_id").isNotNull())
        .join(_searches(requests, "wikia"), "url")
        .select("endpoint", "query", "resolver", "article_id")
    )


def wikia_cards(requests: DataFrame, responses: DataFrame, mode: str = "default") -> DataFrame:
    """Cards from a search, a sections and a details response each."""
    hits = staged(wikia_hits(requests, responses), "hits")
    asked = hits.select("endpoint", "resolver", "article_id").distinct()
    fetches = staged(
        routing.page_requests(asked.withColumn("title", F.lit("")), keep=["article_id"]), "fetches"
    )

    content = F.get(F.col("r.sections"), F.lit(0))["content"]
    sections = (
        _of_kind(responses, "/Articles/AsSimpleJson?id=", F.from_json("body", schemas.SECTIONS_JSON))
        .select("url", content.alias("content"))
        .filter(F.col("content").isNotNull())
        .select("url", F.get("content", F.lit(0))["text"].alias("text"))
        .join(fetches, "url")
        .select("endpoint", "article_id", "text")
    )

    trim = before_last_sentence if mode == "reference" else whole_sentences
    details = (
        _of_kind(responses, "/Articles/Details?ids=", F.from_json("body", schemas.DETAILS_JSON))
        .join(fetches, "url")
        .withColumn("item", F.try_element_at("r.items", F.col("article_id").cast("string")))
        .filter(F.col("item").isNotNull())
        .select(
            "endpoint",
            "article_id",
            F.col("item.title").alias("title"),
            trim(F.col("item.abstract")).alias("abstract"),
            # Some wikis give something else than a text here.
            F.when(
                F.schema_of_variant("item.thumbnail") == "STRING",
                F.try_variant_get("item.thumbnail", "$", "string"),
            )
            .otherwise("")
            .alias("thumb_url"),
            F.concat("r.basepath", "item.url").alias("page_url"),
        )
    )
    page = ["endpoint", "article_id"]
    return (
        hits.join(sections.join(details, page), page)
        .withColumn("summary", F.coalesce("text", "abstract"))
        .select("endpoint", "query", "title", "summary", "thumb_url", "page_url")
    )


# -- resolvers over responses ------------------------------------------------------------


@dataclass(frozen=True)
class ResponseResolver:
    """A resolver over the table ``responses``, and ``pictures`` if there is one.

    ``hits`` gives ``endpoint, query, resolver`` and the ``title`` or ``article_id`` of the best hit, from the search
    responses; ``cards`` gives whole cards. A request has a card once all its responses are there.
    """

    name: str
    hits: Callable[[DataFrame, DataFrame], DataFrame]
    cards: Callable[[DataFrame, DataFrame], DataFrame]

    def __call__(self, requests: DataFrame, tables: Tables) -> DataFrame:
        found = self.cards(requests, tables["responses"]).withColumns(
            {"resolver": F.lit(self.name), "article_id": F.lit(None).cast("long")}
        )
        return with_sizes(found, tables.get("pictures"))

    def page_requests(self, requests: DataFrame, responses: DataFrame) -> DataFrame:
        hits = self.hits(requests, responses)
        known = hits.withColumns(
            {c: F.lit(None).cast(t) for c, t in (("title", "string"), ("article_id", "int")) if c not in hits.columns}
        )
        distinct = staged(known.select("endpoint", "resolver", "title", "article_id").distinct(), "hits")
        return routing.page_requests(distinct).select("kind", "url")


def with_sizes(cards: DataFrame, pictures: DataFrame | None) -> DataFrame:
    """Cards with the size of their picture; NULL if it could not be read.

    ``pictures`` has ``url, width, height``, one row per picture.
    """
    if pictures is None:
        return cards.withColumns({c: F.lit(None).cast("long") for c in ("thumb_w", "thumb_h")})
    sizes = pictures.select(F.col("url").alias("thumb_url"), F.col("width").alias("thumb_w"), F.col("height").alias("thumb_h"))
    return cards.join(sizes, "thumb_url", "left")


GENERIC = ResponseResolver("generic", generic_hits, generic_cards)
WIKIA = ResponseResolver("wikia", wikia_hits, wikia_cards)

# Ids of the resolvers, in order of registration.
REGISTRY: Mapping[str, Answering] = {r.name: r for r in (GENERIC, WIKIA)}


def request_plan(requests: DataFrame, responses: DataFrame | None, registry: Mapping[str, ResponseResolver] = REGISTRY) -> DataFrame:
    """``kind, url`` of the searches, and of the pages that the searches fetched so far lead to.

    ``requests`` has ``endpoint, query, resolver`` and should be a stored table.
    """
    plan = routing.search_requests(requests).select(F.lit("search").alias("kind"), "url")
    if responses is not None:
        own = [r.page_requests(requests.filter(F.col("resolver") == name), responses) for name, r in registry.items()]
        plan = reduce(DataFrame.unionByName, own, plan)
    return plan.distinct()


def unfetched(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """The requests of a plan that have no response yet."""
    return plan.join(responses.select("url"), "url", "left_anti").select("kind", "url")
