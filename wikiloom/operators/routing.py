"""Chat messages to requests: routing, look-up of the wiki, and the requests to fetch."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions.text import normalized, space_words
from wikiloom.operators.resolvers import REGISTRY
from wikiloom.session import staged

DEFAULT_PREFIX = "wiki"


def route(messages: DataFrame, prefix: str = DEFAULT_PREFIX, mode: str = "default") -> DataFrame:
    """Messages for the bot, with their route and words.

    A message is for the bot if it starts with the prefix and a space, in any case
    (``mode="reference"`` leaves the prefix itself as given). ``help`` must match
    exactly. Any other message is a query, unless its second word is ``help``.
    """
    start = f"{prefix if mode == 'reference' else prefix.lower()} "
    for_bot = messages.filter(F.lower("content").startswith(start))
    # Filters on the route or the words would each repeat the work on the text below
    # themselves; they do not pass a generator, so the words are made by one.
    split = for_bot.select("*", F.explode(F.array(space_words(F.col("content")))).alias("words"))
    second = F.lower(F.get(F.col("words"), F.lit(1)))
    kind = (
        F.when(F.col("content") == f"{prefix} help", "help")
        .when(second == "help", "ignored")
        .otherwise("query")
    )
    return split.select(
        "*",
        kind.alias("route"),
        second.alias("wiki_key"),
        _query(F.col("words")).alias("query"),
    )


def _query(words: Column) -> Column:
    """Words from the third on as one normalized text; NULL if there is none."""
    rest = F.array_join(F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), " ")
    return F.when(F.size(words) > 2, normalized(rest))


def requests_of(routed: DataFrame) -> DataFrame:
    """Distinct (wiki, query) pairs: each is answered once, however many messages ask it."""
    return (
        routed.filter((F.col("route") == "query") & F.col("query").isNotNull())
        .select("wiki_key", "query")
        .distinct()
    )


def lookup_table(endpoints: DataFrame) -> DataFrame:
    """First endpoint per lower-cased id, so a look-up cannot fan out."""
    fields = F.struct("seq", "referenceid", "endpoint", "resolverid", "color")
    first = (
        endpoints.groupBy(F.lower("referenceid").alias("wiki_key"))
        .agg(F.min(fields).alias("first"))
        .select("wiki_key", "first.referenceid", "first.endpoint", "first.resolverid", "first.color")
    )
    return staged(first, "lookup")


def with_endpoint(rows: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Look the wiki up by its key; unknown keys get NULLs."""
    return rows.join(lookup_table(endpoints), "wiki_key", "left")


def with_resolver(rows: DataFrame, resolvers: Iterable[str] = REGISTRY) -> DataFrame:
    """The registered resolver of each looked-up endpoint, or NULL.

    The registry is an argument of the job, so membership needs no join.
    """
    known = F.col("resolverid").isin(*resolvers)
    return rows.withColumn("resolver", F.when(known, F.col("resolverid")))


def query_terms(messages: DataFrame, endpoints: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Distinct (endpoint, query) pairs asked by the messages."""
    asked = with_endpoint(requests_of(route(messages, prefix)), endpoints)
    return asked.filter(F.col("endpoint").isNotNull()).select("endpoint", "query").distinct()


def search_requests(requests: DataFrame) -> DataFrame:
    """First URL to fetch for each request: the search of its wiki.

    ``requests`` has ``endpoint, query, resolver``.
    """
    # The parameters of the two search interfaces.
    generic = F.concat(
        "endpoint",
        F.lit("?action=query&srsearch="),
        F.url_encode(F.col("query")),
        F.lit("&srprop&list=search&format=xml"),
    )
    wikia = F.concat(
        "endpoint",
        F.lit("/Search/List?query="),
        F.replace(F.col("query"), F.lit(" "), F.lit("%20")),
        F.lit("&limit=1&minArticleQuality=1&batch=1&namespaces=0%2C14"),
    )
    url = F.when(F.col("resolver") == "generic", generic).when(F.col("resolver") == "wikia", wikia)
    return requests.select("*", url.alias("url")).filter(F.col("url").isNotNull())


def page_requests(hits: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """URLs to fetch once the best hit is known.

    ``hits`` has ``endpoint, resolver, title, article_id``. A generic wiki needs one
    more request, the other kind two. Columns named in ``keep`` are passed on.
    """
    # The parameters of the page interfaces.
    info = F.replace(
        F.concat(
            "endpoint",
            F.lit("?action=query&titles="),
            F.url_encode(F.col("title")),
            F.lit(
                "&prop=extracts|info|pageimages&pithumbsize=800&inprop=url"
                "&exintro&explaintext&exchars=1200&format=xml"
            ),
        ),
        F.lit("|"),
        F.lit("%7C"),
    )
    article = F.col("article_id").cast("string")
    sections = F.concat("endpoint", F.lit("/Articles/AsSimpleJson?id="), article)
    details = F.concat(
        "endpoint", F.lit("/Articles/Details?ids="), article, F.lit("&abstract=500")
    )

    def fetch(kind: str, url: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), url.alias("url"))

    fetches = F.when(F.col("resolver") == "generic", F.array(fetch("page_info", info))).when(
        F.col("resolver") == "wikia",
        F.array(fetch("sections", sections), fetch("details", details)),
    )
    return hits.select("endpoint", *keep, F.inline(fetches))


def request_plan(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Every distinct URL an outside fetcher has to get, by kind."""
    searches = search_requests(requests).select(F.lit("search").alias("kind"), "url")
    return searches.unionByName(page_requests(hits).select("kind", "url")).distinct()
