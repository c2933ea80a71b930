"""The registered queries: every job of the library on the derived inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fixtures.views import WORDS, base, stream_view, titled_pages, view
from fixtures.views import responses as fetched_responses
from fixtures.views import simulated_wikis
from wikiloom.functions.urls import host_of
from wikiloom.operators import (
    cards,
    catalog,
    corpus,
    harvest,
    languages,
    probes,
    resolvers,
    routing,
    search,
    sessions,
)
from wikiloom.plans import add_source, answer, retrievers
from wikiloom.session import scratch_path, staged
from wikiloom.sources import responses
from wikiloom.streaming import answers, readiness

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Inputs:
    """Derived inputs of one scale, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"fx_{name}")

    def base(self, table: str) -> DataFrame:
        return base(self.spark, self.sf_dir, table)

    @property
    def endpoints(self) -> DataFrame:
        return catalog.load(self.catalog_raw)

    @property
    def new_candidates(self) -> DataFrame:
        return probes.drop_known_hosts(self.candidates, self.endpoints)

    @property
    def named(self) -> DataFrame:
        verified = probes.resolve_by_step(self.new_candidates, self.probe)
        return probes.named_endpoints(verified, "generic").select(
            F.col("cand_id").alias("seq"), "referenceid", "endpoint", "resolverid", "color"
        )

    @property
    def every_request(self) -> DataFrame:
        endpoint = F.concat(F.lit("https://"), "host", F.lit("/w/api.php"))
        return staged(self.requests.select(endpoint.alias("endpoint"), "query"), "requests")

    @property
    def looked_up(self) -> DataFrame:
        routed = routing.route(self.messages)
        return answer.looked_up_requests(routed, self.endpoints)


def query(job: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[job.__name__] = lambda spark, sf_dir: job(Inputs(spark, sf_dir))
    return job


# -- catalogue ------------------------------------------------------------------


@query
def catalog_load(fx: Inputs) -> DataFrame:
    return fx.endpoints


@query
def catalog_load_reference(fx: Inputs) -> DataFrame:
    return catalog.load(fx.catalog_raw, mode="reference")


@query
def catalog_union(fx: Inputs) -> DataFrame:
    second = fx.catalog_raw.withColumn("referenceid", F.split_part("endpoint", F.lit("."), F.lit(2)))
    return catalog.load_combined([fx.catalog_raw, second])


@query
def catalog_export(fx: Inputs) -> DataFrame:
    return catalog.extend(fx.catalog_raw, fx.named)


@query
def exact_url_anti(fx: Inputs) -> DataFrame:
    return catalog.unknown_endpoints(fx.named, fx.catalog_raw)


@query
def load_report(fx: Inputs) -> DataFrame:
    return catalog.load_report(fx.catalog_raw)


@query
def export_report(fx: Inputs) -> DataFrame:
    return catalog.export_report(fx.catalog_raw, fx.named)


# -- harvest --------------------------------------------------------------------


@query
def dump_scan(fx: Inputs) -> DataFrame:
    rows = harvest.dump_rows(fx.bodies).drop("columns").withColumn("missing", F.lit(False))
    missing = harvest.missing_sources(fx.bodies).withColumn("missing", F.lit(True))
    return rows.unionByName(missing, allowMissingColumns=True)


@query
def source_listing(fx: Inputs) -> DataFrame:
    links = harvest.index_links(fx.base("pages").select("page_id", "html"), "/t")
    return harvest.source_listing(retrievers.registered_sources(), links, "wikistats")


@query
def harvest_links(fx: Inputs) -> DataFrame:
    crawl = fx.crawl.select("page_id", "html")
    parts = {
        "a": harvest.links_by_tag(fx.base("pages").select("page_id", "html")),
        ".wiki a": harvest.links_within_class(crawl, "wiki"),
        ".result-link": harvest.links_by_class(crawl, "result-link"),
    }
    first, *rest = [
        links.select(F.lit(name).alias("selector"), "page_id", "pos", "href")
        for name, links in parts.items()
    ]
    for part in rest:
        first = first.unionByName(part)
    return first


@query
def index_links(fx: Inputs) -> DataFrame:
    return harvest.index_links(fx.base("pages").select("page_id", "html"), "/t")


@query
def page_frontier(fx: Inputs) -> DataFrame:
    items = fx.paginator.select(
        F.col("term").alias("seed"), F.col("page_no").alias("pos"), F.col("last_page").cast("string").alias("label")
    )
    pages = harvest.numbered_pages(harvest.last_number(items))
    return pages.withColumn("url", F.concat("seed", F.lit("?page="), "page_no"))


@query
def paginator_chase(fx: Inputs) -> DataFrame:
    return harvest.last_pages(fx.paginator)


@query
def template_expand(fx: Inputs) -> DataFrame:
    hosts = fx.base("pages").select(
        F.col("page_id").alias("id"),
        F.substring_index(host_of(F.col("url")), ".", -1).alias("project"),
    )
    dump = fx.dump.join(hosts, "id")
    links = dump.select(
        "project", F.col("id").alias("pos"), F.col("statsurl").alias("href"), F.col("prefix").alias("text")
    )
    return harvest.expanded_links(dump.select("id", "project", "prefix"), links).select(
        "id", "project", "prefix", "url"
    )


@query
def statsurl_links(fx: Inputs) -> DataFrame:
    return harvest.statsurl_links(fx.dump).select("id", "url")


@query
def language_filter(fx: Inputs) -> DataFrame:
    return harvest.in_language(fx.dump, "English").select("id", "lang")


@query
def link_normalize(fx: Inputs) -> DataFrame:
    return harvest.normalized_links(fx.candidates, "example.com")


@query
def language_lookup(fx: Inputs) -> DataFrame:
    spoken = fx.dump.select("id", F.col("lang").alias("language"))
    return languages.with_language_code(spoken)


# -- probes ---------------------------------------------------------------------


@query
def probe_plan(fx: Inputs) -> DataFrame:
    return probes.probe_plan(fx.candidates)


@query
def known_host_anti(fx: Inputs) -> DataFrame:
    return fx.new_candidates


@query
def probe_resolve(fx: Inputs) -> DataFrame:
    return probes.resolve_by_step(fx.candidates, fx.probe)


@query
def probe_resolve_single(fx: Inputs) -> DataFrame:
    return probes.resolve_by_step(fx.candidates, fx.probe, probes.WIKIA_SUFFIXES)


@query
def probe_resolve_log(fx: Inputs) -> DataFrame:
    return probes.resolve_by_url(fx.candidates, fx.probe_log)


@query
def endpoint_naming(fx: Inputs) -> DataFrame:
    links = fx.candidates.withColumnRenamed("url", "endpoint")
    return probes.named_endpoints(links, "generic")


@query
def ingest_funnel(fx: Inputs) -> DataFrame:
    return probes.funnel(fx.dump, fx.endpoints, fx.probe, "english")


# -- messages -------------------------------------------------------------------


@query
def route_messages(fx: Inputs) -> DataFrame:
    return routing.route(fx.messages).select(
        "event_id", "route", F.size("words").alias("word_count"), "wiki_key", "query"
    )


@query
def query_terms(fx: Inputs) -> DataFrame:
    return routing.query_terms(fx.messages, fx.endpoints)


def _queries(fx: Inputs) -> DataFrame:
    routed = routing.route(fx.messages).filter(F.col("route") == "query")
    return routing.with_endpoint(routed.select("event_id", "wiki_key"), fx.endpoints)


@query
def catalog_lookup(fx: Inputs) -> DataFrame:
    return _queries(fx).select(
        "event_id", "wiki_key", "referenceid", "endpoint", "resolverid", "color"
    )


@query
def resolver_dispatch(fx: Inputs) -> DataFrame:
    return routing.with_resolver(_queries(fx)).select(
        "event_id", "endpoint", "resolverid", "resolver"
    )


@query
def search_top1(fx: Inputs) -> DataFrame:
    articles = fx.articles.withColumnRenamed("abstract_text", "lead")
    return search.top1(fx.requests, articles)


def _resolved(fx: Inputs, resolver: resolvers.Resolver) -> DataFrame:
    requests = fx.every_request.withColumn("resolver", F.lit("only"))
    return resolvers.resolve(requests, fx.articles, {"only": resolver}).drop("resolver")


@query
def resolve_generic(fx: Inputs) -> DataFrame:
    return _resolved(fx, resolvers.GENERIC)


@query
def resolve_wikia(fx: Inputs) -> DataFrame:
    return _resolved(fx, resolvers.WIKIA)


@query
def resolve_wikia_reference(fx: Inputs) -> DataFrame:
    return _resolved(fx, resolvers.WIKIA_REFERENCE)


@query
def request_plan(fx: Inputs) -> DataFrame:
    requests = fx.looked_up
    return routing.request_plan(requests, resolvers.resolve(requests, fx.articles))


@query
def query_outcome(fx: Inputs) -> DataFrame:
    answered = answer.message_outcomes(fx.messages, fx.endpoints, fx.articles)
    return answered.select("event_id", "wiki_key", "query", "outcome", "endpoint", "article_id")


@query
def result_card(fx: Inputs) -> DataFrame:
    answered = answer.message_outcomes(fx.messages, fx.endpoints, fx.articles)
    return cards.result_cards(answered)


@query
def answer_messages(fx: Inputs) -> DataFrame:
    return answer.answer_messages(fx.messages, fx.catalog_raw, fx.articles)


@query
def generic_responses(fx: Inputs) -> DataFrame:
    asked = titled_pages(fx.articles).select(F.col("generic").alias("endpoint"), F.col("title").alias("query"))
    return responses.generic_cards(asked, fetched_responses(fx.articles))


@query
def wikia_responses(fx: Inputs) -> DataFrame:
    asked = titled_pages(fx.articles).select(F.col("wikia").alias("endpoint"), F.col("title").alias("query"))
    return responses.wikia_cards(asked, fetched_responses(fx.articles))


def _fetched(fx: Inputs) -> tuple[DataFrame, DataFrame]:
    """What a fetcher got for the messages that ask about pages, and the sizes of the pictures."""
    asked = answer.looked_up_requests(routing.route(fx.asks), fx.endpoints)
    sizes = fx.wiki_pages.filter("thumb_url IS NOT NULL").select(
        F.col("thumb_url").alias("url"), F.col("thumb_w").alias("width"), F.col("thumb_h").alias("height")
    )
    return staged(simulated_wikis(asked, fx.wiki_pages), "fetched"), sizes.dropDuplicates(["url"])


@query
def answer_from_responses(fx: Inputs) -> DataFrame:
    fetched, pictures = _fetched(fx)
    return answer.answer_from_responses(fx.asks, fx.catalog_raw, fetched, pictures)


@query
def request_plan_from_responses(fx: Inputs) -> DataFrame:
    fetched, _ = _fetched(fx)
    return answer.requests_to_fetch(fx.asks, fx.catalog_raw, fetched)


# -- sources --------------------------------------------------------------------


@query
def source_errors(fx: Inputs) -> DataFrame:
    missing = retrievers.missing_sources(fx.bodies, "english").withColumn("retriever", F.lit("wikistats"))
    searches = fx.dump.select(F.col("prefix").alias("term"), F.when(F.col("id") % 7 == 3, F.concat("lang", F.lit("ish"))).otherwise(F.col("lang")).alias("language"))
    unknown = retrievers.unknown_languages(searches).withColumn("retriever", F.lit("fandom"))
    return missing.unionByName(unknown)



@query
def add_source_dump(fx: Inputs) -> DataFrame:
    return add_source.add_source_dump(fx.catalog_raw, fx.bodies, fx.display, fx.probe_log)


@query
def add_source_directory(fx: Inputs) -> DataFrame:
    seeds = fx.crawl.select(F.col("term").alias("seed")).distinct()
    return add_source.add_source_directory(fx.catalog_raw, fx.crawl, seeds, fx.probe_log)


@query
def add_source_search(fx: Inputs) -> DataFrame:
    searches = fx.crawl.select("term", F.lit("english").alias("language")).distinct()
    crawl = fx.crawl.withColumn("lang", F.lit("en"))
    return add_source.add_source_search(
        fx.catalog_raw, crawl, searches, None, fx.probe_log, "example.com"
    )


# -- corpus filters ---------------------------------------------------------------


@query
def word_list_match(fx: Inputs) -> DataFrame:
    text = F.col("text")
    return fx.base("documents").select(
        "doc_id",
        corpus.contains_any(text, WORDS).alias("any_word"),
        corpus.contains_any(text, WORDS, case_sensitive=False, spaced=True).alias("spaced_word"),
    )


@query
def list_membership(fx: Inputs) -> DataFrame:
    words = F.split("text", " ")
    return fx.base("documents").select(
        "doc_id",
        corpus.holds_any(words, WORDS).alias("any_listed"),
        corpus.holds(words, WORDS[0]).alias("first_listed"),
    )


@query
def word_table_match(fx: Inputs) -> DataFrame:
    docs = fx.base("documents").select("doc_id", "text")
    found = corpus.found_words(docs, fx.words, "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("words"), F.min("word").alias("first_word"))


@query
def spaced_word_table_match(fx: Inputs) -> DataFrame:
    docs = fx.base("documents").select("doc_id", "text")
    return corpus.with_any_listed_word(docs, fx.words, "doc_id", "text", case_sensitive=False, spaced=True).select("doc_id")


@query
def list_membership_table(fx: Inputs) -> DataFrame:
    docs = fx.base("documents").select("doc_id", F.split("text", " ").alias("words"))
    return corpus.holding_listed(docs, fx.words.withColumnRenamed("word", "item"), "doc_id", "words").select("doc_id")


# -- sessions and streams -----------------------------------------------------------


@query
def session_status(fx: Inputs) -> DataFrame:
    return sessions.session_status(fx.lifecycle)


@query
def route_stream(fx: Inputs) -> DataFrame:
    sink = scratch_path(fx.spark, "answers")
    running = answers.route_stream(
        stream_view(fx.spark, fx.sf_dir, "fx_messages", "events"),
        lambda: fx.catalog_raw,
        fx.articles,
        sink,
        scratch_path(fx.spark, "progress"),
    )
    running.awaitTermination()
    return fx.spark.read.parquet(sink).drop("batch_id")


@query
def route_stream_kept(fx: Inputs) -> DataFrame:
    sink = scratch_path(fx.spark, "answers")
    running = answers.route_stream(
        stream_view(fx.spark, fx.sf_dir, "fx_asks", "pages"),
        lambda: fx.catalog_raw,
        fx.wiki_pages,
        sink,
        scratch_path(fx.spark, "progress"),
        kept=scratch_path(fx.spark, "kept"),
    )
    running.awaitTermination()
    return fx.spark.read.parquet(sink).drop("batch_id")


@query
def ready_stream(fx: Inputs) -> DataFrame:
    """Ready events per shard, and as the row without a shard the number of shards that the signal was given for."""
    table = scratch_path(fx.spark, "ready")
    lifecycle = stream_view(fx.spark, fx.sf_dir, "fx_lifecycle", "events")
    shards = fx.lifecycle.filter("kind = 'ready'").select("shard").distinct().count()
    readiness.ready_stream(lifecycle, shards, lambda batch_id: None, table, scratch_path(fx.spark, "progress")).awaitTermination()
    counts = fx.spark.read.parquet(f"{table}/batch_id=0").select("shard", "ready_events")
    signal = fx.spark.read.parquet(f"{table}_signal").select(F.lit(None).cast("long").alias("shard"), F.col("ready_shards").alias("ready_events"))
    return counts.unionByName(signal)
