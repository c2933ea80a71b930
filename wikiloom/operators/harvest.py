"""Crawled pages and project dumps to candidate links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions import html
from wikiloom.functions.urls import host_of, is_well_formed
from wikiloom.operators.languages import with_language_code
from wikiloom.session import staged

# Fixed value: what a dump body says if its project does not exist.
MISSING_SOURCE = "table name not set or unknown"

# A statistics URL counts with these statuses of its wiki.
LIVE_STATUSES = (200, 404)


# -- links ----------------------------------------------------------------------
#
# Pages have ``html`` and any other columns; their links keep the other columns and
# get ``pos``, their place among the links of the page. A page that could not be fetched
# has no html and gives no rows.


def _cut_links(pages: DataFrame, needle: str, tags: Column) -> DataFrame:
    kept = [c for c in pages.columns if c != "html"]
    found = pages.filter(html.mentions(F.col("html"), needle)).select(
        *kept, F.posexplode(tags).alias("pos", "tag")
    )
    return found.select(*kept, "pos", html.link_target(F.col("tag")).alias("href"))


def links_by_tag(pages: DataFrame, tag: str = "a") -> DataFrame:
    """``pos, href`` of all elements of a tag that have a href, per page."""
    tags = F.filter(html.tags(F.col("html"), tag), lambda t: html.has_attribute(t, "href"))
    return _cut_links(pages, "href", tags)


def links_by_class(pages: DataFrame, name: str) -> DataFrame:
    """``pos, href`` of all elements of a class, per page; '' where there is no href."""
    tags = F.filter(html.tags(F.col("html")), lambda t: html.has_class(t, name))
    return _cut_links(pages, name, tags)


def links_within_class(pages: DataFrame, name: str) -> DataFrame:
    """``pos, href`` of all anchors inside elements of a class, per page."""
    return html.anchors_within(pages, name)


def index_links(pages: DataFrame, prefix: str) -> DataFrame:
    """``pos, href, text`` of elements whose href starts with ``prefix``, per page."""
    return html.links_with_text(pages, prefix)


def first_links_by_text(links: DataFrame) -> DataFrame:
    """Per page and text the first link."""
    keys = [c for c in links.columns if c not in ("pos", "href")]
    return (
        links.groupBy(*keys)
        .agg(F.min(F.struct("pos", "href")).alias("first"))
        .select(*keys, "first.href")
    )


def normalized_links(links: DataFrame, family: str) -> DataFrame:
    """Links that contain the family name, without trailing slashes."""
    return links.filter(F.contains("url", F.lit(family))).withColumn(
        "url", F.rtrim("url", F.lit("/"))
    )


# -- paginators -----------------------------------------------------------------

_BLOCK = 10_000


def last_number(items: DataFrame) -> DataFrame:
    """Per seed the last number of its paginator.

    ``items`` has ``seed, pos, label``; a seed whose last label is no number is
    dropped.
    """
    return (
        items.groupBy("seed")
        .agg(F.max_by("label", "pos").alias("label"))
        .select("seed", F.col("label").try_cast("int").alias("pages"))
        .filter(F.col("pages").isNotNull())
    )


def numbered_pages(seeds: DataFrame) -> DataFrame:
    """Rows ``seed, page_no`` for pages 1 to ``pages`` of each seed.

    Page numbers are made in blocks that are spread over the tasks, so one seed with
    very many pages is not one task's work.
    """
    blocks = seeds.filter(F.col("pages") > 0).select(
        "seed",
        "pages",
        F.explode(F.sequence(F.lit(0), ((F.col("pages") - 1) / _BLOCK).cast("int"))).alias("block"),
    )
    first = F.col("block") * _BLOCK + 1
    last = F.least(first + (_BLOCK - 1), F.col("pages"))
    return blocks.repartition("seed", "block").select(
        "seed", F.explode(F.sequence(first, last)).alias("page_no")
    )


def last_pages(crawl: DataFrame) -> DataFrame:
    """True last page of each term: follow the last number shown from page 1 on.

    ``crawl`` has ``term, page_no, last_shown``, one row per page. The chase ends at a
    page that shows its own number. Each round moves every unfinished chase along the jumps of its term
    and doubles these jumps, so the number of rounds grows with the logarithm of the longest chase. Chases that
    have ended, have left the crawl, or have made more hops than their term has pages, and so run in a circle,
    leave with all jumps of their term: each round has the rows of unfinished terms alone. Only the first kind gives
    a row.
    """
    jumps = crawl.select("term", "page_no", F.col("last_shown").alias("target"), (F.col("page_no") == F.col("last_shown")).alias("last"))
    pages = crawl.groupBy("term").agg(F.count("*").alias("pages"))
    jumps = staged(jumps.filter("target IS NOT NULL"), "jumps")
    open_chases = staged(jumps.filter("page_no = 1").select("term", "page_no").join(pages, "term"), "chases")
    finished, hops = [], 1
    while not open_chases.isEmpty():
        moved = staged(open_chases.join(jumps, ["term", "page_no"]).select("term", "page_no", "target", "last", "pages"), "chases")
        finished.append(moved.filter("last").select("term", F.col("page_no").alias("last_page")))
        open_chases = moved.filter((~F.col("last")) & (F.col("pages") >= hops)).select("term", F.col("target").alias("page_no"), "pages")
        hops *= 2
        own = jumps.join(open_chases.select("term"), "term", "left_semi")
        onward = own.select("term", F.col("page_no").alias("target"), F.col("target").alias("next"))
        jumps = staged(own.join(onward, ["term", "target"]).select("term", "page_no", F.col("next").alias("target"), "last"), "jumps")
    if not finished:
        return open_chases.select("term", F.col("page_no").alias("last_page"))
    return reduce(DataFrame.unionByName, finished)


# -- project dumps --------------------------------------------------------------


# The columns of a dump that are read.
DUMP_COLUMNS = ("lang", "prefix", "statsurl", "http")

# One field: quoted, with what may follow the closing quote, or plain. A quote opens a field only at its start.
_QUOTED, _PLAIN = r'"(?:[^"]++|"")*+"[^,\r\n]*+', r"[^,\r\n]*+"
_RECORD = rf"((?=[^\r\n])(?:{_QUOTED}|{_PLAIN})(?:,(?:{_QUOTED}|{_PLAIN}))*+)"
_CLOSED = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
_ALL_CLOSED = rf"^{_CLOSED}(?:,{_CLOSED})*+\z"


def csv_fields(record: Column, width: int) -> Column:
    """The first ``width`` fields of a CSV record, as Spark's CSV parser reads them; '' for blank and absent ones.

    A record with a quote that is never closed is read without quotes.
    """
    schema = F.lit(", ".join(f"c{i} string" for i in range(width)))

    def read(quote: str) -> Column:
        return F.from_csv(record, schema, {"quote": quote, "escape": quote, "mode": "PERMISSIVE"})

    read_as = F.when(record.rlike(_ALL_CLOSED), read('"')).otherwise(read("\0"))
    fields = F.array(*[F.coalesce(read_as.getField(f"c{i}"), F.lit("")) for i in range(width)])
    return F.when(record.isNotNull(), fields)


def named_fields(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in use of rows with ``columns`` (a header) and ``values``; NULL where the header lacks one."""

    def value(name: str) -> Column:
        place = F.array_position("columns", name).cast("int")
        return F.when(place > 0, F.coalesce(F.get("values", place - 1), F.lit(""))).alias(name)

    return rows.select(*keep, *[value(n) for n in DUMP_COLUMNS], "columns")


def dump_rows(bodies: DataFrame) -> DataFrame:
    """Rows of fetched dumps that are cells of a table, read by the header line of each.

    ``bodies`` has ``source, body``. Gives ``source, line_no``, the four columns in
    use, NULL where the dump lacks the column, and ``columns`` as the header names. Records are rows before their
    fields are read, each by Spark's CSV parser.
    A quote opens a field only at its start, anywhere else it is data; what follows a closing quote makes the field
    data as a whole. A field whose quote is
    never closed ends with its line. Empty lines are no rows. Dumps that are files are read by ``sources.dumps``.
    """
    found = bodies.filter(~F.contains("body", F.lit(MISSING_SOURCE)))
    header = F.regexp_extract("body", _RECORD, 1)
    commas = F.length(header) - F.length(F.replace(header, F.lit(","), F.lit("")))
    width = (found.agg(F.max(commas)).first()[0] or 0) + 1
    lines = found.withColumn("lines", F.regexp_extract_all(F.col("body"), F.lit(_RECORD), F.lit(1))).select(
        "source",
        csv_fields(F.get("lines", F.lit(0)), width).alias("columns"),
        F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line_no", "line"),
    )
    named = lines.withColumn("values", csv_fields(F.col("line"), width))
    return named_fields(named, ["source", "line_no"])


def missing_sources(bodies: DataFrame) -> DataFrame:
    """Sources that do not exist."""
    return bodies.filter(F.contains("body", F.lit(MISSING_SOURCE))).select("source")


def has_language(lang: Column, language: str) -> Column:
    """Rows of the language, in any case, or without one."""
    given = F.coalesce(lang, F.lit(""))
    return (F.lower(given) == language.lower()) | (given == "")


def in_language(dump: DataFrame, language: str) -> DataFrame:
    """Rows of the language; all of them if the dump has no such column."""
    if "lang" not in dump.columns:
        return dump
    return dump.filter(has_language(F.col("lang"), language))


def statsurl_link(statsurl: Column, http: Column) -> Column:
    """``http://`` and the host of a live wiki's URL, else NULL."""
    live = http.try_cast("int").isin(*LIVE_STATUSES)
    return F.when(live, F.concat(F.lit("http://"), host_of(statsurl)))


def statsurl_links(dump: DataFrame) -> DataFrame:
    """Rows with a link made from their statistics URL."""
    return dump.withColumn("url", statsurl_link(F.col("statsurl"), F.col("http"))).filter(
        F.col("url").isNotNull()
    )


def expanded_links(dump: DataFrame, display_links: DataFrame) -> DataFrame:
    """Rows with a link made from their prefix and their project's host template.

    ``dump`` has ``project, prefix``; ``display_links`` has ``project, pos, href,
    text``. The template comes from the first well-formed link whose text is a prefix
    of the project; a project without one gives empty links.
    """
    prefixes = staged(dump.select("project", F.col("prefix").alias("text")).distinct(), "prefixes")
    shown = F.struct("pos", host_of(F.col("href")).alias("host"), "text")
    templates = (
        display_links.filter(is_well_formed(F.col("href")) & (F.col("text") != ""))
        .join(prefixes, ["project", "text"], "left_semi")
        .groupBy("project")
        .agg(F.min(shown).alias("first"))
        .select("project", F.col("first.host").alias("host"), F.col("first.text").alias("text"))
    )
    link = F.concat(F.lit("http://"), F.replace("host", F.col("text"), F.col("prefix")))
    return (
        dump.join(staged(templates, "templates"), "project", "left")
        .withColumn("url", F.coalesce(link, F.lit("")))
        .drop("host", "text")
    )


# -- sources and languages --------------------------------------------------------


def source_listing(registry: dict[str, list[str]], index: DataFrame, indexed: str) -> DataFrame:
    """One row per (retriever, source name).

    Names come from the registry, and for the retriever ``indexed`` from the texts of
    ``index_links``.
    """
    spark = index.sparkSession
    listed = spark.range(1).select(
        F.explode(
            F.create_map(
                *[
                    part
                    for name, sources in registry.items()
                    for part in (F.lit(name), F.array(*[F.lit(s) for s in sources]).cast("array<string>"))
                ]
            )
        ).alias("retriever", "sources")
    ).select("retriever", F.explode("sources").alias("source"))
    found = index.select(F.lit(indexed).alias("retriever"), F.col("text").alias("source"))
    return listed.unionByName(found)


# -- links of whole sources ---------------------------------------------------------


def dump_links(bodies: DataFrame, display_pages: DataFrame, language: str) -> DataFrame:
    """Candidate links of project dumps.

    ``display_pages`` has ``project, html``. A dump with prefixes is expanded by the host
    template of its project's page, another one by its statistics URLs.
    """
    rows = dump_rows(bodies)
    spoken = rows.filter(
        ~F.array_contains("columns", "lang") | has_language(F.col("lang"), language)
    )
    has_prefix = F.array_contains("columns", "prefix")
    by_prefix = spoken.filter(has_prefix).withColumnRenamed("source", "project")
    shown = html.links_with_text(display_pages.select("project", "html"))
    expanded = expanded_links(by_prefix, shown).withColumnRenamed("project", "source")
    by_url = statsurl_links(
        spoken.filter(~has_prefix & F.array_contains("columns", "statsurl"))
    )
    return expanded.unionByName(by_url).select(
        "url", "source", F.col("line_no").cast("long").alias("seq"), F.lit(0).alias("pos")
    )


def directory_links(crawl: DataFrame, seeds: DataFrame) -> DataFrame:
    """Candidate links of paged directories.

    ``crawl`` has ``url, html``; ``seeds`` has ``seed``, the URL of a directory whose pages are asked for by ``?page=``.
    """

    def page_url(number):
        return F.concat("seed", F.lit("?page="), number.cast("string"))

    pages = crawl.select("url", "html")
    first = staged(seeds.select("seed", page_url(F.lit(1)).alias("url")), "seeds")
    items = html.marked_texts(
        pages.join(first, "url").select("seed", "html"), "b-pagination-item", tag="a"
    )
    counted = last_number(items.withColumnRenamed("text", "label"))
    frontier = numbered_pages(counted).withColumn("url", page_url(F.col("page_no")))
    # Only pages of the frontier are parsed. It is stored, so it is broadcast if it is small.
    asked = pages.join(staged(frontier, "frontier"), "url").select("seed", "page_no", "html")
    return links_within_class(asked, "wiki").select(
        F.col("href").alias("url"), F.col("seed").alias("source"), F.col("page_no").cast("long").alias("seq"), "pos"
    )


def search_links(
    crawl: DataFrame, searches: DataFrame, languages: DataFrame | None, family: str
) -> DataFrame:
    """Candidate links of paged searches.

    ``crawl`` has ``term, lang, page_no, html``; ``searches`` has ``term, language``.
    Searches in unknown languages give nothing, nor do those without links on their
    first page.
    """
    coded = with_language_code(searches, languages).filter(F.col("code").isNotNull())
    asked = staged(coded.select("term", F.col("code").alias("lang")).distinct(), "searches")
    pages = (
        crawl.join(asked, ["term", "lang"], "left_semi")
        .withColumn("source", F.concat_ws(" ", "term", "lang"))
        .select("source", "page_no", "html")
    )
    # One walk through each page gives its links and its paginator.
    found = staged(html.marked_elements(pages, "result-link", "paginator-page"), "results")
    links = found.filter("mark = 'result-link'").select("source", "page_no", "pos", "href")
    shown = (
        found.filter("mark = 'paginator-page'")
        .groupBy("source", "page_no")
        .agg(F.max_by("text", "pos").try_cast("int").alias("last_shown"))
        .filter(F.col("last_shown").isNotNull())
    )
    shown = staged(shown, "paginators")
    chased = last_pages(shown.withColumnRenamed("source", "term"))
    unpaged = (
        links.filter("page_no = 1")
        .select("source")
        .distinct()
        .join(shown.filter("page_no = 1"), "source", "left_anti")
        .withColumn("last_page", F.lit(1))
    )
    lengths = (
        links.filter("page_no = 1")
        .select("source")
        .distinct()
        .join(chased.withColumnRenamed("term", "source"), "source")
        .unionByName(unpaged, allowMissingColumns=True)
    )
    found = (
        links.join(staged(lengths, "lengths"), "source")
        .filter(F.col("page_no").between(1, F.col("last_page")))
        .select(
            F.col("href").alias("url"), "source", F.col("page_no").cast("long").alias("seq"), "pos"
        )
    )
    return normalized_links(found, family)


def display_pages(index_pages: DataFrame, crawl: DataFrame, base: str, prefix: str) -> DataFrame:
    """``project, html`` of the page that the index shows first for each project.

    ``index_pages`` has ``html``, ``crawl`` has ``url, html``. Links of the index start
    with ``prefix``, are named after the project and are relative to ``base``.
    """
    links = index_links(index_pages.select("html"), prefix)
    first = first_links_by_text(links).select(
        F.col("text").alias("project"), F.concat(F.lit(base), "href").alias("url")
    )
    return first.join(crawl.select("url", "html"), "url").select("project", "html")
