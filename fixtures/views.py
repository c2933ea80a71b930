"""Inputs derived from the given tables, in SQL that Spark and DuckDB both run.

``{pages}`` and ``{events}`` stand for the base tables. The few places where the two
dialects differ are marked ``<name>`` and filled in per engine.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wikiloom.operators import resolvers, routing
from wikiloom.session import staged

_HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"

PROBE_FORMS = [
    "http://@",
    "https://@",
    *[f"{s}://@{p}" for s in ("http", "https") for p in ("/api.php", "/w/api.php", "/wiki/api.php", "/api/v1")],
]

_DIALECT = {
    "spark": {
        "<steps>": "LATERAL VIEW posexplode(array(1, 7, 49, 343, 2401)) s AS step, div",
        "<forms>": "LATERAL VIEW explode(array("
        + ", ".join(f"'{f}'" for f in PROBE_FORMS)
        + ")) f AS form",
    },
    "duckdb": {
        "<steps>": "CROSS JOIN (VALUES (0, 1), (1, 7), (2, 49), (3, 343), (4, 2401)) s(step, div)",
        "<forms>": "CROSS JOIN (VALUES "
        + ", ".join(f"('{f}')" for f in PROBE_FORMS)
        + ") f(form)",
    },
}

VIEWS = {
    "fx_catalog_raw": f"""
SELECT page_id AS seq,
       CASE WHEN page_id % 19 = 0 THEN '!disabled' ELSE split_part(host, '.', 1) END AS referenceid,
       'https://' || host || '/w/api.php' AS endpoint,
       CASE split_part(host, '.', 1) WHEN 'm' THEN 'wikia' WHEN 'www' THEN 'custom' ELSE 'generic' END AS resolverid,
       CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '!random' WHEN 1 THEN '#00cc99' WHEN 2 THEN '0x1F' WHEN 3 THEN '010' ELSE 'bogus' END AS displaycolor
FROM (SELECT page_id, {_HOST} AS host FROM {{pages}}) t
""",
    "fx_candidates": f"""
SELECT page_id AS cand_id,
       CASE WHEN page_id % 23 = 5 THEN 'not a url'
            WHEN page_id % 7 = 2 THEN 'http://' || host || '///'
            WHEN page_id % 7 = 3 THEN 'http://' || substr(host, 3)
            WHEN page_id % 7 = 4 THEN 'http://new' || CAST(page_id AS STRING) || '.' || host
            ELSE 'http://' || host END AS url
FROM (SELECT page_id, {_HOST} AS host FROM {{pages}}) t
""",
    "fx_probe": """
SELECT cand_id, step,
       CASE WHEN digit < 3 THEN 200 WHEN digit = 6 THEN NULL ELSE 404 END AS status
FROM (SELECT page_id AS cand_id, step, CAST(floor((page_id * 7919 % 16807) / div) AS BIGINT) % 7 AS digit
      FROM {pages} <steps>) t
""",
    "fx_probe_log": f"""
SELECT probed AS url,
       CASE WHEN substr(md5(probed), 1, 1) < 'a' THEN 200 WHEN substr(md5(probed), 1, 1) = 'f' THEN NULL ELSE 404 END AS status
FROM (SELECT replace(form, '@', host) AS probed FROM (SELECT DISTINCT {_HOST} AS host FROM {{pages}}) h <forms>) t
""",
    "fx_dump": f"""
SELECT page_id AS id,
       split_part({_HOST}, '.', 1) AS prefix,
       CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'English' WHEN 1 THEN 'english' WHEN 2 THEN '' WHEN 3 THEN 'French' ELSE 'German' END AS lang,
       CASE WHEN page_id % 11 = 0 THEN 'nohost' ELSE url END AS statsurl,
       CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '404' WHEN 1 THEN '500' WHEN 2 THEN 'n/a' ELSE '200' END AS http
FROM {{pages}}
""",
    # Dumps as fetched: some lack the language, some the prefix, some do not exist.
    "fx_bodies": f"""
SELECT 'project' || CAST(page_id AS STRING) AS source,
       CASE WHEN page_id % 13 = 7 THEN 'error: table name not set or unknown'
            WHEN page_id % 4 = 0 THEN
              'id,prefix,http' || chr(10) || '1,' || prefix || ',200' || chr(10) || '2,"m",404' || chr(10) || '3,"x ""y"", z",200' || chr(10) || '4,"x"y,200' || chr(10) || '5,6" z,404' || chr(13) || chr(10) || '6,"two' || chr(10) || 'lines",200' || chr(10)
            WHEN page_id % 4 = 1 THEN
              'id,lang,prefix' || chr(10) || '1,German,de' || chr(10) || '2,,' || prefix || chr(10) || '3,ENGLISH,www' || chr(10)
            ELSE
              'lang,statsurl,http,note' || chr(10) || 'English,' || url || ',200,"a, b"' || chr(10) || ',' || url || ',404,' || chr(10) || 'French,' || url || ',200,' || chr(10) || 'English,' || url || ',n/a,'
       END AS body
FROM (SELECT page_id, url, split_part({_HOST}, '.', 1) AS prefix FROM {{pages}}) t
""",
    "fx_display": f"""
SELECT 'project' || CAST(page_id AS STRING) AS project,
       '<table><tr><td><a href="display">' || prefix || '</a><td><a href="http://' || host || '/wiki/"> ' || prefix || ' </a></table>' AS html
FROM (SELECT page_id, {_HOST} AS host, split_part({_HOST}, '.', 1) AS prefix FROM {{pages}}) t
""",
    # Fifty pages per directory; a page shows at most nine pages ahead.
    "fx_paginator": """
SELECT term, page_no, CAST(least(page_no + 9, last_page) AS INT) AS last_shown, last_page
FROM (SELECT 'https://directory.example/' || CAST(CAST(floor(page_id / 50) AS BIGINT) AS STRING) AS term,
             CAST(page_id % 50 + 1 AS INT) AS page_no,
             CAST(21 + CAST(floor(page_id / 50) AS BIGINT) * 17 % 30 AS INT) AS last_page
      FROM {pages}) t
""",
    "fx_crawl": f"""
SELECT page_id, term, page_no, term || '?page=' || CAST(page_no AS STRING) AS url,
       html || CASE CAST(page_id % 3 AS INT)
         WHEN 0 THEN '<div class="wikis wiki"><p><a href="http://' || host || '">Wiki</a></div><a title="a > b" class="result-link" href="http://' || host || '&#47;/">Found</a>'
         WHEN 1 THEN '<!-- <a class="result-link" href="http://no.org">no</a> --><UL><LI CLASS=wiki title=it' || chr(39) || 's><A title="a > b"" HREF=http://' || host || '>Wiki</A><li><a href=http://out.org>out</a></UL>'
              || '<A CLASS="z RESULT-LINK"id=x href=' || chr(39) || 'http://' || host || '&#47;/' || chr(39) || '>Found</a>'
         ELSE '<script>var t = "<a class=wiki href=http://no.org>";</script><table><tr class=wiki><td><a =x href = "http://' || host || '">Wiki</a><tr><td><a href="http://out.org">out</a></table>'
              || '<span data-x=' || chr(39) || '<a class=result-link>' || chr(39) || '></span><a href="http://' || host || '&#47;/" class = result-link / >Found' END
       || '<div><a class="b-pagination-item" href="?page=1">1</a><a class="b-pagination-item" href="?page=2"> ' || CAST(last_page AS STRING)
       || '</a><span class="b-pagination-item">next</span><a class="paginator-page">1</a><a class="paginator-page"><b>'
       || CAST(least(page_no + 9, last_page) AS STRING) || '</b></a></div>' AS html
FROM (SELECT page_id, html, {_HOST} AS host,
             'https://directory.example/' || CAST(CAST(floor(page_id / 50) AS BIGINT) AS STRING) AS term,
             CAST(page_id % 50 + 1 AS INT) AS page_no,
             CAST(21 + CAST(floor(page_id / 50) AS BIGINT) * 17 % 30 AS INT) AS last_page
      FROM {{pages}}) t
""",
    "fx_messages": """
SELECT event_id, ts, user_id,
       CASE CAST(event_id % 10 AS INT)
         WHEN 0 THEN 'wiki help'
         WHEN 1 THEN 'wiki  help'
         WHEN 2 THEN 'wiki '
         WHEN 3 THEN 'wiki BLOG'
         WHEN 4 THEN 'wiki nosuch ' || event_type
         WHEN 5 THEN 'wiki   Blog   the  ' || event_type || ' '
         WHEN 6 THEN 'WIKI www  the'
         WHEN 7 THEN 'wiki M the'
         WHEN 8 THEN 'wiki blog qqqq'
         ELSE 'hello ' || event_type END AS content
FROM {events}
""",
    "fx_articles": f"""
SELECT page_id AS article_id,
       {_HOST} AS host,
       url AS page_url,
       regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
       CASE WHEN page_id % 4 = 0 THEN '' ELSE regexp_extract(html, '<p>([^<]+)', 1) END AS section_text,
       regexp_extract(html, '<p>([^<]+)', 1) AS abstract_text,
       CASE CAST(page_id % 10 AS INT) WHEN 0 THEN 14 WHEN 1 THEN 2 ELSE 0 END AS ns,
       CAST(page_id % 3 AS INT) AS quality,
       CASE WHEN page_id % 6 = 0 THEN NULL ELSE url || '/thumb.png' END AS thumb_url,
       100 + (page_id * 37) % 900 AS thumb_w,
       100 + (page_id * 53) % 400 AS thumb_h
FROM {{pages}}
""",
    # Titles, pairs of words of the lead text, and a word that is nearly everywhere.
    "fx_requests": f"""
SELECT DISTINCT host, query
FROM (SELECT {_HOST} AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS query FROM {{pages}}
      UNION ALL
      SELECT {_HOST}, split_part(regexp_extract(html, '<p>([^<]+)', 1), ' ', 3) || ' THE ' || split_part(regexp_extract(html, '<p>([^<]+)', 1), ' ', 5) FROM {{pages}}
      UNION ALL
      SELECT {_HOST}, 'the' FROM {{pages}}) t
""",
    "fx_lifecycle": """
SELECT event_id, ts, CAST(user_id % 16 AS BIGINT) AS shard,
       CASE event_type WHEN 'signup' THEN 'ready' WHEN 'view' THEN 'reconnected' WHEN 'click' THEN 'resumed' WHEN 'error' THEN 'disconnected' ELSE 'message' END AS kind
FROM {events}
""",
}

# The first article of each title, as titles name pages.
VIEWS["fx_wiki_pages"] = f"""
SELECT article_id, host, page_url, title, section_text, abstract_text, ns, quality, thumb_url, thumb_w, thumb_h
FROM (SELECT *, row_number() OVER (PARTITION BY host, title ORDER BY article_id) AS rn FROM ({VIEWS["fx_articles"]}) a) t WHERE rn = 1
"""
# Messages about each page: its title, two words of its lead text, or the start of its title. Requests grow with the pages.
VIEWS["fx_asks"] = f"""
SELECT page_id AS event_id, TIMESTAMP '2024-03-01 10:00:00' AS ts, page_id % 97 AS user_id,
       CASE CAST(page_id % 3 AS INT)
         WHEN 0 THEN 'Wiki ' || wiki || '  ' || title
         WHEN 1 THEN 'wiki ' || upper(wiki) || ' ' || split_part(lead, ' ', 3) || ' the ' || split_part(lead, ' ', 5)
         ELSE 'wiki ' || wiki || ' ' || split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2) END AS content
FROM (SELECT page_id, split_part({_HOST}, '.', 1) AS wiki, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
             regexp_extract(html, '<p>([^<]+)', 1) AS lead FROM {{pages}}) t
"""

# Long words of titles: a list that grows with the pages.
_DIALECT["spark"]["<each>"] = "explode(split(title, ' ')) AS word"
_DIALECT["duckdb"]["<each>"] = "unnest(string_split(title, ' ')) AS word"
VIEWS["fx_words"] = """
SELECT DISTINCT word FROM (SELECT <each> FROM (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM {pages}) t) w WHERE length(word) > 8
"""

WORDS = ["The", "onde", "zzzz"]


def _sql(name: str, engine: str) -> str:
    text = VIEWS[name]
    for mark, filling in _DIALECT[engine].items():
        text = text.replace(mark, filling)
    return text


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: base(spark, sf_dir, t) for t in ("pages", "events") if f"{{{t}}}" in VIEWS[name]}
    return spark.sql(_sql(name, "spark"), **tables)


def stream_view(spark: SparkSession, sf_dir: str, name: str, table: str) -> DataFrame:
    """The view over ``table`` read as a stream of files; the table is one file or a folder of files."""
    # As a pattern, for a stream over a plain path takes it for a folder.
    rows = spark.readStream.schema(base(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parque[t]")
    return spark.sql(_sql(name, "spark"), **{table: rows})


@cache
def duckdb_view(name: str) -> str:
    return _sql(name, "duckdb").replace("{pages}", "pages").replace("{events}", "events")


def with_views(query: str) -> str:
    """``query`` with the views it names written out before it."""
    query = query.strip()
    ctes = [f"{v} AS ({duckdb_view(v)})" for v in VIEWS if re.search(rf"\b{v}\b", query)]
    start = re.match(r"WITH (RECURSIVE )?", query)
    if start:
        ctes.append(query[start.end():])
        return f"{start[0]}" + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + query


def _xml_text(column: str) -> Column:
    text = F.col(column)
    for character, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(character), F.lit(reference))
    return text


def titled_pages(articles: DataFrame) -> DataFrame:
    """The first article of each title and host, with the endpoints of both kinds."""
    first = articles.groupBy("host", "title").agg(F.min("article_id").alias("article_id"))
    return (
        articles.join(first.select("article_id"), "article_id", "left_semi")
        .withColumn("generic", F.concat(F.lit("https://"), "host", F.lit("/w/api.php")))
        .withColumn("wikia", F.concat(F.lit("https://"), "host", F.lit("/api/v1")))
    )


def responses(articles: DataFrame) -> DataFrame:
    """What the wikis would answer if each title is searched for; ``url, body``."""
    pages = titled_pages(articles)
    asked = [pages.select("*", F.col(k).alias("endpoint"), F.col("title").alias("query"), F.lit(k).alias("resolver")) for k in ("generic", "wikia")]
    return answered_by_wikis(asked[0].unionByName(asked[1]), F.col("page_url"), F.lit("/wiki"))


def simulated_wikis(requests: DataFrame, articles: DataFrame) -> DataFrame:
    """What the wikis would answer to requests ``endpoint, query, resolver``, also to those without a hit; ``url, body``."""
    hits = resolvers.resolve(requests, articles).select("endpoint", "query", "resolver", "article_id")
    asked = requests.filter("resolver IS NOT NULL").select("endpoint", "query", "resolver").distinct()
    # They send no more of a lead text than they are asked for.
    sent = articles.withColumn("abstract_text", F.left("abstract_text", F.lit(resolvers.EXTRACT_LENGTH)))
    asked = asked.join(staged(hits, "hits"), ["endpoint", "query", "resolver"], "left").join(sent, "article_id", "left")
    site = F.regexp_extract("page_url", "^(https?://[^/?#]*)", 1)
    path = F.substring(F.col("page_url"), F.length(site) + 1, F.length("page_url"))
    return answered_by_wikis(staged(asked, "asked"), site, path)


def answered_by_wikis(pages: DataFrame, site: Column, path: Column) -> DataFrame:
    """Responses to requests ``endpoint, query, resolver`` with the article that is found, if any."""

    def by_search(kind: str, body: Column) -> DataFrame:
        return routing.search_requests(pages.filter(F.col("resolver") == kind)).select("url", body.alias("body"))

    def by_page(kind: str, bodies: dict[str, Column]) -> DataFrame:
        hits = pages.filter((F.col("resolver") == kind) & F.col("article_id").isNotNull())
        hits = hits.dropDuplicates(["endpoint", "article_id"])
        fetched = routing.page_requests(hits.withColumns(bodies), keep=list(bodies))
        body = F.coalesce(*[F.when(F.col("kind") == k, F.col(k)) for k in bodies])
        return fetched.select("url", body.alias("body"))

    has_hit = F.col("article_id").isNotNull()
    found_xml = F.when(
        has_hit,
        F.concat(F.lit('<api><query><search><p title="'), _xml_text("title"), F.lit('"/><p title="Other"/></search></query></api>')),
    ).otherwise("<api><query><search/></query></api>")
    page_xml = F.concat(
        F.lit('<api><query><pages><page fullurl="'), _xml_text("page_url"), F.lit('"><extract xml:space="preserve">'),
        _xml_text("abstract_text"), F.lit("</extract>"),
        F.coalesce(F.concat(F.lit('<thumbnail source="'), _xml_text("thumb_url"), F.lit('"/>')), F.lit("")),
        F.lit("</page></pages></query></api>"),
    )
    found_json = F.when(
        has_hit, F.to_json(F.struct(F.lit(1).alias("total"), F.array(F.struct(F.col("article_id").alias("id"))).alias("items")))
    ).otherwise('{"total": 0, "items": []}')
    content = F.when(F.col("section_text") != "", F.array(F.struct(F.col("section_text").alias("text")))).otherwise(
        F.array().cast("array<struct<text:string>>")
    )
    sections_json = F.to_json(F.struct(F.array(F.struct(content.alias("content"))).alias("sections")))
    item = F.struct(
        path.alias("url"), "title", F.col("thumb_url").alias("thumbnail"), F.left("abstract_text", F.lit(500)).alias("abstract")
    )
    details_json = F.to_json(
        F.struct(site.alias("basepath"), F.create_map(F.coalesce(F.col("article_id"), F.lit(0)).cast("string"), item).alias("items"))
    )
    return (
        by_search("generic", found_xml)
        .unionByName(by_page("generic", {"page_info": page_xml}))
        .unionByName(by_search("wikia", found_json))
        .unionByName(by_page("wikia", {"sections": sections_json, "details": details_json}))
    )
