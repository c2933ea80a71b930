"""DuckDB SQL with the results that each registered query must give."""

from __future__ import annotations

from fixtures.views import WORDS, with_views
from wikiloom.operators.probes import GENERIC_SUFFIXES, WIKIA_SUFFIXES
from wikiloom.operators.languages import iso_languages
from wikiloom.plans.retrievers import registered_sources

LANGUAGES = [(name, code) for _, name, code in iso_languages()]


def host(url: str) -> str:
    return (
        f"CASE WHEN regexp_matches({url}, '^(?i)(https?|ftp)://') "
        f"THEN regexp_extract({url}, '^(?i)(?:https?|ftp)://([^/?#:]*)', 1) END"
    )


def label(url: str) -> str:
    h = host(url)
    return (
        f"CASE WHEN length({h}) - length(replace({h}, '.', '')) > 1 "
        f"THEN split_part({h}, '.', 1) ELSE '!disabled' END"
    )


# -- catalogue ------------------------------------------------------------------

_OCTAL = (
    "list_sum(list_transform(range(length(o)), lambda i: CAST(substr(o, CAST(i AS INT) + 1, 1) AS BIGINT)"
    " * CAST(pow(8, length(o) - i - 1) AS BIGINT)))"
)


def loaded(source: str = "fx_catalog_raw", order: str = "seq", keep: str = "rn = 1") -> str:
    """Loaded endpoints as a subquery."""
    return f"""(
  SELECT {order}, referenceid, endpoint, resolverid,
         CAST(coalesce(n & 16777215, CAST('0x' || substr(md5(referenceid), 1, 6) AS BIGINT)) AS INT) AS color,
         CASE WHEN displaycolor = '!random' THEN 'random' WHEN n IS NULL THEN 'undecodable' ELSE 'literal' END AS color_source
  FROM (SELECT *, CASE WHEN h <> '' THEN CAST('0x' || h AS BIGINT) WHEN o <> '' THEN CAST({_OCTAL} AS BIGINT) WHEN d <> '' THEN CAST(d AS BIGINT) END AS n
        FROM (SELECT *, regexp_extract(displaycolor, '^(?:0[xX]|#)([0-9a-fA-F]+)$', 1) AS h,
                     regexp_extract(displaycolor, '^0([0-7]+)$', 1) AS o,
                     regexp_extract(displaycolor, '^(0|[1-9][0-9]*)$', 1) AS d,
                     row_number() OVER (PARTITION BY referenceid ORDER BY {order}) AS rn
              FROM {source} WHERE referenceid <> '!disabled') t1
        WHERE {keep}) t2)"""


_UNION = """(
  SELECT 0 AS priority, * FROM fx_catalog_raw
  UNION ALL
  SELECT 1 AS priority, * REPLACE (split_part(endpoint, '.', 2) AS referenceid) FROM fx_catalog_raw) u"""

# -- probes ---------------------------------------------------------------------

_KNOWN = f"""h IS NOT NULL AND EXISTS (SELECT 1 FROM {loaded()} e WHERE contains(e.endpoint, h))"""

NEW_CANDIDATES = f"(SELECT cand_id, url FROM (SELECT *, {host('url')} AS h FROM fx_candidates) c WHERE NOT coalesce({_KNOWN}, false))"


def _chain(base: str, statuses: list[str], suffixes: list[str]) -> str:
    sql = "NULL"
    for status, suffix in reversed(list(zip(statuses, suffixes))):
        sql = f"CASE WHEN {status} = 200 THEN {base} || '{suffix}' WHEN {status} IS NULL THEN NULL ELSE {sql} END"
    return sql


def by_step(candidates: str, suffixes: list[str]) -> str:
    later = [f"s{i + 2}" for i in range(len(suffixes))]
    secure = "replace(url, 'http://', 'https://')"
    return f"""(
  SELECT cand_id, url, endpoint FROM (
    SELECT c.cand_id, url, CASE WHEN {host('url')} IS NULL THEN NULL WHEN s0 = 200 THEN {_chain('url', later, suffixes)}
           WHEN s0 IS NOT NULL AND s1 = 200 THEN {_chain(secure, later, suffixes)} END AS endpoint
    FROM {candidates} c JOIN (SELECT cand_id, {', '.join(f'max(CASE WHEN step = {i} THEN status END) AS s{i}' for i in range(5))} FROM fx_probe GROUP BY cand_id) p ON p.cand_id = c.cand_id) r
  WHERE endpoint IS NOT NULL)"""


def by_url(links: str, suffixes: list[str]) -> str:
    """Links with their endpoint from the log; every status is looked up by its URL."""

    def status(url: str) -> str:
        return f"(SELECT max(status) FROM fx_probe_log g WHERE g.url = {url})"

    secure = "replace(l.url, 'http://', 'https://')"
    direct = _chain("l.url", [status(f"l.url || '{s}'") for s in suffixes], suffixes)
    secured = _chain(secure, [status(f"{secure} || '{s}'") for s in suffixes], suffixes)
    return f"""(
  SELECT * FROM (SELECT l.*, CASE WHEN {host('l.url')} IS NULL THEN NULL WHEN {status('l.url')} = 200 THEN {direct}
         WHEN {status('l.url')} IS NOT NULL AND {status(secure)} = 200 THEN {secured} END AS found
  FROM {links} l) r WHERE found IS NOT NULL)"""


def named(verified: str, resolver: str) -> str:
    return f"(SELECT cand_id AS seq, {label('endpoint')} AS referenceid, endpoint, '{resolver}' AS resolverid, CAST(NULL AS INT) AS color FROM {verified} v)"


VERIFIED = by_step(NEW_CANDIDATES, GENERIC_SUFFIXES)
NAMED = named(VERIFIED, "generic")
ADDED = f"(SELECT * FROM {NAMED} n WHERE endpoint NOT IN (SELECT endpoint FROM fx_catalog_raw))"


def added_source(links: str, suffixes: list[str], resolver: str) -> str:
    """The catalogue and what a pipeline adds to it; ``links`` has url, source, seq, pos."""
    fresh = f"(SELECT url, source, seq, pos FROM (SELECT *, {host('url')} AS h FROM {links} k) c WHERE NOT coalesce({_KNOWN}, false))"
    return f"""
SELECT 0 AS part, '' AS source, seq, 0 AS pos, referenceid, endpoint, resolverid, displaycolor FROM fx_catalog_raw
UNION ALL
SELECT 1, source, seq, pos, {label('found')}, found, '{resolver}', '!random' FROM {by_url(fresh, suffixes)} v
WHERE found NOT IN (SELECT endpoint FROM fx_catalog_raw)"""


# -- dumps ----------------------------------------------------------------------

_PREFIX = "split_part(regexp_extract(url, '^https?://([^/?#:]+)', 1), '.', 1)"
_SOURCE = "'project' || CAST(page_id AS STRING)"

# What the dump bodies were made from.
DUMP_ROWS = f"""(
  SELECT {_SOURCE} AS source, k.line_no AS line_no,
    CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ['German', '', 'ENGLISH'][k.line_no + 1] ELSE ['English', '', 'French', 'English'][k.line_no + 1] END AS lang,
    CASE page_id % 4 WHEN 0 THEN [{_PREFIX}, 'm', 'x "y", z', '"x"y', '6" z', 'two' || chr(10) || 'lines'][k.line_no + 1] WHEN 1 THEN ['de', {_PREFIX}, 'www'][k.line_no + 1] END AS prefix,
    CASE WHEN page_id % 4 > 1 THEN url END AS statsurl,
    CASE page_id % 4 WHEN 0 THEN ['200', '404', '200', '200', '404', '200'][k.line_no + 1] WHEN 1 THEN NULL ELSE ['200', '404', '200', 'n/a'][k.line_no + 1] END AS http
  FROM pages CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) k(line_no)
  WHERE page_id % 13 <> 7 AND k.line_no < [6, 3, 4, 4][page_id % 4 + 1])"""

DUMP_LINKS = f"""(
  SELECT CASE WHEN prefix IS NOT NULL THEN
           CASE WHEN EXISTS (SELECT 1 FROM (SELECT {_SOURCE} AS s, {_PREFIX} AS p FROM pages) o JOIN {DUMP_ROWS} r2 ON r2.source = o.s AND r2.prefix = o.p
                             WHERE o.s = r.source AND (r2.lang IS NULL OR lower(r2.lang) IN ('english', '')))
                THEN 'http://' || replace(own_host, own_prefix, prefix) ELSE '' END
         ELSE 'http://' || own_host END AS url,
         r.source AS source, CAST(line_no AS BIGINT) AS seq, 0 AS pos
  FROM {DUMP_ROWS} r JOIN (SELECT {_SOURCE} AS s, {_PREFIX} AS own_prefix, {host('url')} AS own_host FROM pages) o ON o.s = r.source
  WHERE (lang IS NULL OR lower(lang) IN ('english', '')) AND (prefix IS NOT NULL OR http IN ('200', '404')))"""

_GROUP = "'https://directory.example/' || CAST(CAST(floor(page_id / 50) AS BIGINT) AS STRING)"
_PLACED = f"(SELECT page_id, {host('url')} AS h, {_GROUP} AS term, page_id % 50 + 1 AS page_no, 21 + CAST(floor(page_id / 50) AS BIGINT) * 17 % 30 AS last_page FROM pages)"

DIRECTORY_LINKS = f"(SELECT 'http://' || h AS url, term AS source, page_no AS seq, 0 AS pos FROM {_PLACED} p WHERE page_no <= last_page)"

LAST_PAGES = """
WITH RECURSIVE chase AS (
  SELECT term, page_no, last_shown FROM fx_paginator WHERE page_no = 1
  UNION ALL
  SELECT p.term, p.page_no, p.last_shown FROM chase c JOIN fx_paginator p ON p.term = c.term AND p.page_no = c.last_shown
  WHERE c.last_shown <> c.page_no)
SELECT term, page_no AS last_page FROM chase WHERE page_no = last_shown"""

SEARCH_LINKS = f"""(
  SELECT 'http://' || h AS url, term || ' en' AS source, page_no AS seq, 0 AS pos FROM {_PLACED} p
  WHERE page_no <= last_page AND contains(h, 'example.com')
    AND EXISTS (SELECT 1 FROM {_PLACED} q WHERE q.term = p.term AND q.page_no = p.last_page))"""

# -- search ---------------------------------------------------------------------


def top1(requests: str, articles: str) -> str:
    """Best article per (host, query), from every pair that shares a word."""
    words = "unnest(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'))"
    return f"""(
  SELECT host, query, article_id, exact_title, title_terms, lead_terms FROM (
    SELECT s.host, s.query, s.article_id, CAST(lower(a.title) = lower(s.query) AS INT) AS exact_title, title_terms, lead_terms,
           row_number() OVER (PARTITION BY s.host, s.query ORDER BY lower(a.title) = lower(s.query) DESC, title_terms DESC, lead_terms DESC, s.article_id) AS rn
    FROM (SELECT r.host, r.query, w.article_id, CAST(sum(in_title) AS INT) AS title_terms, CAST(sum(in_lead) AS INT) AS lead_terms
          FROM (SELECT DISTINCT host, query, {words.format('query')} AS term FROM {requests} q) r
          JOIN (SELECT host, article_id, term, max(in_title) AS in_title, max(in_lead) AS in_lead
                FROM (SELECT host, article_id, {words.format('title')} AS term, 1 AS in_title, 0 AS in_lead FROM {articles} a1
                      UNION ALL SELECT host, article_id, {words.format('abstract_text')}, 0, 1 FROM {articles} a2) p
                WHERE term <> '' GROUP BY host, article_id, term) w
          ON w.host = r.host AND w.term = r.term
          GROUP BY r.host, r.query, w.article_id) s
    JOIN {articles} a ON a.article_id = s.article_id) t
  WHERE rn = 1)"""


ALL_ARTICLES = "fx_articles"
WIKIA_ARTICLES = "(SELECT * FROM fx_articles WHERE ns IN (0, 14) AND quality >= 1)"

# -- messages -------------------------------------------------------------------

ROUTED = """(
  SELECT *, CASE WHEN content = 'wiki help' THEN 'help' WHEN wiki_key = 'help' THEN 'ignored' ELSE 'query' END AS route
  FROM (SELECT *, lower(words[2]) AS wiki_key, CASE WHEN len(words) > 2 THEN array_to_string(words[3:], ' ') END AS query
        FROM (SELECT *, string_split(regexp_replace(trim(content), ' +', ' ', 'g'), ' ') AS words FROM fx_messages WHERE starts_with(lower(content), 'wiki ')) m1) m2)"""

LOOKUP = f"""(
  SELECT lower(referenceid) AS k, arg_min(endpoint, seq) AS endpoint, arg_min(resolverid, seq) AS resolverid, arg_min(color, seq) AS color,
         arg_min(referenceid, seq) AS referenceid
  FROM {loaded()} e GROUP BY 1)"""

ASKED = f"""(
  SELECT wiki_key, query, referenceid, endpoint, resolverid, color, {host('endpoint')} AS host
  FROM (SELECT DISTINCT wiki_key, query FROM {ROUTED} r WHERE route = 'query' AND query IS NOT NULL) q LEFT JOIN {LOOKUP} l ON l.k = q.wiki_key)"""


def asked_of(resolver: str) -> str:
    return f"(SELECT DISTINCT host, endpoint, query FROM {ASKED} k WHERE resolverid = '{resolver}')"


def last_sentence(text: str, keep: str) -> str:
    last = f"regexp_extract_all({text}, '([A-z].*?[.])', 1)[-1]"
    at = f"(length({text}) - instr(reverse({text}), reverse({last})) - length({last}) + 1)"
    if keep == "end":
        return f"CASE WHEN {last} IS NULL THEN {text} ELSE substr({text}, 1, {at} + length({last})) END"
    return f"CASE WHEN {at} = 0 THEN {text} WHEN {last} IS NOT NULL THEN substr({text}, 1, {at}) END"


def cards(requests: str, articles: str, summary: str) -> str:
    return f"""(
  SELECT endpoint, t.query AS query, a.article_id AS article_id, title, {summary} AS summary, coalesce(thumb_url, '') AS thumb_url, page_url, thumb_w, thumb_h
  FROM {requests} r JOIN {top1(requests, articles)} t ON t.host = r.host AND t.query = r.query JOIN fx_articles a ON a.article_id = t.article_id)"""


_GENERIC_SUMMARY = "replace(left(abstract_text, 1200), '....', '.')"


def _wikia_summary(keep: str) -> str:
    return f"CASE WHEN section_text <> '' THEN section_text ELSE {last_sentence('left(abstract_text, 500)', keep)} END"


# Requests with every host that the articles have.
_EVERY = "(SELECT DISTINCT host, 'https://' || host || '/w/api.php' AS endpoint, query FROM fx_requests)"

GENERIC_CARDS = cards(asked_of("generic"), ALL_ARTICLES, _GENERIC_SUMMARY)
WIKIA_CARDS = cards(asked_of("wikia"), WIKIA_ARTICLES, _wikia_summary("end"))

ANSWERED = f"""(
  SELECT m.event_id, m.ts, m.wiki_key, m.query, k.endpoint, k.color, c.article_id, c.title, c.summary, c.thumb_url, c.page_url, c.thumb_w, c.thumb_h,
         CASE WHEN len(words) = 1 THEN 'no_wiki_prefix' WHEN len(words) = 2 THEN 'no_query' WHEN k.endpoint IS NULL THEN 'unknown_prefix'
              WHEN k.resolverid NOT IN ('generic', 'wikia') THEN 'unknown_resolver' WHEN c.article_id IS NULL THEN 'no_result' ELSE 'result' END AS outcome
  FROM {ROUTED} m LEFT JOIN {ASKED} k ON k.wiki_key = m.wiki_key AND k.query = m.query
  LEFT JOIN (SELECT * FROM {GENERIC_CARDS} UNION ALL SELECT * FROM {WIKIA_CARDS}) c ON c.endpoint = k.endpoint AND c.query = k.query
  WHERE route = 'query')"""

_SHOWN = f"""title, page_url AS title_link, summary, color,
  'From ' || {host('endpoint')} || ' | Requested ' || strftime(ts, '%m/%d/%Y') AS footer,
  CASE WHEN thumb_url <> '' AND thumb_w / thumb_h > 1.75 THEN thumb_url END AS image_url,
  CASE WHEN thumb_url <> '' AND thumb_w / thumb_h <= 1.75 THEN thumb_url END AS thumbnail_url"""

RESULT_CARDS = f"SELECT event_id, {_SHOWN} FROM {ANSWERED} z WHERE outcome = 'result'"

ANSWER_MESSAGES = f"""
SELECT z.event_id, z.outcome, s.* EXCLUDE (event_id) FROM {ANSWERED} z LEFT JOIN ({RESULT_CARDS}) s ON s.event_id = z.event_id"""


def encoded(text: str) -> str:
    """Form encoding, which writes a space as plus and keeps the asterisk."""
    return f"replace(replace(replace(url_encode({text}), '%20', '+'), '%2A', '*'), '~', '%7E')"


_EVERY_HIT = f"(SELECT endpoint, title, a.article_id FROM {_EVERY} r JOIN {top1(_EVERY, ALL_ARTICLES)} t ON t.host = r.host AND t.query = r.query JOIN fx_articles a ON a.article_id = t.article_id)"

REQUEST_PLAN = f"""
SELECT DISTINCT * FROM (
  SELECT 'search' AS kind, endpoint || '?action=query&srsearch=' || {encoded('query')} || '&srprop&list=search&format=xml' AS url FROM {asked_of('generic')} g
  UNION ALL
  SELECT 'search', endpoint || '/Search/List?query=' || replace(query, ' ', '%20') || '&limit=1&minArticleQuality=1&batch=1&namespaces=0%2C14' FROM {asked_of('wikia')} w
  UNION ALL
  SELECT 'page_info', endpoint || '?action=query&titles=' || {encoded('title')} || '&prop=extracts%7Cinfo%7Cpageimages&pithumbsize=800&inprop=url&exintro&explaintext&exchars=1200&format=xml' FROM {GENERIC_CARDS} p
  UNION ALL
  SELECT 'sections', endpoint || '/Articles/AsSimpleJson?id=' || article_id FROM {WIKIA_CARDS} s
  UNION ALL
  SELECT 'details', endpoint || '/Articles/Details?ids=' || article_id || '&abstract=500' FROM {WIKIA_CARDS} d) x"""



def _about_pages(sql: str) -> str:
    """The same for the messages that ask about pages, of wikis where titles name pages."""
    return sql.replace("fx_messages", "fx_asks").replace("fx_articles", "fx_wiki_pages")


_TITLED = "(SELECT * FROM fx_articles WHERE article_id IN (SELECT min(article_id) FROM fx_articles GROUP BY host, title))"

_DOC_WORDS = ", ".join(f"'{w}'" for w in WORDS)

_REGISTERED = ", ".join(f"('{r}', '{s}')" for r, names in registered_sources().items() for s in names)

_LANGUAGE_ROWS = ", ".join(f"('{n}', '{c}')" for n, c in LANGUAGES)

_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
_LINKS = "regexp_extract_all(html, '<a href=\"(/t[^\"]*)\">[^<]*</a>', 1)"
_TEXTS = "regexp_extract_all(html, '<a href=\"/t[^\"]*\">([^<]*)</a>', 1)"

_FUNNEL = f"""
SELECT count(*) AS found, count(*) FILTER (in_language) AS in_language, count(*) FILTER (link IS NOT NULL) AS links,
       count(*) FILTER (link IS NOT NULL AND NOT known) AS unknown_hosts,
       count(*) FILTER (link IS NOT NULL AND NOT known AND v.endpoint IS NOT NULL) AS verified
FROM (SELECT *, coalesce({_KNOWN}, false) AS known FROM (
        SELECT *, {host('link')} AS h FROM (
          SELECT *, CASE WHEN in_language AND try_cast(http AS INT) IN (200, 404) THEN 'http://' || {host('statsurl')} END AS link
          FROM (SELECT *, lower(lang) IN ('english', '') AS in_language FROM fx_dump) d0) d1) d2) d
LEFT JOIN {by_step("(SELECT id AS cand_id, 'http://' || " + host('statsurl') + " AS url FROM fx_dump)", GENERIC_SUFFIXES)} v ON v.cand_id = d.id"""

ORACLES = {
    "catalog_load": f"SELECT * FROM {loaded()} e",
    "catalog_load_reference": f"SELECT * FROM {loaded(keep='rn <> 2')} e",
    "catalog_union": f"SELECT * FROM {loaded(_UNION, 'priority, seq')} e",
    "catalog_export": f"""
SELECT 0 AS part, '' AS source, seq, 0 AS pos, referenceid, endpoint, resolverid, displaycolor FROM fx_catalog_raw
UNION ALL SELECT 1, '', seq, 0, referenceid, endpoint, resolverid, '!random' FROM {ADDED} a""",
    "dump_scan": f"""
SELECT source, line_no, lang, prefix, statsurl, http, false AS missing FROM {DUMP_ROWS} r
UNION ALL SELECT {_SOURCE}, NULL, NULL, NULL, NULL, NULL, true FROM pages WHERE page_id % 13 = 7""",
    "source_listing": f"""
SELECT * FROM (VALUES {_REGISTERED}) v(retriever, source)
UNION ALL SELECT 'wikistats', unnest({_TEXTS}) FROM pages""",
    "request_plan": REQUEST_PLAN,
    "probe_plan": f"""
SELECT cand_id, 0 AS step, url, NULL AS retry_url FROM fx_candidates
UNION ALL SELECT cand_id, 1, replace(url, 'http://', 'https://'), NULL FROM fx_candidates
"""
    + "".join(
        f"UNION ALL SELECT cand_id, {i + 2}, url || '{s}', replace(url, 'http://', 'https://') || '{s}' FROM fx_candidates\n"
        for i, s in enumerate(GENERIC_SUFFIXES)
    ),
    "harvest_links": f"""
SELECT 'a' AS selector, page_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS href FROM (SELECT page_id, {_HREFS} AS l FROM pages) h
UNION ALL SELECT '.wiki a', page_id, 0, 'http://' || {host('url')} FROM pages
UNION ALL SELECT '.result-link', page_id, 0, 'http://' || {host('url')} || '//' FROM pages""",
    "index_links": f"SELECT page_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS href, unnest(t) AS text FROM (SELECT page_id, {_LINKS} AS l, {_TEXTS} AS t FROM pages) h",
    "page_frontier": "SELECT seed, page_no, seed || '?page=' || page_no AS url FROM (SELECT term AS seed, CAST(unnest(range(1, last_page + 1)) AS INT) AS page_no FROM (SELECT DISTINCT term, last_page FROM fx_paginator) p) n",
    "paginator_chase": LAST_PAGES,
    "template_expand": f"""
SELECT id, project, prefix, CASE WHEN template IS NULL THEN '' ELSE 'http://' || replace(template, slot, prefix) END AS url
FROM (SELECT id, prefix, split_part(url_host, '.', -1) AS project FROM (SELECT *, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS url_host FROM fx_dump JOIN pages ON page_id = id) j) d
LEFT JOIN (SELECT split_part({host('statsurl')}, '.', -1) AS p, arg_min({host('statsurl')}, id) AS template, arg_min(prefix, id) AS slot FROM fx_dump WHERE {host('statsurl')} IS NOT NULL GROUP BY 1) t ON t.p = d.project""",
    "statsurl_links": f"SELECT id, 'http://' || {host('statsurl')} AS url FROM fx_dump WHERE try_cast(http AS INT) IN (200, 404) AND {host('statsurl')} IS NOT NULL",
    "language_filter": "SELECT id, lang FROM fx_dump WHERE lower(lang) IN ('english', '')",
    "link_normalize": "SELECT cand_id, rtrim(url, '/') AS url FROM fx_candidates WHERE contains(url, 'example.com')",
    "endpoint_naming": f"SELECT cand_id, url AS endpoint, {label('url')} AS referenceid, 'generic' AS resolverid, CAST(NULL AS INT) AS color FROM fx_candidates",
    "word_list_match": f"""
SELECT doc_id, contains(text, 'The') OR contains(text, 'onde') OR contains(text, 'zzzz') AS any_word,
       contains(lower(text), ' the ') OR contains(lower(text), ' onde ') OR contains(lower(text), ' zzzz ') AS spaced_word FROM documents""",
    "list_membership": f"""
SELECT doc_id, list_has_any(string_split(text, ' '), [{_DOC_WORDS}]) AS any_listed, list_contains(string_split(text, ' '), 'The') AS first_listed FROM documents""",
    "word_table_match": "SELECT doc_id, count(*) AS words, min(word) AS first_word FROM documents JOIN fx_words ON contains(text, word) GROUP BY doc_id",
    "spaced_word_table_match": "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM fx_words WHERE contains(lower(text), ' ' || lower(word) || ' '))",
    "list_membership_table": "SELECT doc_id FROM documents WHERE list_has_any(string_split(text, ' '), (SELECT list(word) FROM fx_words))",
    "route_stream_kept": _about_pages(ANSWER_MESSAGES),
    "ready_stream": """
SELECT shard, count(*) AS ready_events FROM fx_lifecycle WHERE kind = 'ready' GROUP BY shard
UNION ALL SELECT NULL, count(DISTINCT shard) FROM fx_lifecycle WHERE kind = 'ready'""",
    "known_host_anti": f"SELECT * FROM {NEW_CANDIDATES} c",
    "exact_url_anti": f"SELECT * FROM {ADDED} a",
    "probe_resolve": f"SELECT * FROM {by_step('fx_candidates', GENERIC_SUFFIXES)} v",
    "probe_resolve_single": f"SELECT * FROM {by_step('fx_candidates', WIKIA_SUFFIXES)} v",
    "probe_resolve_log": f"SELECT cand_id, url, found AS endpoint FROM {by_url('fx_candidates', GENERIC_SUFFIXES)} v",
    "language_lookup": f"SELECT id, lang AS language, code FROM fx_dump LEFT JOIN (VALUES {_LANGUAGE_ROWS}) v(name, code) ON lower(name) = lower(lang)",
    "catalog_lookup": f"SELECT event_id, wiki_key, referenceid, endpoint, resolverid, color FROM {ROUTED} m LEFT JOIN {LOOKUP} l ON l.k = m.wiki_key WHERE route = 'query'",
    "resolver_dispatch": f"SELECT event_id, endpoint, resolverid, CASE WHEN resolverid IN ('generic', 'wikia') THEN resolverid END AS resolver FROM {ROUTED} m LEFT JOIN {LOOKUP} l ON l.k = m.wiki_key WHERE route = 'query'",
    "resolve_generic": f"SELECT * FROM {cards(_EVERY, ALL_ARTICLES, _GENERIC_SUMMARY)} c",
    "resolve_wikia": f"SELECT * FROM {cards(_EVERY, WIKIA_ARTICLES, _wikia_summary('end'))} c",
    "resolve_wikia_reference": f"SELECT * FROM {cards(_EVERY, WIKIA_ARTICLES, _wikia_summary('start'))} c",
    "load_report": "SELECT count(*) AS loaded, count(*) FILTER (n > 1) AS repeated_ids FROM (SELECT referenceid, count(*) AS n FROM fx_catalog_raw WHERE referenceid <> '!disabled' GROUP BY 1) t",
    "export_report": f"SELECT (SELECT count(*) FROM fx_catalog_raw) AS previous_rows, (SELECT count(*) FROM {ADDED} a) AS new_rows",
    "ingest_funnel": _FUNNEL,
    "session_status": """
SELECT shard, state, ready_events, 1 AS shards, CAST(ready_events > 0 AS INT) AS ready_shards, ready_events > 0 AS all_ready
FROM (SELECT shard, arg_max(kind, (ts, event_id)) AS state, count(*) FILTER (kind = 'ready') AS ready_events FROM fx_lifecycle WHERE kind <> 'message' GROUP BY 1) s
UNION ALL
SELECT NULL, NULL, CAST(sum(r) AS BIGINT), count(*), count(*) FILTER (r > 0), bool_and(r > 0)
FROM (SELECT shard, count(*) FILTER (kind = 'ready') AS r FROM fx_lifecycle WHERE kind <> 'message' GROUP BY 1) s""",
    "search_top1": f"SELECT * FROM {top1('fx_requests', ALL_ARTICLES)} t",
    "route_messages": f"SELECT event_id, route, CAST(len(words) AS INT) AS word_count, wiki_key, query FROM {ROUTED} m",
    "generic_responses": f"SELECT 'https://' || host || '/w/api.php' AS endpoint, title AS query, title, replace(abstract_text, '....', '.') AS summary, coalesce(thumb_url, '') AS thumb_url, page_url FROM {_TITLED} t",
    "wikia_responses": f"SELECT 'https://' || host || '/api/v1' AS endpoint, title AS query, title, {_wikia_summary('end')} AS summary, coalesce(thumb_url, '') AS thumb_url, page_url || '/wiki' AS page_url FROM {_TITLED} t",
    "query_outcome": f"SELECT event_id, wiki_key, query, outcome, endpoint, article_id FROM {ANSWERED} z",
    "query_terms": f"SELECT DISTINCT endpoint, query FROM {ASKED} k WHERE endpoint IS NOT NULL",
    "result_card": RESULT_CARDS,
    "add_source_dump": added_source(DUMP_LINKS, GENERIC_SUFFIXES, "generic"),
    "add_source_directory": added_source(DIRECTORY_LINKS, GENERIC_SUFFIXES, "generic"),
    "add_source_search": added_source(SEARCH_LINKS, WIKIA_SUFFIXES, "wikia"),
    "answer_messages": ANSWER_MESSAGES,
    "route_stream": ANSWER_MESSAGES,
    "answer_from_responses": _about_pages(ANSWER_MESSAGES),
    "request_plan_from_responses": _about_pages(REQUEST_PLAN),
    "source_errors": f"""
SELECT 'wikistats' AS retriever, {_SOURCE} AS source, 'english' AS language, 'source not found' AS error FROM pages WHERE page_id % 13 = 7
UNION ALL
SELECT 'fandom', prefix, language, 'unknown language'
FROM (SELECT prefix, CASE WHEN id % 7 = 3 THEN lang || 'ish' ELSE lang END AS language FROM fx_dump) s
WHERE lower(language) NOT IN (SELECT lower(name) FROM (VALUES {_LANGUAGE_ROWS}) v(name, code))""",
}


def oracle_sql() -> dict[str, str]:
    return {key: with_views(sql) for key, sql in ORACLES.items()}
