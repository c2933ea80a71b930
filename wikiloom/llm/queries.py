"""The registered queries of the operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wikiloom.llm import bpe_trie, decontaminate, fingerprints, hard_negatives, html_extract, jaccard_join, langid, simhash, substring_dedup, suffix_dedup, token_counts, url_filter, whitening
from wikiloom.llm.common import is_held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", is_held_out(F.col("doc_id")))
    model = langid.train(docs.filter("NOT held_out AND doc_id IS NOT NULL"))
    labelled = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return labelled.select("doc_id", "held_out", "lang_pred", "score")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


#: The rules of the URL query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.find_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.find_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull() & whitening.is_complete("embedding"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), whitening.stepped("embedding", 256).alias("q"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").filter(whitening.is_complete("embedding"))
    rows = rows.select("vec_id", whitening.stepped("embedding", 64, 1_000_000).alias("x"))
    found = whitening.fit_and_whiten(rows, "x")
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_ngram_jaccard_join, op3_token_counts, op4_bpe_trie, op5_winnowing,
        op6_url_filter, op7_decontamination, op8_suffix_array_dedup, op9_substring_dedup, op10_html_extraction,
        op11_hard_negatives, op12_whitening, op13_simhash,
    )
}

# -- SQL -----------------------------------------------------------------------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
_BLANK = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_BLANK}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[CAST(i AS INT):CAST(i AS INT) + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, hash(list_sort(list(g))) AS h FROM s GROUP BY doc_id),
reps AS (SELECT h, min(doc_id) AS rep FROM sets GROUP BY h),
r AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id) JOIN reps ON s.doc_id = reps.rep),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
      FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
      GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
reach AS (SELECT rep AS id, rep AS node FROM reps UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.node),
comp AS (SELECT id, min(node) AS component_id FROM reach GROUP BY id),
size AS (SELECT reps.rep, count(*) AS docs FROM sets JOIN reps USING (h) GROUP BY reps.rep),
near AS (SELECT e.a AS id, sum(size.docs) AS others FROM e JOIN size ON size.rep = e.b GROUP BY e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id,
       CAST(coalesce(size.docs - 1, 0) + coalesce(near.others, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (h) LEFT JOIN comp ON comp.id = reps.rep
LEFT JOIN size ON size.rep = reps.rep LEFT JOIN near ON near.id = reps.rep
"""

OP6 = f"""
WITH h AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_LETTERS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '{_LETTERS}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[CAST(i AS INT):CAST(i AS INT) + 9], ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) t),
sizes AS (SELECT DISTINCT size FROM win),
pl AS (SELECT doc_id, i, size, array_to_string(w[CAST(i AS INT):CAST(i + size - 1 AS INT)], ' ') AS g
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size) t),
hit AS (SELECT DISTINCT pl.doc_id, pl.i, pl.size, win.item FROM pl JOIN win USING (g, size)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) t GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_BLANK}'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[CAST(i AS INT):CAST(i AS INT) + 34], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) t),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN again USING (g)) t GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE
         list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(p, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

OP11 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
             CAST(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[CAST(i AS INT)] * b.q[CAST(i AS INT)])), 0) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) t WHERE place <= 5),
n AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLE_SQL = {"op2_ngram_jaccard_join": OP2, "op6_url_filter": OP6, "op7_decontamination": OP7, "op9_substring_dedup": OP9, "op11_hard_negatives": OP11}
