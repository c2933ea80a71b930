"""Best article per collection and query, where a collection is the pages of a host.

The ranking is this project's own choice, since a wiki's search engine is out of
reach: an article is a hit if any query word is in its title or lead text; hits are
ranked by exact title, query words in the title, query words in the lead text and
lowest ``article_id``. Words are lower-cased runs of letters and digits.

No question is matched with all articles of its words, as rows:

* Articles are cut to the words that some query of their collection asks for before they
  are shuffled, and what is shuffled is one short row per article.
* A question that is the title of some article is answered by a join: articles with
  other titles rank behind.
* All other questions go to the postings of their collection, a list of articles per
  word. Large collections are dealt to several shards by a hash of the article, and the
  questions of a shard to several parts, so postings and questions of a task are bounded,
  whatever the share of one host. Each shard gives its best hit, and the best of
  these is the answer.
* In a shard a question goes through the postings of its words, rarest first. An article
  whose rarest word is the next one has at most the words from there on; once
  what is found beats that, the longer lists are not read. The list of the most frequent
  word is never read: what is left there are articles with that word alone, and the
  best of those is noted for each word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions.text import word_set
from wikiloom.session import staged

# Where a word stands in an article; the larger the better.
_TITLE_AND_LEAD, _TITLE, _LEAD = 3, 2, 1

# Articles of a shard, and questions that meet one copy of it.
SHARD_ARTICLES = 50_000
PART_QUESTIONS = 10_000

_SCORE = ["exact_title", "title_terms", "lead_terms"]


def _placed_words(title: Column, lead: Column) -> Column:
    """(word, place) of all words of an article, each word once."""

    def at(words: Column, place: int) -> Column:
        return F.transform(
            words, lambda w: F.struct(w.alias("term"), F.lit(place).alias("place"))
        )

    return F.concat(
        at(F.array_intersect(title, lead), _TITLE_AND_LEAD),
        at(F.array_except(title, lead), _TITLE),
        at(F.array_except(lead, title), _LEAD),
    )


def _asked(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct questions per collection, compared in lower case, with their words."""
    return (
        requests.select(*keys, F.lower("query").alias("question"))
        .distinct()
        .withColumn("terms", word_set(F.col("question")))
        .filter(F.size("terms") > 0)
    )


def _matched_articles(articles: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """One row per article with a word asked for: the words in its title and lead."""
    words = (
        articles.withColumn("title_words", word_set(F.col("title")))
        .withColumn("lead_words", word_set(F.col("lead")))
        .select(
            *keys,
            "article_id",
            F.lower("title").alias("title_key"),
            F.inline(_placed_words(F.col("title_words"), F.col("lead_words"))),
        )
    )
    return (
        words.join(vocabulary, [*keys, "term"])
        .groupBy("article_id", *keys, "title_key")
        .agg(F.collect_list(F.struct("term", "place")).alias("matched"))
    )


class Postings:
    """Articles of one shard by word."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.places: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        self.lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.alone: dict[str, tuple[int, int, int]] = {}

    def add(self, article_id: int, terms: list[str], places: list[int]) -> None:
        number = len(self.ids)
        self.ids.append(article_id)
        for term, place in zip(terms, places):
            numbers, where = self.places[term]
            numbers.append(number)
            where.append(place)

    def _list(self, term: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of the articles with a word, rising, and its place in each; None without any."""
        if term not in self.lists:
            if term not in self.places:
                return None
            numbers, where = self.places.pop(term)
            self.lists[term] = np.array(numbers), np.array(where, dtype=np.int8)
            self.alone[term] = min((-(p >= _TITLE), -(p != _TITLE), self.ids[n]) for n, p in zip(numbers, where))
        return self.lists[term]

    def best(self, terms: list[str]) -> tuple[int, int, int] | None:
        """(title words, lead words, article id) of the best hit for a question; None without one."""
        known = sorted((len(own[0]), term) for term in terms if (own := self._list(term)))
        if not known:
            return None
        lists = [self.lists[term] for _, term in known]
        # What each word can add at most, and what all from a word on can.
        in_title = np.cumsum([bool((where >= _TITLE).any()) for _, where in reversed(lists)])[::-1]
        in_lead = np.cumsum([bool((where != _TITLE).any()) for _, where in reversed(lists)])[::-1]
        best = min(self.alone[term] for _, term in known)
        for i, (numbers, _) in enumerate(lists[:-1]):
            if (-in_title[i], -in_lead[i]) > best[:2]:
                break
            title, lead = np.zeros(len(numbers), dtype=np.int64), np.zeros(len(numbers), dtype=np.int64)
            for others, where in lists:
                at = np.minimum(np.searchsorted(others, numbers), len(others) - 1)
                place = np.where(others[at] == numbers, where[at], 0)
                title += place >= _TITLE
                lead += (place == _LEAD) | (place == _TITLE_AND_LEAD)
            score = title * (len(lists) + 1) + lead
            top = np.flatnonzero(score == score.max())
            number = min(self.ids[n] for n in numbers[top])
            best = min(best, (-int(title[top[0]]), -int(lead[top[0]]), number))
        return -best[0], -best[1], best[2]


def _shards(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Into how many pieces of about ``size`` rows each collection is cut."""
    pieces = F.ceil(F.count("*") / size).cast("int").alias(name)
    return rows.groupBy(*keys).agg(pieces)


def _traversed(questions: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Best hit of each question in each shard of its collection."""
    shards = _shards(matched, keys, SHARD_ARTICLES, "shards")
    sizes = staged(shards.join(_shards(questions, keys, PART_QUESTIONS, "parts"), keys), "shards")

    def pieces(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    # Articles come before questions: their kind is 0.
    parts = matched.join(sizes, keys).select(
        *keys, F.pmod(F.xxhash64("article_id"), "shards").cast("int").alias("shard"), pieces("parts").alias("part"), F.lit(0).alias("kind"),
        "article_id", F.lit(None).cast("string").alias("question"), F.col("matched.term").alias("terms"), F.col("matched.place").alias("places"),
    )
    asking = questions.join(sizes, keys).select(
        *keys, pieces("shards").alias("shard"), F.pmod(F.xxhash64("question"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("article_id"), "question", "terms", F.lit(None).cast("array<int>").alias("places"),
    )
    where = [*keys, "shard", "part"]
    work = parts.unionByName(asking).withColumn("group", F.struct(*where))
    count = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = work.repartition(count, *where).sortWithinPartitions(*where, "kind")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, postings = None, Postings()
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("group", "kind", "article_id", "question", "terms", "places")]
            for own, kind, article_id, question, terms, places in zip(*columns):
                if own != group:
                    group, postings = own, Postings()
                if kind == 0:
                    postings.add(article_id, terms, places)
                elif (best := postings.best(terms)) is not None:
                    found.append({"group": own, "question": question, "title_terms": best[0], "lead_terms": best[1], "article_id": best[2]})
            yield pa.RecordBatch.from_pylist(found, schema=shape)

    kind = work.select("group", "question", F.lit(0).alias("title_terms"), F.lit(0).alias("lead_terms"), "article_id")
    shape = pa.schema([
        pa.field("group", pa.struct([pa.field(k, pa.string()) for k in keys] + [pa.field("shard", pa.int32()), pa.field("part", pa.int32())])),
        pa.field("question", pa.string()), pa.field("title_terms", pa.int32()), pa.field("lead_terms", pa.int32()), pa.field("article_id", pa.int64()),
    ])
    hits = ordered.select("group", "kind", "article_id", "question", "terms", "places").mapInArrow(traverse, kind.schema)
    return hits.select(*[F.col(f"group.{k}").alias(k) for k in keys], "question", F.lit(0).alias("exact_title"), "title_terms", "lead_terms", "article_id")


def top1(requests: DataFrame, articles: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Best hit of each request.

    ``requests`` has ``query``, ``articles`` has ``article_id, title, lead``, and both
    have the ``keys`` of the collection that is searched, all of them texts. Gives the keys and ``query,
    article_id, exact_title, title_terms, lead_terms``; requests without a hit have no
    row, nor have those with a NULL key.
    """
    keys = list(keys)
    asked = staged(_asked(requests, keys), "asked")
    vocabulary = asked.select(*keys, F.explode("terms").alias("term")).distinct()
    matched = staged(_matched_articles(articles, staged(vocabulary, "vocabulary"), keys), "matched")

    # Exact titles: an article matches at most one question, and beats all others.
    in_lead = F.transform(F.filter("matched", lambda m: m.place.isin(_TITLE_AND_LEAD, _LEAD)), lambda m: m.term)
    exact = (
        matched.join(asked.withColumn("title_key", F.col("question")), [*keys, "title_key"])
        .select(
            *keys,
            "question",
            F.lit(1).alias("exact_title"),
            F.size("terms").alias("title_terms"),
            F.size(F.array_intersect("terms", in_lead)).alias("lead_terms"),
            "article_id",
        )
        .groupBy(*keys, "question", *_SCORE)
        .agg(F.min("article_id").alias("article_id"))
    )
    exact = staged(exact, "exact")
    questions = asked.join(exact.select(*keys, "question").distinct(), [*keys, "question"], "left_anti")
    hits = _traversed(questions, matched, keys).unionByName(exact)
    # The greatest of the scores and the negative id: the lowest id among the best.
    rank = F.struct(*_SCORE, (-F.col("article_id")).alias("later"))
    best = hits.groupBy(*keys, "question").agg(F.max(rank).alias("best"))
    return (
        requests.select(*keys, "query")
        .distinct()
        .withColumn("question", F.lower("query"))
        .join(best, [*keys, "question"])
        .select(*keys, "query", (-F.col("best.later")).alias("article_id"), *[f"best.{s}" for s in _SCORE])
    )
