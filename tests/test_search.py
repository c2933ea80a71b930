import random
import re

import numpy as np
import pytest

from wikiloom.operators import search
from wikiloom.session import staged


def words(text):
    return {w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w}


def brute_force(requests, articles):
    best = {}
    for host, query in set(requests):
        terms = words(query)
        ranked = []
        for article_host, number, title, lead in articles:
            in_title, in_lead = len(terms & words(title)), len(terms & words(lead))
            if article_host == host and (in_title or in_lead):
                exact = int((title or "").lower() == query.lower())
                ranked.append((-exact, -in_title, -in_lead, number))
        if ranked:
            exact, in_title, in_lead, number = min(ranked)
            best[host, query] = (number, -exact, -in_title, -in_lead)
    return best


def searched(spark, requests, articles):
    result = search.top1(
        spark.createDataFrame(requests, "host string, query string"),
        spark.createDataFrame(articles, "host string, article_id long, title string, lead string"),
    )
    return {
        (r.host, r.query): (r.article_id, r.exact_title, r.title_terms, r.lead_terms)
        for r in result.collect()
    }


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    # A third of all articles and questions on one host, one word nearly everywhere.
    hosts = ["hot"] * 4 + [f"h{i}" for i in range(8)]
    vocabulary = ["the"] * 12 + [f"w{i}" for i in range(15)] + ["Été", "x1"]

    def phrase(most):
        return rng.choice([" ", ", ", "  "]).join(rng.choices(vocabulary, k=rng.randint(0, most)))

    articles = [
        (rng.choice(hosts), i, phrase(3).title(), rng.choice([None, phrase(12)])) for i in range(400)
    ]
    requests = [(rng.choice(hosts), phrase(4)) for _ in range(150)]
    requests += [(h, t) for h, _, t, _ in articles[:40]] + [("none", "the"), ("hot", "!!"), ("hot", "the The")]
    assert searched(spark, requests, articles) == brute_force(requests, articles)


def test_the_most_frequent_word_alone_can_win(spark):
    articles = [("h", 1, "the", ""), ("h", 2, "", "rare"), ("h", 3, "The", "the"), ("h", 4, "", "the rare")]
    assert searched(spark, [("h", "the rare")], articles)["h", "the rare"] == (3, 0, 1, 1)


def test_repeated_words_and_exact_titles(spark):
    articles = [("h", 1, "the", "the"), ("h", 2, "THE the", "")]
    assert searched(spark, [("h", "the the"), ("h", "the")], articles) == {
        ("h", "the the"): (2, 1, 1, 0),
        ("h", "the"): (1, 1, 1, 1),
    }


def test_no_article_no_row(spark):
    assert searched(spark, [("h", "absent")], [("h", 1, "a", "b"), ("g", 2, "absent", "")]) == {}


@pytest.mark.parametrize("seed", range(3))
def test_shards_and_parts_change_nothing(spark, monkeypatch, seed):
    """One host with most of the rows, dealt to many shards, its questions to many parts."""
    monkeypatch.setattr(search, "SHARD_ARTICLES", 30)
    monkeypatch.setattr(search, "PART_QUESTIONS", 20)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["the"] * 5

    def phrase(most):
        return " ".join(rng.choices(vocabulary, k=rng.randint(1, most)))

    articles = [(rng.choice(["hot"] * 9 + ["cold"]), i, phrase(3), phrase(6)) for i in range(300)]
    requests = [(rng.choice(["hot"] * 9 + ["cold"]), phrase(5)) for _ in range(120)]
    assert searched(spark, requests, articles) == brute_force(requests, articles)


def _plain(index, terms):
    ranked = [
        (-sum(t in title for t in terms), -sum(t in lead for t in terms), number)
        for number, title, lead in index
        if any(t in title or t in lead for t in terms)
    ]
    return (lambda b: (-b[0], -b[1], b[2]))(min(ranked)) if ranked else None


def _postings(index):
    postings = search.Postings()
    for number, title, lead in index:
        terms = sorted(title | lead)
        postings.add(number, terms, [3 if t in title and t in lead else 2 if t in title else 1 for t in terms])
    return postings


def test_long_lists_are_not_read_once_beaten():
    index = [(i, {"the"}, {"the"}) for i in range(1, 1000)] + [(1000, {"rare", "the", "of"}, {"rare", "the", "of"})]
    index += [(2000 + i, set(), {"of"}) for i in range(500)]
    postings, read = _postings(index), []
    original = np.searchsorted

    def counted(others, numbers):
        read.append(len(numbers))
        return original(others, numbers)

    search.np.searchsorted = counted
    try:
        assert postings.best(["the", "of", "rare"]) == (3, 3, 1000)
    finally:
        search.np.searchsorted = original
    assert max(read) == 1


@pytest.mark.parametrize("seed", range(5))
def test_postings_equal_brute_force(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(10)]
    numbers = rng.sample(range(10_000), 200)
    index = [(n, set(rng.choices(words, k=rng.randint(0, 3))), set(rng.choices(words, k=rng.randint(0, 4)))) for n in numbers]
    postings = _postings(index)
    for _ in range(200):
        terms = rng.sample([*words, "absent"], rng.randint(1, 6))
        assert postings.best(terms) == _plain(index, terms)
