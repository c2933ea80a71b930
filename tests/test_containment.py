import random

import pytest

from wikiloom.operators.containment import contained
from wikiloom.operators.probes import drop_known_hosts, known_hosts


def found(spark, needles, haystacks):
    result = contained(
        spark.createDataFrame([(n,) for n in needles], "needle string"),
        spark.createDataFrame([(h,) for h in haystacks], "haystack string"),
    )
    rows = [r.needle for r in result.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)

    def text(low, high):
        return "".join(rng.choices("ab.", k=rng.randint(low, high)))

    haystacks = [text(0, 60) for _ in range(40)] + ["https://www.a.org/w"] * 20
    needles = [text(0, 14) for _ in range(400)] + [None, "", "www.a.org", "a.org", "b.org", "www.a.org/x"]
    expected = {n for n in needles if n is not None and any(n in h for h in haystacks)}
    assert found(spark, needles, haystacks) == expected


def test_nothing_is_contained_in_nothing(spark):
    assert found(spark, ["", "abc", "abcdefghij"], []) == set()


def test_known_hosts(spark):
    candidates = spark.createDataFrame(
        [(1, "http://a.org/x"), (2, "http://new.example.org"), (3, "not a url"), (4, "http:///x"),
         (5, "http://beta.org"), (6, "http://a.org/y")],
        "cand_id long, url string",
    )
    endpoints = spark.createDataFrame([("https://beta.org/api.php",)], "endpoint string")

    def kept(endpoints, **options):
        return sorted(r.cand_id for r in drop_known_hosts(candidates, endpoints, **options).collect())

    assert kept(endpoints) == [2, 3]
    assert kept(endpoints, exact=True) == [1, 2, 3, 4, 6]
    assert kept(endpoints.limit(0)) == [1, 2, 3, 4, 5, 6]
    assert {r.host for r in known_hosts(candidates, endpoints).collect()} == {"a.org", "beta.org", ""}


def test_short_grams_are_cut_for_short_hosts_only(spark):
    haystacks = spark.createDataFrame([("https://www.example.org/w/api.php",)], "haystack string")
    long = spark.createDataFrame([("www.example.org",), ("example.net",)], "needle string")
    one = spark.createDataFrame([("www.example.org",), ("e.org",)], "needle string")

    def plan(needles):
        return contained(needles, haystacks)._jdf.queryExecution().analyzed().toString()

    assert "flatten" not in plan(long) and "flatten" in plan(one)
    assert {r.needle for r in contained(one, haystacks).collect()} == {"www.example.org", "e.org"}
