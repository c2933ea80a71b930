import itertools

from pyspark.sql import functions as F

from wikiloom.operators import probes


def expected(link, statuses, suffixes):
    if not link.startswith("http"):
        return None
    base = link
    if statuses[0] is None:
        return None
    if statuses[0] != 200:
        base = link.replace("http://", "https://")
        if statuses[1] != 200:
            return None
    for status, suffix in zip(statuses[2:], suffixes):
        if status is None:
            return None
        if status == 200:
            return base + suffix
    return None


def test_every_combination_of_statuses(spark):
    cases = list(itertools.product([200, 404, None], repeat=5))
    links = [("not a url" if i % 7 == 0 else f"http://w{i}.example.org") for i in range(len(cases))]
    candidates = spark.createDataFrame(list(enumerate(links)), "cand_id long, url string")
    log = spark.createDataFrame(
        [(i, step, s) for i, case in enumerate(cases) for step, s in enumerate(case)],
        "cand_id long, step int, status int",
    )
    for suffixes in (probes.GENERIC_SUFFIXES, probes.WIKIA_SUFFIXES):
        got = {r.cand_id: r.endpoint for r in probes.resolve_by_step(candidates, log, suffixes).collect()}
        want = {i: expected(links[i], c, suffixes) for i, c in enumerate(cases)}
        assert got == {k: v for k, v in want.items() if v}


def test_log_by_url(spark):
    suffix = probes.GENERIC_SUFFIXES
    log = {
        "http://a.org": 200, "http://a.org" + suffix[0]: 404, "http://a.org" + suffix[1]: 200,
        "http://b.org": 301, "https://b.org": 200, "https://b.org" + suffix[0]: 200,
        "http://c.org": 200, "http://c.org" + suffix[0]: None, "http://c.org" + suffix[1]: 200,
        "https://d.org": 404, "http://e.org": 404, "https://e.org": 200,
        # The plain form is up, but was not the one that answered.
        "http://e.org" + suffix[0]: 200,
    }
    links = ["http://a.org", "http://a.org", "http://b.org", "http://c.org", "https://d.org", "http://e.org", "x", "http://unseen.org"]
    candidates = spark.createDataFrame(list(enumerate(links)), "cand_id long, url string")
    got = probes.resolve_by_url(candidates, spark.createDataFrame(list(log.items()), "url string, status int"))
    assert {r.cand_id: r.endpoint for r in got.collect()} == {
        0: "http://a.org/w/api.php", 1: "http://a.org/w/api.php", 2: "https://b.org/api.php",
    }


def test_plan_covers_what_resolving_looks_up(spark):
    candidates = spark.createDataFrame([(1, "http://a.org")], "cand_id long, url string")
    rows = probes.probe_plan(candidates).orderBy("step").collect()
    assert [r.url for r in rows] == [
        "http://a.org", "https://a.org", "http://a.org/api.php", "http://a.org/w/api.php", "http://a.org/wiki/api.php",
    ]
    assert rows[3].retry_url == "https://a.org/w/api.php"


def test_naming(spark):
    verified = spark.createDataFrame([("https://en.w.org/api.php",), ("https://w.org/api.php",)], "endpoint string")
    on = probes.named_endpoints(verified, "wikia").orderBy("endpoint").collect()
    assert [(r.referenceid, r.resolverid, r.color) for r in on] == [("en", "wikia", None), ("!disabled", "wikia", None)]
    off = probes.named_endpoints(verified, "wikia", auto_enable=False)
    assert off.filter(F.col("referenceid") != "!disabled").count() == 0
