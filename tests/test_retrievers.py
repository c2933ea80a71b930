"""The registry of retrievers, and errors beside results."""

import pytest
from pyspark.sql import functions as F

from wikiloom.operators import catalog as catalogs
from wikiloom.operators.languages import iso_languages, language_table, with_language_code
from wikiloom.plans import add_source, retrievers
from wikiloom.plans.retrievers import REGISTRY, Retriever

CATALOG = "seq long, referenceid string, endpoint string, resolverid string, displaycolor string"


def _hosts(tables, request):
    """Links of a table of host names by country."""
    own = tables["hosts"].filter(F.col("country") == request.source)
    return own.select(F.concat(F.lit("http://"), "name").alias("url"), F.col("country").alias("source"), "seq", F.lit(0).alias("pos"))


BY_COUNTRY = Retriever(
    tables={"hosts": "country string, name string, seq long"}, links=_hosts, resolver="generic", suffixes=["/x.php"], default_source="it"
)


@pytest.fixture
def tables(spark):
    hosts = [("it", "b.site.it", 1), ("it", "a.site.it", 0), ("fr", "c.site.fr", 0), ("it", "known.site.it", 2)]
    ups = [f"http://{n}{p}" for _, n, _ in hosts for p in ("", "/x.php")]
    return {
        "hosts": spark.createDataFrame(hosts, "country string, name string, seq long").withColumn("extra", F.lit(1)),
        "log": spark.createDataFrame([(u, 200) for u in ups], "url string, status int"),
    }


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([(0, "known", "https://known.site.it/w", "generic", "1")], CATALOG)


def added(df):
    return [(r.referenceid, r.endpoint) for r in df.filter("part = 1").orderBy(*catalogs.EXTENDED_ORDER).collect()]


def test_a_fourth_retriever(catalog, tables):
    registry = {**REGISTRY, "country": BY_COUNTRY}
    default = added(add_source.add_source(catalog, tables, "country", registry))
    assert default == [("a", "http://a.site.it/x.php"), ("b", "http://b.site.it/x.php")]
    assert added(add_source.add_source(catalog, tables, "country:fr any noauto", registry)) == [("!disabled", "http://c.site.fr/x.php")]
    assert add_source.add_source(catalog, tables, "country:fr") is None
    assert retrievers.registered_sources(registry)["country"] == []


def test_tables_are_checked_before_anything_runs(catalog, tables):
    with pytest.raises(ValueError, match="table hosts lacks name"):
        add_source.add_source(catalog, {**tables, "hosts": tables["hosts"].drop("name")}, "country", {"country": BY_COUNTRY})
    with pytest.raises(ValueError, match="table bodies lacks source, body"):
        add_source.add_source(catalog, tables, "wikistats")


def test_defaults():
    read = add_source.read_command("fandom")
    assert (read.name, read.request.source, read.request.language, read.auto_enable) == ("fandom", "all", "english", True)
    assert add_source.read_command("wikistats").request.source == "wikipedias"
    assert add_source.read_command("gamepedia:x y noauto").auto_enable is False


def test_errors_beside_the_result(spark, tables):
    sources = {
        "bodies": spark.createDataFrame([("gone", "error: table name not set or unknown"), ("there", "prefix\nen")], "source string, body string"),
        "display_pages": spark.createDataFrame([], "project string, html string"),
        "crawl": spark.createDataFrame([], "term string, lang string, page_no int, html string"),
    }
    commands = ["wikistats:gone german", "wikistats:there german", "fandom:cat klingon", "fandom klingon", "fandom:cat Welsh", "nobody:x", ""]
    found = sorted(map(tuple, add_source.source_errors(sources, commands).collect()))
    assert found == [
        ("fandom", "", "klingon", "unknown language"), ("fandom", "cat", "klingon", "unknown language"),
        ("wikistats", "gone", "german", "source not found"),
    ]
    assert add_source.source_errors(sources, ["nobody"]).count() == 0
    # A retriever may report none, and a table of languages may stand for the standard's.
    assert add_source.source_errors({**sources, **tables}, ["country:x"], {"country": BY_COUNTRY}).count() == 0
    own = {**sources, "languages": spark.createDataFrame([(0, "Klingon", "tl")], "ord int, name string, code string")}
    assert [r.language for r in add_source.source_errors(own, ["fandom klingon", "fandom english"]).collect()] == ["english"]


def test_languages_of_the_standard(spark):
    rows = iso_languages()
    assert len({c for _, _, c in rows}) == len({n.lower() for _, n, _ in rows}) == len(rows)
    assert all(len(c) == 2 and c.islower() for _, _, c in rows)
    asked = spark.createDataFrame([("SCOTTISH gaelic",), ("none",), (None,)], "language string")
    assert sorted((str(r.language), str(r.code)) for r in with_language_code(asked).collect()) == [("None", "None"), ("SCOTTISH gaelic", "gd"), ("none", "None")]
    assert language_table(spark).filter("code = 'en'").first().name == "English"
