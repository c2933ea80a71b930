import pytest
from pyspark.sql import functions as F

from wikiloom.operators import catalog as catalogs
from wikiloom.operators import harvest
from wikiloom.plans import add_source

CATALOG = "seq long, referenceid string, endpoint string, resolverid string, displaycolor string"


@pytest.fixture
def catalog(spark):
    rows = [(0, "known", "https://known.site.org/w/api.php", "generic", "1"), (1, "!disabled", "https://off.site.org/api.php", "generic", "1")]
    return spark.createDataFrame(rows, CATALOG)


def log(spark, **ups):
    rows = [(url.format(h), 200) for h, forms in ups.items() for url in forms]
    return spark.createDataFrame(rows, "url string, status int")


GENERIC = ["http://{}.site.org", "http://{}.site.org/api.php"]
WIKIA = ["http://{}.fandom.org", "http://{}.fandom.org/api/v1"]


def added(df):
    return [(r.referenceid, r.endpoint, r.resolverid, r.displaycolor) for r in df.filter("part = 1").orderBy(*catalogs.EXTENDED_ORDER).collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_dump(spark, catalog):
    index = "<a href='display.php?t=p1'>proj</a><a href='display.php?t=p2'>proj</a><a href='other'>proj</a>"
    crawl = [("https://i.org/display.php?t=p1", "<a href='http://en.site.org/wiki'>en</a>"), ("https://i.org/display.php?t=p2", "<a href='http://en.no.org'>en</a>")]
    shown = harvest.display_pages(
        frame(spark, [(index,)], "html string"), frame(spark, crawl, "url string, html string"), "https://i.org/", "display.php?t="
    )
    bodies = [("proj", "prefix,lang\nen,English\nknown,English\nde,German\noff,\ndown,\n"), ("else", "prefix\nfr"), ("gone", "table name not set or unknown")]
    tables = {
        "bodies": frame(spark, bodies, "source string, body string"),
        "display_pages": shown,
        # The disabled wiki is found again, but its other address is not in the catalogue.
        "log": log(spark, en=GENERIC, de=GENERIC, off=["http://{}.site.org", "https://{}.site.org"] + GENERIC[1:], fr=GENERIC),
    }
    result = add_source.add_source(catalog, tables, "wikistats:proj ENGLISH")
    assert added(result) == [
        ("en", "http://en.site.org/api.php", "generic", "!random"), ("off", "http://off.site.org/api.php", "generic", "!random"),
    ]
    # No link of the project's page is named after a prefix that is left: no template.
    assert added(add_source.add_source(catalog, tables, "wikistats:proj german")) == []
    off = add_source.add_source(catalog, tables, "wikistats:proj english noauto")
    assert [r[0] for r in added(off)] == ["!disabled", "!disabled"]
    assert added(add_source.add_source(catalog, tables, "wikistats:gone english")) == []
    for unreadable in ("nobody:proj english", "wikistats: english", "wikistats:a:b english"):
        assert add_source.add_source(catalog, tables, unreadable) is None


def test_directory(spark, catalog):
    def page(*wikis, last="2"):
        links = "".join(f"<div class=wiki><a href='http://{w}.site.org'>x</a></div>" for w in wikis)
        return f"{links}<a href='http://no.site.org'>no</a><a class=b-pagination-item>{last}</a>"

    crawl = [("https://d.org/wikis?page=1", page("a", "known")), ("https://d.org/wikis?page=2", page("b", "a")), ("https://d.org/wikis?page=3", page("c")), ("https://d.org/wikis?page=4", None)]
    tables = {
        "crawl": frame(spark, crawl, "url string, html string"),
        "seeds": frame(spark, [("https://d.org/wikis",)], "seed string"),
        "log": log(spark, a=GENERIC, b=GENERIC, c=GENERIC, no=GENERIC),
    }
    got = added(add_source.add_source(catalog, tables, "gamepedia"))
    assert [r[0] for r in got] == ["a", "b", "a"]  # a bag, in page order
    once = add_source.add_source_directory(catalog, **tables, distinct=True)
    assert [r[0] for r in added(once)] == ["a", "b"]


def test_search(spark, catalog):
    def page(*wikis, last=None):
        links = "".join(f"<a class=result-link href='http://{w}/'>x</a>" for w in wikis)
        return links + (f"<a class=paginator-page>{last}</a>" if last else "")

    rows = [
        ("", "en", 1, page("a.fandom.org", "b.other.org", last=2)), ("", "en", 2, page("c.fandom.org", last=3)),
        ("", "en", 3, page("d.fandom.org", last=3)), ("", "en", 4, page("e.fandom.org", last=3)),
        ("", "fr", 1, page("f.fandom.org")), ("cat", "en", 1, page("g.fandom.org")), ("cat", "en", 2, page("h.fandom.org")),
        ("empty", "en", 1, page(last=2)), ("empty", "en", 2, page("i.fandom.org", last=2)),
    ]
    tables = {
        "crawl": frame(spark, rows, "term string, lang string, page_no int, html string"),
        "languages": frame(spark, [(0, "English", "en"), (1, "French", "fr")], "ord int, name string, code string"),
        "log": log(spark, **{h: WIKIA for h in "abcdefghi"}),
    }

    def names(command):
        return [r[0] for r in added(add_source.add_source(catalog, tables, command))]

    assert names("fandom:all english") == names("fandom") == ["a", "c", "d"]
    assert names("fandom:all French") == ["f"]
    assert names("fandom:cat english") == ["g"]
    assert names("fandom:empty english") == []
    assert names("fandom:all klingon") == []
    first = add_source.add_source(catalog, tables, "fandom:cat english").filter("part = 1").first()
    assert (first.endpoint, first.resolverid) == ("http://g.fandom.org/api/v1", "wikia")


def test_a_blank_command_changes_nothing():
    assert add_source.add_source(None, {}, " ") is None
    assert add_source.add_source(None, {}, "") is None
