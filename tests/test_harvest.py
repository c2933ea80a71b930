import pytest
from pyspark.sql import functions as F

from wikiloom.functions import html
from wikiloom.operators import corpus, harvest


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def hrefs(links):
    return [(r.page_id, r.pos, r.href) for r in links.orderBy("page_id", "pos").collect()]


TRICKY = (
    "<A class='x Result-Link y' HREF=/one title=\"a > href='no'\">1</A>"
    "<!-- <a class='result-link' href='/comment'> --><script>'<a class=result-link href=/script>'</script>"
    "<div class=result-link data-href='/no'>2</div><abbr href='/abbr'></abbr>"
    "<a class=\"result-links\" href=\"/other?x=1&amp;copy=2&copy=3&#47;\">3</a><a name=here>4</a><a title=' href=\"/no\" '>5</a>"
    "<a\nhref = '/three'/>"
)


def test_links_by_class(spark):
    assert hrefs(harvest.links_by_class(pages(spark, TRICKY, None, ""), "result-link")) == [
        (0, 0, "/one"), (0, 1, ""),
    ]


def test_links_by_tag(spark):
    assert hrefs(harvest.links_by_tag(pages(spark, TRICKY, None))) == [
        (0, 0, "/one"), (0, 1, "/other?x=1&copy=2&copy=3/"), (0, 2, "/three"),
    ]


NESTED = (
    "<a href=/out>x</a><div class='wiki big'><p><a href='/in'>y<b> z</b></a><p><a>w</a>"
    "<span class=wiki><a href=/twice>v</a></span></div><a class=wiki href=/self>u</a><a href=/after>t</a>"
)


def test_links_within_class(spark):
    assert hrefs(harvest.links_within_class(pages(spark, NESTED, None), "wiki")) == [
        (0, 0, "/in"), (0, 1, ""), (0, 2, "/twice"), (0, 3, "/twice"), (0, 4, "/self"),
    ]


def test_index_links(spark):
    page = "<link href='display.php?t=css'><a href='display.php?t=a'> Project\n <i>A</i> </a><a href='x'>no</a><a href='display.php?t=b'>Project A</a>"
    links = harvest.index_links(pages(spark, page), "display.php?t=")
    assert [(r.pos, r.href, r.text) for r in links.orderBy("pos").collect()] == [
        (0, "display.php?t=css", ""), (1, "display.php?t=a", "Project A"), (2, "display.php?t=b", "Project A"),
    ]
    first = {r.text: r.href for r in harvest.first_links_by_text(links).collect()}
    assert first == {"": "display.php?t=css", "Project A": "display.php?t=a"}


def test_marked_texts(spark):
    page = "<a class=p>1</a><a class='q p'><b> 24 </b></a><span class=p>next</span>"
    def texts(tag):
        return [r.text for r in html.marked_texts(pages(spark, page), "p", tag).orderBy("pos").collect()]
    assert texts("a") == ["1", "24"] and texts(None) == ["1", "24", "next"]


def test_normalized_links(spark):
    links = spark.createDataFrame([("http://a.fam.org///",), ("http://b.org/",), ("fam",), ("/fam/x/",)], "url string")
    assert sorted(r.url for r in harvest.normalized_links(links, "fam").collect()) == ["/fam/x", "fam", "http://a.fam.org"]


def test_numbered_pages_spans_blocks(spark):
    seeds = spark.createDataFrame([("a", 25_001), ("b", 1), ("c", 0), ("d", 10_000)], "seed string, pages int")
    got = harvest.numbered_pages(seeds).groupBy("seed").agg(
        F.count("*").alias("n"), F.count_distinct("page_no").alias("d"), F.min("page_no").alias("lo"), F.max("page_no").alias("hi")
    )
    assert sorted(map(tuple, got.collect())) == [("a", 25_001, 25_001, 1, 25_001), ("b", 1, 1, 1, 1), ("d", 10_000, 10_000, 1, 10_000)]


def test_last_number(spark):
    items = spark.createDataFrame([("a", 0, "1"), ("a", 1, "24"), ("b", 0, "3"), ("b", 1, "next")], "seed string, pos int, label string")
    assert [tuple(r) for r in harvest.last_number(items).collect()] == [("a", 24)]


def test_last_pages(spark):
    shown = {
        "long": {p: min(p + 1, 500) for p in range(1, 501)},
        "nine": {p: min(p + 9, 24) for p in range(1, 25)},
        "one": {1: 1},
        "gap": {1: 10},
        "circle": {1: 10, 10: 9, 9: 10},
        "back": {1: 5, 5: 4, 4: 4},
        "late": {2: 2},
    }
    rows = [(t, p, s) for t, chain in shown.items() for p, s in chain.items()]
    crawl = spark.createDataFrame(rows, "term string, page_no int, last_shown int")
    got = {r.term: r.last_page for r in harvest.last_pages(crawl).collect()}
    assert got == {"long": 500, "nine": 24, "one": 1, "back": 4}


def test_dump_rows(spark):
    bodies = spark.createDataFrame(
        [
            ("a", 'lang,prefix\r\n"En, ""x""",en\r\n\r\n"two\nlines",\r\nshort\r\n'),
            ("b", "error: table name not set or unknown"),
            ("c", "id,http\n1,200"),
            ("d", ""),
            ("e", "lang"),
        ],
        "source string, body string",
    )
    rows = harvest.dump_rows(bodies).orderBy("source", "line_no").collect()
    assert [(r.source, r.line_no, r.lang, r.prefix, r.statsurl, r.http) for r in rows] == [
        ("a", 0, 'En, "x"', "en", None, None),
        ("a", 1, "two\nlines", "", None, None),
        ("a", 2, "short", "", None, None),
        ("c", 0, None, None, None, "200"),
    ]
    assert [r.source for r in harvest.missing_sources(bodies).collect()] == ["b"]


def test_expanded_links(spark):
    dump = spark.createDataFrame([("p", "en"), ("p", "de"), ("p", ""), ("q", "fr")], "project string, prefix string")
    shown = spark.createDataFrame(
        [("p", 0, "relative", "en"), ("p", 1, "http://x.other.org", "zz"), ("p", 2, "https://en.len.org/wiki", "en"),
         ("p", 3, "https://de.other.org", "de"), ("q", 0, "http://en.len.org", "en"), ("p", -1, "http://blank.org", "")],
        "project string, pos int, href string, text string",
    )
    got = {(r.project, r.prefix): r.url for r in harvest.expanded_links(dump, shown).collect()}
    assert got == {
        ("p", "en"): "http://en.len.org", ("p", "de"): "http://de.lde.org", ("p", ""): "http://.l.org", ("q", "fr"): "",
    }


def test_statsurl_links(spark):
    rows = [("http://a.org/x", "200"), ("http://b.org", "404"), ("http://c.org", "500"), ("broken", "200"), ("http://d.org", "n/a"), ("http://e.org", None)]
    dump = spark.createDataFrame(rows, "statsurl string, http string")
    assert sorted(r.url for r in harvest.statsurl_links(dump).collect()) == ["http://a.org", "http://b.org"]


def test_language_code(spark):
    rows = spark.createDataFrame([("ENGLISH",), ("klingon",)], "language string")
    languages = spark.createDataFrame([(1, "english", "xx"), (0, "English", "en")], "ord int, name string, code string")
    got = {r.language: r.code for r in harvest.with_language_code(rows, languages).collect()}
    assert got == {"ENGLISH": "en", "klingon": None}


@pytest.mark.parametrize(
    "options, expected",
    [({}, [1]), ({"case_sensitive": False}, [1, 2, 3]), ({"case_sensitive": False, "spaced": True}, [2])],
)
def test_word_lists(spark, options, expected):
    texts = spark.createDataFrame([(1, "The end"), (2, "by the way"), (3, "other THEn"), (4, "no"), (5, None)], "id int, text string")
    got = corpus.with_any_word(texts, "text", ["The", "zzz"], **options)
    assert sorted(r.id for r in got.collect()) == expected


def test_lists(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["b", "c"]), (2, ["a", None], ["c"]), (3, [], ["a"]), (4, None, ["a"])], "id int, items array<string>, wanted array<string>")
    def ids(condition):
        return sorted(r.id for r in rows.filter(condition).collect())
    assert ids(corpus.holds_any(F.col("items"), F.col("wanted"))) == [1]
    assert ids(corpus.holds_any(F.col("items"), ["a", "z"])) == [1, 2]
    assert ids(corpus.holds(F.col("items"), "b")) == [1]
    assert ids(corpus.holds_any(F.col("items"), [])) == []


UNTIDY = (
    "<a title=it's href=\"u1\">it's</a><a href=\"u2\"\" class=z>2</a> a 'quote <a href=u3 class='result-link z'>3</a>"
    "<a href= class=result-link>4</a><a =x href='u5'>5</a><a title='<!--' href=u6>6</a><!-- --><a / href=u7 / >7</a>"
    "<A HREF=u8/>8</A><a title=\"never closed href=no>9</a>"
)


def test_untidy_attributes_lose_no_link(spark):
    found = ["u1", "u2", "u3", "class=result-link", "u5", "u6", "u7", "u8/"]
    page = pages(spark, UNTIDY)
    assert [h for _, _, h in hrefs(harvest.links_by_tag(page))] == found
    assert [h for _, _, h in hrefs(harvest.links_by_class(page, "result-link"))] == ["u3"]
    texts = [(r.href, r.text) for r in harvest.index_links(page, "").orderBy("pos").collect()]
    assert [h for h, _ in texts] == found and texts[0] == ("u1", "it's") and texts[6] == ("u7", "7")


@pytest.mark.parametrize(
    ("page", "inside"),
    [
        ("<ul><li class=wiki><a href=in></a><li><a href=out></a></ul>", ["in"]),
        ("<ul><li class=wiki><ul><li>x<li><a href=in></a></ul><a href=in2></a></ul><a href=out></a>", ["in", "in2"]),
        ("<p class=wiki><a href=in></a><div><a href=out></a></div>", ["in"]),
        ("<table><tr class=wiki><td><a href=in></a><td><table><tr><td><a href=in2></a></table><tr><td><a href=out></a></table>", ["in", "in2"]),
        ("<dl><dt class=wiki><a href=in></a><dd><a href=out></a></dl>", ["in"]),
        ("<div class=wiki><span></div></span><a href=out></a>", []),
        ("<span class=wiki><p></span><a href=in></a></p></span><a href=out></a>", ["in"]),
        ("<div class=wiki><b><p></b><a href=in></a></p></div></body><a href=out></a>", ["in"]),
        ("<td class=wiki><a href=in></a></li></p><a href=in2></a></td>", ["in", "in2"]),
    ],
)
def test_elements_without_end_tags(spark, page, inside):
    assert [h for _, _, h in hrefs(harvest.links_within_class(pages(spark, page), "wiki"))] == inside


def test_quotes_inside_dump_fields_are_data(spark):
    body = (
        "lang,prefix,http\nEnglish,5\" disc,200\nFrench,b,200\r\nGerman,7\" x,200\n\nEnglish,c,200\n"
        "\"two\nlines, \"\"q\"\"\",d,1\nx,\"never closed,2\nlast,e,3"
    )
    rows = harvest.dump_rows(spark.createDataFrame([("s", body)], "source string, body string")).orderBy("line_no").collect()
    assert [(r.lang, r.prefix, r.http) for r in rows] == [
        ("English", '5" disc', "200"), ("French", "b", "200"), ("German", '7" x', "200"), ("English", "c", "200"),
        ("two\nlines, \"q\"", "d", "1"), ("x", '"never closed', "2"), ("last", "e", "3"),
    ]


def test_rounds_shrink_to_unfinished_chases(spark, monkeypatch):
    """Short chases leave with all their pages; the rounds follow the longest chase, circles end at their own size."""
    shown = {f"short{i}": {p: 9 for p in range(1, 10)} for i in range(50)}
    shown["long"] = {p: min(p + 1, 300) for p in range(1, 301)}
    shown["circle"] = {p: p % 5 + 1 for p in range(1, 6)}
    rows = [(t, p, s) for t, chain in shown.items() for p, s in chain.items()]
    counts, original = [], harvest.staged

    def counted(df, label):
        out = original(df, label)
        if label == "jumps":
            counts.append(out.count())
        return out

    monkeypatch.setattr(harvest, "staged", counted)
    found = {r.term: r.last_page for r in harvest.last_pages(spark.createDataFrame(rows, "term string, page_no int, last_shown int")).collect()}
    assert found == {**{f"short{i}": 9 for i in range(50)}, "long": 300}
    # All 755 pages, then those of the long chase and the circle once the short chases have arrived.
    assert counts[0] == 755 and counts[1] == 755 and max(counts[2:]) <= 305
    assert counts[5] <= 300 and counts[-1] == 0 and len(counts) <= 12


TEXTS = [(1, "the cat sat"), (2, "The category of cats"), (3, ""), (4, None), (5, "concatenate  dog"), (6, "dog")]


def found_in(spark, words, **options):
    texts = spark.createDataFrame(TEXTS, "id int, text string").withColumn("word", F.lit("x"))
    table = spark.createDataFrame([(w,) for w in words], "word string")
    return sorted((r.id, r.word) for r in corpus.found_words(texts, table, "id", "text", **options).collect())


@pytest.mark.parametrize("block", [4_000_000, 4])
def test_word_tables_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(corpus, "BLOCK_CHARACTERS", block)
    words = ["cat", "cat", "category", "at", "Dog", "dog", "zzz", None, " ", "t s", "c"]
    for case_sensitive in (True, False):
        for spaced in (True, False):
            expected = set()
            for i, text in TEXTS:
                for w in {w for w in words if w is not None}:
                    needle, hay = (w, text or "") if case_sensitive else (w.lower(), (text or "").lower())
                    if text is not None and (f" {needle} " if spaced else needle) in hay:
                        expected.add((i, needle))
            assert found_in(spark, words, case_sensitive=case_sensitive, spaced=spaced) == sorted(expected)


def test_word_tables_without_words(spark):
    assert found_in(spark, []) == found_in(spark, [None]) == []
    assert found_in(spark, [""]) == [(i, "") for i, t in TEXTS if t is not None]


def test_plans_do_not_grow_with_the_list(spark):
    texts = spark.createDataFrame(TEXTS, "id int, text string")

    def size(n):
        table = spark.range(n).selectExpr("concat('w', id) AS word")
        return len(corpus.found_words(texts, table, "id", "text")._jdf.queryExecution().optimizedPlan().toString())

    assert abs(size(3000) - size(3)) < 200


def test_tables_of_elements(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["c", None]), (3, []), (4, None), (5, ["z", "a"])], "id int, items array<string>")
    wanted = spark.createDataFrame([("b",), ("b",), (None,), ("z",)], "item string")
    assert sorted(r.id for r in corpus.holding_listed(rows, wanted, "id", "items").collect()) == [1, 5]
    assert corpus.holding_listed(rows, wanted.limit(0), "id", "items").count() == 0
