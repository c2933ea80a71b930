import random

import numpy as np
import pytest

from tests.llm.conftest import SMALL, rows_of
from wikiloom.llm import html_extract, url_filter
from wikiloom.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"
URLS = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"), ("http://A.NET/x", "a.net", "/x", "net/", "block"), ("http://a.net", "a.net", "", None, "allow"),
    ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"), ("https://m.example.net/en", "m.example.net", "/en", "net/", "block"),
    ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("x://b.example.com/de/?q=/en/", "b.example.com", "/de/", "example.com/de/", "block"),
    ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"), ("http://a.net:80/x", "a.net:80", "/x", None, "allow"), ("http://?q", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("a.net/x", "", "", None, "allow"), ("http://h.net#/x", "h.net", "", None, "allow"), ("http:///net/", "", "/net/", None, "allow"),
    ("y://a.net\n/p\nq?", "a.net\n", "/p\nq", None, "allow"), ("http://a.net/x", "a.net", "/x", "net/", "block"),
]


@pytest.mark.parametrize("shard", [1, 1000])
def test_url_rules(spark, shard):
    table = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    found = url_filter.filter_urls(table, spark.createDataFrame(URL_RULES, RULES), shard_rules=shard)
    assert rows_of(found) == sorted(((i, *u) for i, u in enumerate(URLS)), key=repr)


def test_no_rules_and_no_urls(spark):
    table = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, RULES)
    assert rows_of(url_filter.filter_urls(table, rules.limit(0))) == [(1, "http://a.net/", "a.net", "/", None, "allow")]
    assert rows_of(url_filter.filter_urls(table.limit(0), rules)) == []


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda text: 7)
    for ending, data in url_filter.DigestArray.files([("a", "/", "block"), ("b", "/", "allow"), ("a", "/", "allow")]).items():
        (tmp_path / f"r.{ending}").write_bytes(data)
    array = url_filter.DigestArray(str(tmp_path), "r")
    assert isinstance(array.keys, np.memmap)
    assert array.probe(["a/", "b/", "c/"]) == ["block", "allow", None]


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


MARKED = [
    ("<nav><a>Home</a></nav><article><h1>One</h1><p>A  b&amp;c\n d<p>Next<div class='ad box'>buy</div></article><footer>&copy;</footer>", "One\n\nA b&c d\n\nNext"),
    ("<article><p>x<br>y <b>z</b>w</p><aside>side</aside><ul><li>i<li>j</ul><form>send</form></article>", "x y zw\n\ni\n\nj"),
    ("<main><h2>T</h2>bare text<section id=comments><p>me too</p></section><!-- gone --></main>", "T\n\nbare text"),
    ("<article></article>", ""), ("<article><p>open &lt;tag&gt; &#233;", "open <tag> é"), ("<article><p title=it's>q</p><p data-x='>'>r</article>", "q\n\nr"),
]


def test_marked_articles(spark):
    rows = [(i, "http://h.example/", page(body)) for i, (body, _) in enumerate(MARKED)] + [(90, None, None), (91, "http://h.example/", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(table).collect()}
    assert found == {**{i: (t, len(t)) for i, (_, t) in enumerate(MARKED)}, 90: ("", 0), 91: ("", 0)}
    assert rows_of(html_extract.extract(table.limit(0))) == []


def test_wrappers_tell_content_from_template(spark):
    """Pages without a word about their parts: only the alignment can tell them."""
    rows, expected = [], {}
    for i in range(30):
        story = [f"Story {i} has words number {j} {'and more ' * (i % 5 + j)}".strip() for j in range(1 + i % 4)]
        body = (
            "<div><div>Site name</div><div>All about us</div></div>"
            f"<div class=x>{''.join(f'<p>{s}</p>' for s in story)}<div>Read this first</div></div><div><span>Made by us</span></div>"
        )
        rows.append((i, f"http://plain.example/{i}", page(body)))
        expected[i] = "\n\n".join(story)
    rows.append((99, "http://alone.example/", page("<div>Only <i>page</i></div>")))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()}
    assert found == {**expected, 99: "Only page"}


def test_equal_pages_prove_no_template(spark):
    rows = [(i, "http://h.example/", page("<article><p>same</p><div>words</div></article>")) for i in range(9)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in found.collect()} == {"same\n\nwords"}


def test_tree_matching_by_definition():
    leaf = lambda kind, *kids: [kind, 1, "", 0, list(kids)]
    a = [leaf("p"), leaf("div", leaf("b"), leaf("i")), leaf("p"), leaf("ul")]
    b = [leaf("div", leaf("i")), leaf("ul"), leaf("div", leaf("b"), leaf("i"))]
    assert html_extract._table(a, b)[0][-1][-1] == 3
    assert [(a[i][0], b[j][0]) for i, j in html_extract.aligned(a, b)] in ([("div", "div"), ("ul", "ul")], [("div", "div")])


def test_pages_of_the_table(spark):
    """The article between its tags, read by a plain search of this table's known form."""
    import html as entities
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in html_extract.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert r["text"] == "\n\n".join(x for x in blocks if x)
        assert r["n_chars"] == len(r["text"])


def test_deep_pages_do_not_break(spark):
    rows = [(1, "http://h.example/", "<div>" * 5000 + "deep" + "</div>" * 5000)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [r["text"] for r in found.collect()] == ["deep"]


def test_text_below_any_level_counts_as_varying(spark):
    rows, expected = [], {}
    for i in range(5):
        deep = "<div>" * 60 + f"<p>Story {i} of the day</p><div>Read on</div>" + "</div>" * 60
        rows += [(i, "http://a.example/", page(f"<article><h1>Title {i}</h1>{deep}</article>")), (10 + i, "http://b.example/", page(f"<h1>Title {i}</h1>{deep}"))]
        expected |= dict.fromkeys((i, 10 + i), f"Title {i}\n\nStory {i} of the day")
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()} == expected


def test_wide_pages_keep_their_text_and_lose_their_template(spark):
    """Over 64 runs of siblings: constant ones are template and varying ones are read, wherever they stand."""
    rows, expected = [], {}
    for i in range(6):
        runs = "".join(f"<p>Part {j} of story {i}</p><div class=x{j}>Notice {j}</div>" for j in range(50))
        late = "".join(f"<div class=a{j}>Box</div><div class=b{j}>Box</div>" for j in range(40)) + f"<section>End of story {i}</section>"
        rows.append((i, "http://w.example/", page(f"<article>{runs}<div>{late}</div></article>")))
        expected[i] = "\n\n".join([*(f"Part {j} of story {i}" for j in range(50)), f"End of story {i}"])
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()} == expected


def test_rare_nodes_leave_what_varies_in_them():
    leaf = lambda kind, pages, text, size, *kids: [kind, pages, text, size, list(kids)]
    found = html_extract.pruned(leaf("div", 10, "", 0, leaf("p", 5, "h", 9), leaf("ul", 4, "", 0, leaf("li", 4, "*", 7)), leaf("b", 2, "k", 3)), 10)
    assert found == leaf("div", 10, "*", 7, leaf("p", 5, "h", 9))


def test_unmarked_pages_keep_all_that_varies(spark):
    """Titles and leads beside the node with most of the text, at several levels."""
    rows, expected = [], {}
    for i in range(8):
        story = "".join(f"<p>{f'Part {j} of story {i} '.strip()} {'and more ' * 30}</p>" for j in range(4))
        inner = f"<div>By author {i}</div><div class=body>{story}</div><p>All rights reserved</p>"
        rows.append((i, "http://a.example/", page(f"<a>Home</a><h1>Title {i}</h1><p>lead {i}</p><div>Site name</div><nav>Go {i}</nav><div class=all>{inner}</div>")))
        parts = [f"Part {j} of story {i} {'and more ' * 30}".strip() for j in range(4)]
        expected[i] = "\n\n".join([f"Title {i}", f"lead {i}", f"By author {i}", *parts])
        # Only one child of the body varies: the rest is left out, whatever its tags are.
        rows.append((20 + i, "http://b.example/", page(f"Site <a>Home</a><p>Slogan</p><div class=x><h2>Title {i}</h2><p>text {i}</p></div><p>Imprint</p>")))
        expected[20 + i] = f"Title {i}\n\ntext {i}"
    rows += [(40 + i, "http://two.example/", page(f"<p>same</p><div>text {i}</div>")) for i in range(2)]
    expected |= {40 + i: f"same\n\ntext {i}" for i in range(2)}
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()}
    assert {i: t.replace("\n\nAll rights reserved", "") for i, t in found.items()} == expected


@pytest.mark.parametrize("levels", [150, 198, 300, 2000])
def test_no_level_loses_or_leaks_text(spark, levels):
    """What stands after deeply nested elements is read, and scripts and menus in them are not."""
    rows = []
    for i in range(12):
        inner = f"<p>in {i}</p><script>var x = {i};</script><nav>menu {i}</nav>"
        deep = "<div>" * levels + inner + "</div>" * levels
        rows.append((i, f"http://{'abc'[i % 3]}.example/{i}", page(f"<article><p>start {i}</p>{deep}<p>end {i}</p></article>")))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()}
    assert found == {i: f"start {i}\n\nin {i}\n\nend {i}" for i in range(12)}


def test_wrappers_of_any_depth_survive_writing():
    tree = ["p", 3, "*", 5, []]
    for i in range(3000):
        tree = ["div", 3, "", 0, [["b", 1, "h", i, []], tree]]
    again = html_extract._read(html_extract._written(tree))
    while tree[4]:
        assert tree[:4] == again[:4] and tree[4][0] == again[4][0]
        tree, again = tree[4][1], again[4][1]
    assert tree == again


def test_parts_of_an_article_with_names_of_menus(spark):
    """Headings in an article's header and prose in elements named like menus are text; lists of links and what is the same everywhere are not."""
    rows, expected = [], {}
    for i in range(6):
        article = (
            f"<header><h1>Title {i}</h1></header><div class='article-header'><h2>Chapter {i}</h2></div><p class='menu item'>A sentence about {i}.</p>"
            f"<div id='related-work'><p>Work that is related to {i} in words.</p></div><div class='related'><h3>Related</h3><a href=x>Another story {i + 1}</a></div>"
            f"<ul class=menu><li><a href=y>Part {i}</a></li></ul><div class=header>The Daily Site</div><div class=comments><p>I like {i}</p></div><p>End {i}</p>"
        )
        rows.append((i, "http://h.example/", page(f"<header><h1>Site {i}</h1></header><div class=menu>Go on {i}</div><article>{article}</article>")))
        expected[i] = f"Title {i}\n\nChapter {i}\n\nA sentence about {i}.\n\nWork that is related to {i} in words.\n\nEnd {i}"
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()} == expected


def test_the_wrapper_decides(spark):
    """The same pages without a wrapper keep their template."""
    rows = [(i, "http://h.example/", page(f"<div>Site name</div><div class=x><p>Story {i}</p><div>Read on</div></div>")) for i in range(8)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()}
    bare = {i: html_extract.Wrapper(None).text(text) for i, _, text in rows}
    assert found == {i: f"Story {i}" for i in range(8)}
    assert bare == {i: f"Site name\n\nStory {i}\n\nRead on" for i in range(8)}


def _most_matched(a, b):
    """Simple tree matching as it is defined, without a table."""
    if a[0] != b[0]:
        return 0

    def best(left, right):
        if not left or not right:
            return 0
        return max(best(left[1:], right), best(left, right[1:]), _most_matched(left[0], right[0]) + best(left[1:], right[1:]))

    return 1 + best(a[4], b[4])


@pytest.mark.parametrize("seed", range(20))
def test_tree_matching_equals_brute_force(seed):
    numbers = random.Random(seed)

    def tree(levels):
        return [numbers.choice("abc"), 1, "", 0, [tree(levels - 1) for _ in range(numbers.randint(0, 3) if levels else 0)]]

    for _ in range(30):
        a, b = tree(3), tree(3)
        assert html_extract._weight(a, b) == _most_matched(a, b)
