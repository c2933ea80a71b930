from pyspark.sql import functions as F

from wikiloom.operators import cards, resolvers, routing


def messages(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "event_id long, content string").withColumn(
        "ts", F.lit("2024-03-01 23:30:00").cast("timestamp_ntz")
    )


def routes(spark, texts, **options):
    got = routing.route(messages(spark, texts), **options).collect()
    return {texts[r.event_id]: (r.route, r.wiki_key, r.query) for r in got}


def test_routes(spark):
    assert routes(
        spark,
        ["wiki help", "wiki  help", "WIKI HELP", "wiki help me", "wiki ", "wiki", "wikis x y",
         " wiki x y", "wiki Blog", "wiki  Blog  a   B ", "wiki b \t q\t", None],
    ) == {
        "wiki help": ("help", "help", None),
        "wiki  help": ("ignored", "help", None),
        "WIKI HELP": ("ignored", "help", None),
        "wiki help me": ("ignored", "help", "me"),
        "wiki ": ("query", None, None),
        "wiki Blog": ("query", "blog", None),
        "wiki  Blog  a   B ": ("query", "blog", "a B"),
        "wiki b \t q\t": ("query", "b", "q"),
    }


def test_prefix_with_capitals(spark):
    texts = ["Wiki help", "wiki b q"]
    assert set(routes(spark, texts, prefix="Wiki")) == set(texts)
    assert routes(spark, texts, prefix="Wiki", mode="reference") == {}


ENDPOINTS = "seq long, referenceid string, endpoint string, resolverid string, color int"


def test_lookup_takes_the_first_in_any_case(spark):
    endpoints = spark.createDataFrame(
        [(2, "blog", "u2", "generic", 1), (1, "Blog", "u1", "generic", 1), (3, "c", "u3", "custom", 1)], ENDPOINTS
    )
    asked = spark.createDataFrame([("blog",), ("blog",), ("c",), ("no",), (None,)], "wiki_key string")
    rows = routing.with_resolver(routing.with_endpoint(asked, endpoints)).collect()
    assert sorted((str(r.wiki_key), str(r.endpoint), str(r.resolver)) for r in rows) == [
        ("None", "None", "None"), ("blog", "u1", "generic"), ("blog", "u1", "generic"), ("c", "u3", "None"), ("no", "None", "None"),
    ]


def test_requests(spark):
    asked = spark.createDataFrame(
        [("https://a/w/api.php", "c++ é *~", "generic"), ("https://b/api/v1", "x y", "wikia"), ("u", "q", None)],
        "endpoint string, query string, resolver string",
    )
    urls = {r.resolver: r.url for r in routing.search_requests(asked).collect()}
    assert urls == {
        "generic": "https://a/w/api.php?action=query&srsearch=c%2B%2B+%C3%A9+*%7E&srprop&list=search&format=xml",
        "wikia": "https://b/api/v1/Search/List?query=x%20y&limit=1&minArticleQuality=1&batch=1&namespaces=0%2C14",
    }
    hits = spark.createDataFrame(
        [("https://a/w/api.php", "generic", "A|B c", 7)], "endpoint string, resolver string, title string, article_id long"
    )
    assert [(r.kind, r.url) for r in routing.page_requests(hits).collect()] == [
        ("page_info", "https://a/w/api.php?action=query&titles=A%7CB+c&prop=extracts%7Cinfo%7Cpageimages"
         "&pithumbsize=800&inprop=url&exintro&explaintext&exchars=1200&format=xml")
    ]


ARTICLES = (
    "article_id long, host string, page_url string, title string, section_text string, "
    "abstract_text string, ns int, quality int, thumb_url string, thumb_w int, thumb_h int"
)


def test_summaries_and_eligible_articles(spark):
    articles = spark.createDataFrame(
        [
            (1, "a", "p1", "Cat", "", "Cat one. Cat two. Cut", 2, 1, None, 1, 1),
            (2, "a", "p2", "Cat", None, "Cat one. Cat two. Cut....", 14, 1, None, 1, 1),
            (3, "a", "p3", "Cat", "Section", "Cat", 0, 0, "t", 1, 1),
            (4, "a", "p4", "Dog", "Section", "x" * 1300, 0, 5, "t", 1, 1),
        ],
        ARTICLES,
    )
    asked = [("http://a/x", q, r) for q in ("cat", "dog") for r in ("generic", "wikia", "old")]
    requests = spark.createDataFrame([*asked, ("http://a/x", "cat", "none")], "endpoint string, query string, resolver string")
    registry = {**resolvers.REGISTRY, "old": resolvers.WIKIA_REFERENCE}
    got = {
        (r.query, r.resolver): (r.article_id, r.summary, r.thumb_url)
        for r in resolvers.resolve(requests, articles, registry).collect()
    }
    assert got == {
        ("cat", "generic"): (1, "Cat one. Cat two. Cut", ""),
        ("cat", "wikia"): (2, "Cat one. Cat two. Cut.", ""),
        ("cat", "old"): (2, "Cat one. Cat two. ", ""),
        ("dog", "generic"): (4, "x" * 1200, "t"),
        ("dog", "wikia"): (4, "Section", "t"),
        ("dog", "old"): (4, "Section", "t"),
    }


def test_card(spark):
    sizes = [(1, 176, 100, "t"), (2, 175, 100, "t"), (3, 10, 0, "t"), (4, None, None, "t"), (5, 9, 1, "")]
    answered = spark.createDataFrame(sizes, "event_id long, thumb_w int, thumb_h int, thumb_url string").withColumns(
        {
            "ts": F.lit("2024-03-01 23:30:00").cast("timestamp_ntz"),
            "outcome": F.lit("result"),
            "endpoint": F.when(F.col("event_id") == 2, "broken").otherwise("https://a.org/w/api.php"),
            "title": F.lit("T"), "page_url": F.lit("P"), "summary": F.lit("S"), "color": F.lit(1),
        }
    )
    shown = {r.event_id: (r.image_url, r.thumbnail_url, r.footer) for r in cards.result_cards(answered).collect()}
    footer = "From a.org | Requested 03/01/2024"
    assert shown == {
        1: ("t", None, footer), 2: (None, "t", None), 3: (None, None, footer), 4: (None, None, footer), 5: (None, None, footer),
    }
