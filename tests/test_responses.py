from wikiloom.sources import responses

API, V1 = "https://a.org/w/api.php", "https://b.org/api/v1"


def table(spark, bodies):
    return spark.createDataFrame(list(bodies.items()), "url string, body string")


def requests(spark, endpoint, *queries):
    return spark.createDataFrame([(endpoint, q) for q in queries], "endpoint string, query string")


def search(query):
    return f"{API}?action=query&srsearch={query}&srprop&list=search&format=xml"


def info(title):
    return (
        f"{API}?action=query&titles={title}&prop=extracts%7Cinfo%7Cpageimages&pithumbsize=800"
        "&inprop=url&exintro&explaintext&exchars=1200&format=xml"
    )


def test_generic(spark):
    bodies = {
        search("two"): '<api><query><search><p title="A &amp; B"/><p title="C"/></search></query></api>',
        search("year"): '<api><query><search><p title="1984"/></search></query></api>',
        search("none"): '<api><query><search/></query></api>',
        search("broken"): "<html",
        search("lost"): '<api><query><search><p title="Lost"/></search></query></api>',
        info("A+%26+B"): '<api><query><pages><page fullurl="http://a.org/A"><extract xml:space="preserve">One.... two</extract>'
        '<thumbnail source="http://t"/></page></pages></query></api>',
        info("1984"): '<api><query><pages><page fullurl="http://a.org/1984"><extract xml:space="preserve">Book</extract></page></pages></query></api>',
    }
    got = responses.generic_cards(
        requests(spark, API, "two", "two", "year", "none", "broken", "lost", "unfetched"), table(spark, bodies)
    )
    assert sorted(map(tuple, got.collect())) == [
        (API, "two", "A & B", "One. two", "http://t", "http://a.org/A"),
        (API, "year", "1984", "Book", "", "http://a.org/1984"),
    ]


def wikia_search(query):
    return f"{V1}/Search/List?query={query}&limit=1&minArticleQuality=1&batch=1&namespaces=0%2C14"


def test_wikia(spark):
    def page(number, sections, item):
        return {
            f"{V1}/Articles/AsSimpleJson?id={number}": sections,
            f"{V1}/Articles/Details?ids={number}&abstract=500": f'{{"basepath": "http://b.org", "items": {{"{number}": {item}}}}}',
        }

    bodies = {
        wikia_search("one%20word"): '{"total": 2, "items": [{"id": 7}, {"id": 8}]}',
        wikia_search("same"): '{"total": 1, "items": [{"id": 7}]}',
        wikia_search("short"): '{"total": 1, "items": [{"id": 9}]}',
        wikia_search("none"): '{"total": 0, "items": []}',
        wikia_search("broken"): "oops",
        **page(7, '{"sections": [{"content": [{"text": "First"}, {"text": "Second"}]}]}',
               '{"url": "/wiki/A", "title": "A", "thumbnail": "http://t", "abstract": "x"}'),
        **page(9, '{"sections": [{"content": []}]}',
               '{"url": "/wiki/S", "title": "S", "thumbnail": {"none": 1}, "abstract": "One. Two. Cut"}'),
    }
    asked = requests(spark, V1, "one word", "same", "short", "none", "broken")
    got = responses.wikia_cards(asked, table(spark, bodies))
    assert sorted(map(tuple, got.collect())) == [
        (V1, "one word", "A", "First", "http://t", "http://b.org/wiki/A"),
        (V1, "same", "A", "First", "http://t", "http://b.org/wiki/A"),
        (V1, "short", "S", "One. Two.", "", "http://b.org/wiki/S"),
    ]
    old = responses.wikia_cards(asked, table(spark, bodies), mode="reference")
    assert [r.summary for r in old.collect() if r.query == "short"] == ["One. "]


MESSAGES = "event_id long, content string, ts timestamp"


def test_answers_come_step_by_step(spark):
    """Fetch what is planned until nothing is left; the answers are those from the articles."""
    from fixtures.queries import Inputs
    from fixtures.views import simulated_wikis
    from wikiloom.operators import routing
    from wikiloom.plans import answer

    fx = Inputs(spark, "/root/testdata/sf0.001")
    asked = answer.looked_up_requests(routing.route(fx.asks), fx.endpoints)
    wikis = simulated_wikis(asked, fx.wiki_pages).persist()
    fetched, kinds = wikis.limit(0), []
    for _ in range(4):
        plan = answer.requests_to_fetch(fx.asks, fx.catalog_raw, fetched)
        more = responses.unfetched(plan, fetched).persist()
        kinds.append({r.kind for r in more.select("kind").distinct().collect()})
        fetched = spark.createDataFrame(fetched.union(wikis.join(more.select("url"), "url")).collect(), wikis.schema)
    assert kinds == [{"search"}, {"page_info", "sections", "details"}, set(), set()]
    sizes = fx.wiki_pages.selectExpr("thumb_url AS url", "thumb_w AS width", "thumb_h AS height").filter("url IS NOT NULL").dropDuplicates(["url"])
    got = answer.answer_from_responses(fx.asks, fx.catalog_raw, fetched, sizes)
    want = answer.answer_messages(fx.asks, fx.catalog_raw, fx.wiki_pages)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r.outcome for r in want.select("outcome").distinct().collect()} >= {"result", "unknown_prefix"}
    # Without sizes no picture is shown; without page responses there is no card.
    bare = answer.answer_from_responses(fx.asks, fx.catalog_raw, fetched)
    assert bare.filter("image_url IS NOT NULL OR thumbnail_url IS NOT NULL").count() == 0
    searches = fetched.filter("url LIKE '%srsearch%' OR url LIKE '%Search/List%'")
    assert answer.answer_from_responses(fx.asks, fx.catalog_raw, searches).filter("outcome = 'result'").count() == 0


def test_a_resolver_is_a_function_of_tables(spark):
    from wikiloom.plans import answer

    def fixed(requests, tables):
        """The same card for each request, from a table of its own."""
        card = tables["notes"].selectExpr("note AS title", "note AS summary", "'' AS thumb_url", "'p' AS page_url", "1 AS thumb_w", "1 AS thumb_h", "7L AS article_id")
        return requests.select("endpoint", "query", "resolver").distinct().join(card)

    catalog = spark.createDataFrame(
        [(0, "n", "https://n.org/x", "notes", "1"), (1, "a", API, "generic", "2"), (2, "z", "https://z.org/x", "other", "3")],
        "seq long, referenceid string, endpoint string, resolverid string, displaycolor string",
    )
    bodies = {search("year"): '<api><query><search><p title="1984"/></search></query></api>',
              info("1984"): '<api><query><pages><page fullurl="u"><extract xml:space="preserve">Book</extract></page></pages></query></api>'}
    texts = ["wiki n any", "wiki a year", "wiki z any", "wiki a none", "wiki q any", "wiki a"]
    messages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id long, content string").selectExpr("*", "TIMESTAMP '2024-03-01 10:00:00' AS ts")
    tables = {"notes": spark.createDataFrame([("N",)], "note string"), "responses": table(spark, bodies)}
    registry = {"notes": fixed, **responses.REGISTRY}
    got = {r.event_id: (r.outcome, r.title) for r in answer.answer_from_tables(messages, catalog, tables, registry).collect()}
    assert got == {0: ("result", "N"), 1: ("result", "1984"), 2: ("unknown_resolver", None), 3: ("no_result", None), 4: ("unknown_prefix", None), 5: ("no_query", None)}
