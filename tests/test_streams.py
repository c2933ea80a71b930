import pytest
from pyspark.sql import functions as F

from fixtures.queries import QUERIES, Inputs
from fixtures.views import stream_view
from wikiloom import session
from wikiloom.operators import resolvers, sessions
from wikiloom.plans.answer import answer_messages
from wikiloom.sources import catalog_files
from wikiloom.streaming.answers import kept_answers, route_stream
from wikiloom.streaming.readiness import ready_stream

SF_DIR = "/root/testdata/sf0.001"
CATALOG = "seq long, referenceid string, endpoint string, resolverid string, displaycolor string"


@pytest.fixture
def fx(spark):
    return Inputs(spark, SF_DIR)


def file_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch(spark, fx, tmp_path):
    folder = str(tmp_path / "messages")
    fx.messages.repartition(3).write.parquet(folder)
    stream = file_stream(spark, folder, fx.messages.schema)
    running = route_stream(stream, lambda: fx.catalog_raw, fx.articles, str(tmp_path / "out"), str(tmp_path / "cp"))
    running.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch_id").distinct().count() == 3
    want = answer_messages(fx.messages, fx.catalog_raw, fx.articles)
    got = got.select(*want.columns)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_reloaded_catalogue_counts_from_the_next_batch(spark, fx, tmp_path):
    """Messages before the reload see the old catalogue, later ones the new."""
    root, folder, out, cp = (str(tmp_path / n) for n in ("catalog", "messages", "out", "cp"))
    messages = fx.messages.limit(1).select(
        "event_id", "ts", "user_id", F.lit("wiki fresh the").alias("content")
    )

    def publish(name):
        rows = spark.createDataFrame([(0, name, "https://x.org/api.php", "generic", "1")], CATALOG)
        catalog_files.write_snapshot(rows, root, ["seq"])

    def run():
        stream = file_stream(spark, folder, messages.schema)
        current = lambda: catalog_files.read_snapshot(spark, root)
        route_stream(stream, current, fx.articles, out, cp).awaitTermination()

    publish("old")
    messages.withColumn("event_id", F.lit(1).cast("long")).write.mode("append").parquet(folder)
    run()
    publish("fresh")
    messages.withColumn("event_id", F.lit(2).cast("long")).write.mode("append").parquet(folder)
    run()
    outcomes = {r.event_id: r.outcome for r in spark.read.parquet(out).collect()}
    assert outcomes == {1: "unknown_prefix", 2: "no_result"}


def test_ready_is_signalled_once(spark, tmp_path):
    folder, table, cp = (str(tmp_path / n) for n in ("events", "counts", "cp"))
    schema = "event_id long, ts timestamp, shard long, kind string"
    signals = []

    def add(*rows):
        frame = spark.createDataFrame([(i, s, k) for i, s, k in rows], "event_id long, shard long, kind string")
        frame.withColumn("ts", F.timestamp_seconds("event_id")).select(
            "event_id", "ts", "shard", "kind"
        ).coalesce(1).write.mode("append").parquet(folder)
        stream = file_stream(spark, folder, schema)
        ready_stream(stream, 3, signals.append, table, cp).awaitTermination()

    add((1, 0, "ready"), (2, 0, "ready"), (3, 1, "resumed"), (4, 2, "ready"))
    assert signals == []  # three ready events, but of two shards
    add((5, 1, "ready"))
    assert signals == [1]
    add((6, 1, "ready"), (7, 2, "disconnected"))
    assert signals == [1]
    counts = {r.shard: r.ready_events for r in spark.read.parquet(f"{table}/batch_id=2").collect()}
    assert counts == {0: 2, 1: 2, 2: 1}
    # The batch form agrees.
    events = spark.read.schema(schema).parquet(folder)
    status = {r.shard: (r.state, r.ready_events, r.shards, r.all_ready) for r in sessions.session_status(events).collect()}
    assert status == {
        0: ("ready", 2, 1, True), 1: ("ready", 2, 1, True), 2: ("disconnected", 1, 1, True), None: (None, 5, 3, True),
    }


def test_a_crash_after_the_signal_does_not_repeat_it(spark, tmp_path):
    folder, table, cp = (str(tmp_path / n) for n in ("events", "counts", "cp"))
    schema = "event_id long, ts timestamp, shard long, kind string"
    spark.createDataFrame([(1, 0, "ready"), (2, 1, "ready"), (3, None, "ready")], "event_id long, shard long, kind string").selectExpr(
        "event_id", "timestamp_seconds(event_id) AS ts", "shard", "kind"
    ).write.parquet(folder)
    signals = []

    def crash(batch_id):
        signals.append(batch_id)
        raise RuntimeError("crash after the signal")

    def run(signal):
        ready_stream(file_stream(spark, folder, schema), 2, signal, table, cp).awaitTermination()

    with pytest.raises(Exception, match="crash after the signal"):
        run(crash)
    run(signals.append)  # the micro-batch is run again
    run(signals.append)
    assert len(signals) == 1
    assert [r.ready_shards for r in spark.read.parquet(f"{table}_signal").collect()] == [2]


def test_repeated_requests_are_not_resolved_again(spark, fx, tmp_path, monkeypatch):
    folder, out, cp, kept = (str(tmp_path / n) for n in ("messages", "out", "cp", "kept"))
    asks = fx.asks.filter("event_id % 2 = 0")
    later = fx.asks.withColumn("event_id", F.col("event_id") + 1000)
    resolved, folders = [], []
    original, original_folder = resolvers.resolve, session.scratch_path

    def counted(requests, articles, registry=resolvers.REGISTRY):
        resolved.append({(r.endpoint, r.query) for r in requests.collect()})
        return original(requests, articles, registry)

    def noted(spark, label):
        path = original_folder(spark, label)
        if label.startswith("batch"):
            folders.append(path)
        return path

    monkeypatch.setattr(resolvers, "resolve", counted)
    monkeypatch.setattr(session, "scratch_path", noted)

    def run(messages):
        messages.coalesce(1).write.mode("append").parquet(folder)
        stream = file_stream(spark, folder, messages.schema)
        route_stream(stream, lambda: fx.catalog_raw, fx.wiki_pages, out, cp, kept=kept).awaitTermination()

    for messages in (asks, later, later.withColumn("event_id", F.col("event_id") + 1000)):
        run(messages)
    assert len(resolved) == 3 and resolved[0] and resolved[1] and not resolved[2]
    assert not resolved[0] & resolved[1]
    answers = kept_answers(spark, kept)
    assert answers.count() == len(resolved[0] | resolved[1]) and answers.filter("NOT hit").count() > 0
    monkeypatch.undo()
    everything = spark.read.schema(asks.schema).parquet(folder)
    want = answer_messages(everything, fx.catalog_raw, fx.wiki_pages)
    got = spark.read.parquet(out).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # No scratch table outlives its micro-batch.
    assert len(folders) == 3 and not any(session.exists(spark, f) for f in folders)


def test_a_batch_that_is_run_again_sees_what_it_saw(spark, fx, tmp_path):
    """Answers that a failed run of the same micro-batch has kept do not count as known."""
    kept = str(tmp_path / "kept")
    rows = spark.createDataFrame([("e", "q", "generic", None, True)], "endpoint string, query string, resolver string, article_id long, hit boolean")
    rows.write.parquet(f"{kept}/batch_id=0")
    rows.write.parquet(f"{kept}/batch_id=1")
    assert kept_answers(spark, str(tmp_path / "none")) is None
    assert kept_answers(spark, kept, 0).count() == 0 and kept_answers(spark, kept, 1).count() == 1 and kept_answers(spark, kept).count() == 2


def test_scratch_folders(spark):
    with session.scratch_folder(spark, "job") as folder:
        table = session.staged(spark.range(3), "rows")
        assert session.exists(spark, folder) and table.inputFiles()[0].split(":")[-1].lstrip("/").startswith(folder.lstrip("/"))
        with session.scratch_folder(spark, "inner", keep=True) as inner:
            session.staged(spark.range(1), "rows")
        assert inner.startswith(folder) and session.exists(spark, inner)
    assert not session.exists(spark, folder) and not session.scratch_path(spark, "x").startswith(folder)


def test_streams_read_tables_of_one_file_and_of_several(spark, tmp_path):
    page = "<title>{}</title><p>one two three four five six</p>"
    pages = spark.createDataFrame(
        [(i, f"https://w{i}.org/{i}", page.format(f"Some title{i}")) for i in range(12)], "page_id long, url string, html string"
    )
    folder, single = tmp_path / "folder", tmp_path / "single"
    pages.repartition(3).write.parquet(str(folder / "pages.parquet"))
    single.mkdir()
    pages.toPandas().to_parquet(single / "pages.parquet")
    answers = []
    for path in (folder, single):
        running = stream_view(spark, str(path), "fx_asks", "pages").writeStream.format("memory").queryName(f"asks_{path.name}")
        running.trigger(availableNow=True).start().awaitTermination()
        assert spark.table(f"asks_{path.name}").count() == 12
        answers.append(sorted(map(str, QUERIES["route_stream_kept"](spark, str(path)).collect())))
    assert len(answers[0]) == 12 and answers[0] == answers[1]
