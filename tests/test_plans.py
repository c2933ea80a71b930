"""What the optimizer makes of the jobs."""

import re

import pytest
from pyspark.sql import functions as F

from fixtures.queries import QUERIES, Inputs
from wikiloom.operators import catalog, routing

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - {"route_stream", "route_stream_kept", "ready_stream"}))
def test_no_pairing_of_all_with_all(spark, key):
    text = plan(QUERIES[key](spark, SF_DIR))
    physical = text[text.index("== Physical Plan =="):]
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
        assert bad not in physical


def test_first_rows_are_cut_before_the_shuffle(spark):
    fx = Inputs(spark, SF_DIR)
    for mode in ("default", "reference"):
        assert "WindowGroupLimit" in plan(catalog.load(fx.catalog_raw, mode))


def test_small_catalogue_is_broadcast_and_large_one_is_not(spark):
    fx = Inputs(spark, SF_DIR)
    rows = routing.route(fx.messages).select("event_id", "wiki_key")
    joined = routing.with_endpoint(rows, fx.endpoints)
    assert "BroadcastHashJoin" in plan(joined)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        joined = routing.with_endpoint(rows, fx.endpoints)
        assert "SortMergeJoin" in plan(joined) and "BroadcastHashJoin" not in plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32m")


def test_scans_read_the_columns_in_use_only(spark):
    text = plan(QUERIES["word_list_match"](spark, SF_DIR))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)
    text = plan(QUERIES["known_host_anti"](spark, SF_DIR))
    assert "html" not in text[text.index("== Physical Plan =="):]


def test_hot_keys_are_split(spark):
    """A key with a third of all rows is split over tasks if its side is shuffled."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 1000))
        rows = spark.range(0, 300_000, 1, 16).select("id", key.alias("wiki_key"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        endpoints = spark.range(1000).select(
            F.col("id").alias("seq"),
            F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("referenceid"),
            F.lit("u").alias("endpoint"), F.lit("generic").alias("resolverid"), F.lit(1).alias("color"),
        )
        joined = routing.with_endpoint(rows, endpoints)
        assert len(joined.collect()) == 300_000
        assert "skew=true" in plan(joined)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
