"""State of the chat sessions, from their lifecycle events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KINDS = ("ready", "reconnected", "resumed", "disconnected")


def shard_states(lifecycle: DataFrame) -> DataFrame:
    """Latest state and number of ready events of each shard."""
    return (
        lifecycle.filter(F.col("kind").isin(*KINDS))
        .groupBy("shard")
        .agg(
            F.max_by("kind", F.struct("ts", "event_id")).alias("state"),
            F.count_if(F.col("kind") == "ready").alias("ready_events"),
        )
    )


def session_status(lifecycle: DataFrame) -> DataFrame:
    """One row per shard, and one with a NULL shard for the whole."""
    one_shard = F.grouping("shard") == 0
    return (
        shard_states(lifecycle)
        .rollup("shard")
        .agg(
            F.when(one_shard, F.max("state")).alias("state"),
            F.sum("ready_events").alias("ready_events"),
            F.count("*").alias("shards"),
            F.count_if(F.col("ready_events") > 0).alias("ready_shards"),
            F.bool_and(F.col("ready_events") > 0).alias("all_ready"),
        )
    )
