"""Readiness of the shards of a running service."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wikiloom.session import claim


def ready_counts(lifecycle: DataFrame) -> DataFrame:
    """Ready events per shard, as one state row per shard."""
    return (
        lifecycle.filter(F.col("kind") == "ready")
        .groupBy("shard")
        .agg(F.count("*").alias("ready_events"))
    )


def all_ready(lifecycle: DataFrame, shards: int) -> DataFrame:
    """One row ``ready_shards``, once, when so many distinct shards have been ready.

    The first ready event of each shard alone goes on, so what reaches the one counting task is
    bounded by the number of shards. That the row was given out is part of the checkpointed state: it
    comes in one micro-batch, and again only if just that micro-batch is run again.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ready, done = state.get if state.exists else (0, False)
        ready += sum(len(batch) for batch in batches)
        if ready >= shards and not done:
            done = True
            yield pd.DataFrame({"ready_shards": [ready]})
        state.update((ready, done))

    first = lifecycle.filter((F.col("kind") == "ready") & F.col("shard").isNotNull()).select("shard").dropDuplicates(["shard"])
    return (
        first.withColumn("service", F.lit(0))
        .groupBy("service")
        .applyInPandasWithState(count, "ready_shards long", "ready long, done boolean", "append", GroupStateTimeout.NoTimeout)
    )


@dataclass(frozen=True)
class ReadyStream:
    """The two running queries: counts per shard, and the signal."""

    counts: StreamingQuery
    signals: StreamingQuery

    def awaitTermination(self) -> None:  # noqa: N802
        self.counts.awaitTermination()
        self.signals.awaitTermination()

    def stop(self) -> None:
        self.counts.stop()
        self.signals.stop()


def ready_stream(
    lifecycle: DataFrame,
    shards: int,
    signal: Callable[[int], None],
    table: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> ReadyStream:
    """Keep ready counts per shard in the folder ``table`` and signal once all are ready.

    Distinct shards count, not events. ``signal`` gets the number of the micro-batch in
    which the last shard became ready; a row ``batch_id, ready_shards`` of the folder ``{table}_signal`` says the same for
    readers of tables, exactly once. The state knows that it was given out, so a restarted query does not signal again.
    A micro-batch that is run again after a crash finds that it had claimed its signal, and does not repeat it: of
    a crash between claim and signal only the row is left.
    """
    spark = lifecycle.sparkSession
    due = trigger or {"availableNow": True}

    def keep(counts: DataFrame, batch_id: int) -> None:
        counts.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    def tell(ready: DataFrame, batch_id: int) -> None:
        rows = ready.collect()  # one row at most
        if not rows:
            return
        spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{table}_signal/batch_id={batch_id}")
        if claim(spark, f"{checkpoint}/signalled/{batch_id}"):
            signal(batch_id)

    counts = ready_counts(lifecycle).writeStream.outputMode("complete").foreachBatch(keep)
    signals = all_ready(lifecycle, shards).writeStream.outputMode("append").foreachBatch(tell)
    return ReadyStream(
        counts.option("checkpointLocation", f"{checkpoint}/counts").trigger(**due).start(),
        signals.option("checkpointLocation", f"{checkpoint}/signals").trigger(**due).start(),
    )
