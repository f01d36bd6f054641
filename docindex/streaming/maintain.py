"""Structured Streaming extensions: continuous index maintenance, counters, ring windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docindex.plans.catalog import Collection, Manager


def maintain(actions: DataFrame, manager: Manager, collection: Collection, checkpoint: str, force: bool = False, every: str | None = None) -> StreamingQuery:
    """Applies each micro-batch of an actions stream to all indices of a collection.

    Deltas are idempotent (an identity's last action decides), so a batch that is retried leaves the same entries.
    It runs until what is there is read, or with `every` (like `10 seconds`) on and on.
    """

    def apply(batch: DataFrame, _: int) -> None:
        # Of each index the changes are held, so a batch for one index is read once without being held.
        held = batch.persist() if collection.size > 1 else batch
        try:
            manager.update_all_indices(held, collection, force)
        finally:
            if held.is_cached:
                held.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return actions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def counters(ops: DataFrame, keys: list[str], delta: Column) -> DataFrame:
    """Running sums of a stream of increments by key."""
    return ops.groupBy(*keys).agg(F.sum(delta).cast("bigint").alias("value"))


def ring(ops: DataFrame, ts: str, weeks: int, keys: list[str]) -> DataFrame:
    """Counts by week; rows later than the ring's `weeks` are out of bounds and dropped by the watermark."""
    return ops.withWatermark(ts, f"{7 * weeks} days").groupBy(F.window(ts, "7 days"), *keys).agg(F.count(F.lit(1)).alias("n"))
