"""Folds of operation logs, and the merge of concurrent changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_fold(ops: DataFrame, keys: Sequence[str], delta: Column) -> DataFrame:
    """The net sum of a log of increments by key."""
    return ops.groupBy(*keys).agg(F.sum(delta).cast("bigint").alias("value"))


def counter_running(ops: DataFrame, keys: Sequence[str], order: Sequence[str], delta: Column) -> DataFrame:
    """The log with the counter's value after each operation."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ops.withColumn("running", F.sum(delta).over(w).cast("bigint"))


def last_wins(ops: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the last operation by key: a partial aggregate, so a hot key isn't collected."""
    picked = ops.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("_last"))
    return picked.select(*keys, *[F.col("_last")[v].alias(v) for v in values])


def set_fold(ops: DataFrame, keys: Sequence[str], element: str, order: Sequence[str], kind: str) -> DataFrame:
    """Elements whose last operation is `add_element`."""
    return last_wins(ops, [*keys, element], order, [kind]).where(F.col(kind) == "add_element").select(*keys, element)


def set_merge(adds: DataFrame, removes: DataFrame, keys: Sequence[str], seq: str = "seq", ctx: str = "ctx") -> DataFrame:
    """Adds that no remove has observed: a remove takes away what was added up to its context.

    Only the largest context of an element matters, so removes are aggregated before they meet the adds.
    """
    seen = removes.groupBy(*keys).agg(F.max(ctx).alias("_ctx"))
    kept = adds.join(seen, list(keys), "left").where(F.col("_ctx").isNull() | (F.col(seq) > F.col("_ctx")))
    return kept.select(*keys).distinct()


def set_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` alone as `add`, of `old` alone as `remove`: one aggregate over both."""
    sides = new.withColumn("_side", F.lit(1)).unionByName(old.withColumn("_side", F.lit(2)))
    found = sides.groupBy(*new.columns).agg(F.bit_or("_side").alias("_side")).where("_side < 3")
    return found.select(*new.columns, F.when(F.col("_side") == 1, "add").otherwise("remove").alias("op"))


def op_rows(changed: DataFrame, key: str, paths: Column, values: Column) -> DataFrame:
    """(key, seq, op, path, value) from struct(updated, removed) paths and a map path -> value: removes come first."""
    removes = F.transform(paths["removed"], lambda p: F.struct(F.lit("remove").alias("op"), p.alias("path"), F.lit(None).cast("string").alias("value")))
    updates = F.transform(paths["updated"], lambda p: F.struct(F.lit("update").alias("op"), p.alias("path"), values[p].alias("value")))
    return changed.select(key, F.posexplode(F.concat(removes, updates)).alias("seq", "o")).select(key, "seq", "o.op", "o.path", "o.value")
