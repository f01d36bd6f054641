"""Connected components of an edge table, on the cluster alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges u < v."""
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").distinct()
    lowest = large.groupBy("v").agg(F.min("u").alias("m"))
    small = large.join(lowest, "v").select("u", "v", "m")
    down = small.where(F.col("u") > F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v"))
    return small.select(F.col("m").alias("u"), "v").unionAll(down).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the least node of its component.

    Alternates large-star and small-star steps until the edges stop changing. Each step is made of equality joins
    and partial aggregates, so a node of a great many edges is spread over tasks, and its table is cut.
    """
    e = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where(F.col("u") < F.col("v")).distinct())
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == seen or not now["n"]:
            break
        seen = now
        before, e = e, cut(_stars(e))
        discard(before)
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(roots)
