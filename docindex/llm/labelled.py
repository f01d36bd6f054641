"""The bounded sample of labelled documents that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Labelled documents that a model is fitted to at most, chosen by a digest of their ids.
MAX_DOCS = 4000


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from; those without an id aren't."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `max_docs` labels outside the held-out fold.

    The chosen ids are at most `max_docs` rows, so they are broadcast; texts aren't shuffled.
    """
    usable = labels.where((remainder(F.col(id_col)) != 0) & F.col(label).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "label").limit(max_docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def without_label(docs: DataFrame, labels: DataFrame, max_docs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `max_docs` documents that no row of `labels` names; their label is null."""
    named = labels.select(F.col(id_col).alias("_id")).distinct()
    ids = docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").join(named, "_id", "left_anti")
    chosen = ids.distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.lit(None).cast("int").alias("label"))
