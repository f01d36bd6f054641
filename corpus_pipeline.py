"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what a stage returns is written
as Parquet and read again. Labels are read from the table of that name under sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docindex.llm import bpe, line_dedup, mixing, simhash, toxicity
from docindex.llm.common import scratch, table
from docindex.llm.queries import TARGETS, labelled_domains


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that three or more documents share, but for one document."""
    return line_dedup.apply_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages below their target weight are repeated; none is lost."""
    return mixing.apply_mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), targets=TARGETS)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the text they decode to."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokenised),
]

#: Toxicity and near-dedup are no SQL; the tests run the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        at = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
