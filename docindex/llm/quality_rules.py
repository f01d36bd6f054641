"""Quality rules: word and line statistics of whole texts, and verdicts on hosts from the rules' failures.

A document fails by itself with fewer than `min_words` words, or when more than `max_repeat` percent of its words
lie in 8-word windows that its text holds twice or more. Failures are counted by host, each host's rate is shrunk
by a beta prior that is fitted to all hosts by their moments, and a host of a shrunk rate over `max_host_rate`
loses all its documents.

Defined cases. Null and empty texts have no words and fail. A null host is a host of its own. Repeated rows count
as often as they come. Where hosts don't differ (or there is one), the prior is Beta(1, 1) scaled to their mean.
A window's identity is a 64-bit hash of its words' 64-bit hashes, compared within one text only.

Plan. All statistics are array functions inside the row: no explode, no shuffle of words. The narrow table of
statistics is written once; hosts are a partial aggregate of it and come back by an equality join, which becomes a
broadcast only when the measured size of the host table allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, let, text_of

WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _covered(windows: Column) -> Column:
    """Number of words in windows whose hash comes twice or more; `windows`: hashes by position."""

    def marked(e: Column) -> Column:
        last = F.size(e) - 1
        twice = F.filter(e, lambda x, i: ((i > 0) & (F.get(e, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(e, i + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(let(ordered, marked), start, step, lambda a: a["n"])


def repeat_words(words: Column) -> Column:
    """Words in windows of eight found twice or more, the first finding included."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def count(hashes: Column) -> Column:
        found = let(windows(hashes), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)))
        return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(found)

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row of counts for each document, from its whole text."""
    text = F.col("text")
    full = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r")))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text_of(text_col).alias("text"))
        .select(
            "doc_id",
            "host",
            of_words.alias("w"),
            (F.length(text) - F.length(F.regexp_replace(text, r"\S+", ""))).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
        )
        .select("doc_id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
    )


def host_verdicts(stats: DataFrame, max_host_rate: float = 0.5) -> DataFrame:
    """(host, shrunk_rate, host_kept) from `host` and `base_failed`."""
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    seen = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), (F.count(F.lit(1)) / F.sum(1 / F.col("n"))).alias("per_host")).first()
    mean, strength = beta_prior(seen["m"], seen["v"], seen["per_host"])
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", shrunk.alias("shrunk_rate"), (shrunk <= max_host_rate).alias("host_kept"))


def beta_prior(mean: float | None, variance: float | None, per_host: float | None) -> tuple[float, float]:
    """(mean, strength) from the moments of the hosts' rates; `per_host` is the harmonic mean of their sizes."""
    if mean is None:
        return 0.5, 2.0
    # The variance between hosts is what sampling within hosts of that size doesn't explain.
    between = (variance or 0.0) - mean * (1 - mean) / per_host
    return mean, max(mean * (1 - mean) / between - 1, 0.0) if between > 0 else 2.0


def quality_rules(docs: DataFrame, min_words: int = 20, max_repeat: int = 30, max_host_rate: float = 0.5, **columns) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    stats = cut(statistics(docs, **columns).withColumn("base_failed", failed))
    hosts = host_verdicts(stats, max_host_rate).withColumnRenamed("host", "of_host")
    joined = stats.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.select(*[c for c in stats.columns if c != "host"], (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
