"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicon entries (a whole word, or the first letters of a word), counts of their findings, and patterns:
words in capitals, drawn-out letters, masked letters, runs of exclamation marks, and findings after a word of address.
Entries are mined from the labelled sample, beside a short lexicon of insults. Words are what stands between blanks (any
white space) and marks, of any length. Each voter fires on a document or abstains. The label model has, for a hidden class, the rate at
which each voter fires in either class; it estimates them by expectation maximisation over labelled and unlabelled
documents. Labels are one more voter of unknown accuracy, which says nothing of unlabelled documents. What voters still
share when the class is known are their correlations; a voter counts for less the more others repeat it. A logistic
regression is then trained on the posterior labels of both, and it alone scores documents.

Defined cases. Null and empty texts have no findings and are scored like others. Documents without an id are scored
and not learned from. Without labels the given lexicon votes alone; repeated rows are scored alike. An empty table
gives an empty table. Only the id and the text are read.

Plan. The samples are bounded (labelled.MAX_DOCS labelled documents, and UNLABELLED ones); words of the labelled are
counted on the cluster, and the driver gets at most `max_entries` entries, then one row of votes for each document. Scoring is one pass over the
texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, text_of
from .labelled import MAX_DOCS, held_out, sample, without_label

LEXICON = tuple("idiot moron stupid loser scum trash pathetic worthless disgusting clown".split())
PREFIXES = (4, 5, 6, 7, 8)
MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_/\\=+~^@`"
#: Documents without a label that the label model reads, chosen by a digest of their ids.
UNLABELLED = 2000
#: Words of address, and how far behind one a finding counts as addressed.
ADDRESS, REACH = frozenset("you your you're u du dein deine tu ton ta vous eres usted tú".split()), 3
SHOUTED, DRAWN, MASKED = 1, 2, 4
PATTERNS = 5
_PIECES = re.compile(r"[^\s" + re.escape(MARKS) + "]+")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_MASKED = re.compile(r"[^\W\d_][*@#$!]+[^\W\d_]")


def entries_of(token: str) -> list[str]:
    """The lexicon entries of what stands between blanks: each word in it, and its first letters (marked by ^)."""
    found = []
    for w in _PIECES.findall(token.lower()):
        found += [w, *("^" + w[:k] for k in PREFIXES if len(w) > k)]
    return found


def kinds_of(token: str) -> int:
    """Which patterns of a single word it has."""
    letters = token.strip(MARKS)
    return SHOUTED * (len(letters) > 2 and letters.isupper()) + DRAWN * bool(_DRAWN.search(letters)) + MASKED * bool(_MASKED.search(letters))


def tokens(text: str) -> list[bytes]:
    """What stands between ASCII blanks; the same where entries are mined and where they are found."""
    return text.encode("utf-8", "replace").split()


class Finder(dict):
    """token -> (indices of the voters' entries in it, its patterns), None for neither."""

    def __init__(self, entries: list[str], limit: int = 200_000, longest: int = 200):
        self.index, self.limit, self.longest = {e: i for i, e in enumerate(entries)}, limit, longest

    def __missing__(self, token: bytes) -> tuple[tuple[int, ...], int] | None:
        text = token.decode("utf-8", "replace")
        hits = tuple(i for i in map(self.index.get, entries_of(text)) if i is not None)
        kinds = kinds_of(text)
        found = (hits, kinds) if hits or kinds else None
        if len(token) <= self.longest:  # long ones are looked up anew, so that the table's memory is bounded
            if len(self) >= self.limit:
                self.clear()
            self[token] = found
        return found


def votes(text: str, finder: Finder) -> np.ndarray:
    """How often each entry is found; the patterns' counts; the number of words with a finding and of all words."""
    words = tokens(text)
    out = np.zeros(len(finder.index) + PATTERNS + 2, np.float32)
    patterns = out[len(finder.index) :]
    for at, found in enumerate(map(finder.__getitem__, words)):
        if found is None:
            continue
        hits, kinds = found
        for i in hits:
            out[i] += 1
        if hits:
            out[-2] += 1
            patterns[3] += any(w.decode("utf-8", "replace").lower() in ADDRESS for w in words[max(0, at - REACH) : at])
        if kinds:
            patterns[:3] += (kinds & SHOUTED > 0, kinds & DRAWN > 0, kinds & MASKED > 0)
    patterns[4] = text.count("!!")
    out[-1] = len(words)
    return out


def features(v: np.ndarray) -> np.ndarray:
    """Rows of `votes` as the classifier's inputs: fired, often fired, and how dense findings are."""
    n, patterns = v[:, : -2 - PATTERNS], v[:, -2 - PATTERNS : -2]
    hits, words = v[:, -2:-1], np.maximum(v[:, -1:], 1)
    kinds = (n > 0).sum(axis=1, keepdims=True)
    return np.concatenate([n > 0, n > 1, patterns > 0, np.log1p(hits), np.log1p(kinds), np.minimum(100 * hits / words, 10), hits > 0, hits > 2], axis=1).astype(np.float64)


def fired(v: np.ndarray) -> np.ndarray:
    """Rows of `votes` as the voters' votes."""
    n, patterns = v[:, : -2 - PATTERNS], v[:, -2 - PATTERNS : -2]
    hits, words = v[:, -2:-1], np.maximum(v[:, -1:], 1)
    return np.concatenate([n > 0, patterns > 0, patterns > 2, hits > 0, hits > 1, hits > 3, hits / words > 0.004, hits / words > 0.02], axis=1)


class LabelModel:
    """P(class | votes), from the rates of firing and the correlations that remain.

    The last voter is the annotator, who has seen some documents only: it is taken to be right in at least
    `ANNOTATOR` of either class, without which the classes would be free to change their meaning.
    """

    ANNOTATOR = (0.9, 0.99)

    def fit(self, fires: np.ndarray, start: np.ndarray, seen: np.ndarray | None = None, rounds: int = 15) -> LabelModel:
        """`start`: the classes to begin with, of the documents that the annotator has seen."""
        seen = np.ones(len(fires), bool) if seen is None else seen
        x, q = fires.astype(np.float64), start.astype(np.float64)
        known = seen.astype(np.float64)
        for round_ in range(rounds):
            # The first round goes by the documents that have been seen.
            w = known if not round_ else np.ones(len(x))
            yes, no = w * q, w * (1 - q)
            self.prior = np.clip(yes.sum() / w.sum(), 1e-3, 1 - 1e-3)
            self.on = (x.T @ yes + 0.5) / (yes.sum() + 1)
            self.off = (x.T @ no + 0.5) / (no.sum() + 1)
            self.on[-1] = max((x[:, -1] @ (known * q) + 0.5) / (known @ q + 1), self.ANNOTATOR[0])
            self.off[-1] = min((x[:, -1] @ (known * (1 - q)) + 0.5) / (known @ (1 - q) + 1), 1 - self.ANNOTATOR[1])
            rest = (x - q[:, None] * self.on - (1 - q)[:, None] * self.off) * w[:, None]
            rest[:, -1] *= known
            spread = np.sqrt((rest**2).sum(axis=0)) + 1e-9
            self.correlation = (rest.T @ rest) / np.outer(spread, spread)
            self.weight = 1 / np.maximum(np.where(np.abs(self.correlation) > 0.1, np.abs(self.correlation), 0).sum(axis=0), 1)
            self.weight[-1] = 1
            q = self.posterior(fires, seen)
        return self

    def posterior(self, fires: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        yes = np.log(self.on / self.off) * self.weight
        no = np.log((1 - self.on) / (1 - self.off)) * self.weight
        s = np.log(self.prior / (1 - self.prior)) + fires @ yes + (~fires) @ no
        if seen is not None:
            s = s - np.where(seen, 0, np.where(fires[:, -1], yes[-1], no[-1]))
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


class Linear:
    """Logistic regression on soft labels, by Newton's method."""

    def fit(self, x: np.ndarray, q: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> Linear:
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        self.w = np.zeros(x.shape[1])
        keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (p - q) + keep * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, label = [], []
        for text, y in zip(batch.column("text"), batch.column("label")):
            own = {e for w in set(tokens(text.as_py())) for e in entries_of(w.decode("utf-8", "replace"))}
            found += own
            label += [y.as_py()] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(label, pa.int32())], ["entry", "label"])


def mine(labelled: DataFrame, max_entries: int = 200, least: int = 4) -> list[str]:
    """Entries whose documents are toxic far more often than others: at most `max_entries`, best first.

    Of the entries taken, at most one is to be expected by chance: the exponent of Chernoff's bound for as many toxic
    documents at the sample's own rate is at least the logarithm of the number of entries.
    """
    counts = cut(labelled.mapInArrow(_words, "entry string, label int").groupBy("entry").agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n")))
    whole = labelled.agg(F.avg("label").alias("rate")).first()["rate"]
    if not whole or whole == 1:
        return []
    rate = (F.col("yes") + 0.1) / (F.col("n") + 1)
    share = F.col("yes") / F.col("n")
    exponent = F.col("yes") * F.log(share / whole) + F.when(F.col("yes") < F.col("n"), (F.col("n") - F.col("yes")) * F.log((1 - share) / (1 - whole))).otherwise(0.0)
    good = counts.where((F.col("yes") >= least) & (rate >= 0.7) & (exponent >= math.log(max(counts.count(), 1))))
    # A lower bound of the rate, times the documents it stands for.
    gain = F.col("yes") * (rate - F.sqrt(rate * (1 - rate) / (F.col("n") + 1)) - 0.4)
    best = good.orderBy(gain.desc(), "entry").limit(5 * max_entries).select("entry", "yes", "n").collect()
    return pruned([tuple(r) for r in best])[:max_entries]


def pruned(best: list[tuple[str, int, int]]) -> list[str]:
    """Without entries that stand for the same documents as a longer or shorter form before them."""
    kept: dict[tuple[int, int], list[str]] = {}
    out = []
    for entry, yes, n in best:
        stem, same = entry.strip("^"), kept.setdefault((yes, n), [])
        if not any(stem.startswith(s) or s.startswith(stem) for s in same):
            same.append(stem)
            out.append(entry)
    return out


def _votes(entries: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(entries)
        for batch in batches:
            rows = [votes(t.as_py(), finder).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary()), batch.column("label")], ["doc_id", "v", "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = MAX_DOCS, unlabelled: int = UNLABELLED, **columns) -> tuple[list[str], Linear]:
    """The entries and the classifier."""
    small_batches(docs.sparkSession)
    labelled = cut(sample(docs, labels, label, max_docs, **columns))
    entries = list(dict.fromkeys([*LEXICON, *mine(labelled)]))
    shape = T.StructType([labelled.schema["doc_id"]]).add("v", "binary").add("label", "integer")
    both = labelled.unionByName(without_label(docs, labels, unlabelled, **columns)) if unlabelled else labelled
    key = lambda r: (r["label"] is None, r["doc_id"], r["label"] or 0, bytes(r["v"]))
    got = sorted(both.mapInArrow(_votes(entries), shape).collect(), key=key)
    return entries, train(entries, [np.frombuffer(r["v"], np.float32) for r in got], [r["label"] for r in got])


def train(entries: list[str], rows: list[np.ndarray], labels: list[int | None]) -> Linear:
    known = [y for y in labels if y is not None]
    if not known or min(known) == max(known):
        # Nothing to learn the voters' rates from: the given lexicon decides, as if it were right.
        none, one = np.zeros(len(entries) + PATTERNS + 2, np.float32), np.eye(len(entries) + PATTERNS + 2, dtype=np.float32)[: len(entries)]
        one[:, -2:] = 1
        v = np.stack([*[none] * 20, *one])
        return Linear().fit(features(v), np.r_[np.zeros(20), np.ones(len(one))])
    v, y, seen = np.stack(rows), np.array([bool(x) for x in labels]), np.array([x is not None for x in labels])
    with_label = np.concatenate([fired(v), y[:, None]], axis=1)
    model = LabelModel().fit(with_label, np.where(seen, np.where(y, 0.9, 0.1), 0.0), seen)
    return Linear().fit(features(v), model.posterior(with_label, seen))


def _scores(entries: list[str], model: Linear):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(entries)
        for batch in batches:
            if len(batch):
                v = np.stack([votes(t.as_py(), finder) for t in batch.column("text")])
                rest = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(model.score(features(v)))], [*rest, "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`."""
    entries, model = fit(docs, labels, label, max_docs, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    scored = rows.mapInArrow(_scores(entries, model), T.StructType([rows.schema["doc_id"]]).add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with their columns."""
    entries, model = fit(docs, labels, label, max_docs, id_col=id_col, text_col=text_col)
    finder: list[Finder] = []

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        if not finder:
            finder.append(Finder(entries))
        v = [votes(t, finder[0]) for t in texts]
        return pd.Series(model.score(features(np.stack(v))) if v else [], dtype=float)

    return docs.where(score(text_of(text_col)) < threshold)
