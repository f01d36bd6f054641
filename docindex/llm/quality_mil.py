"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Every passage of 64 words of the whole text is encoded from its characters and words (their lengths, repeats, and
signed counts of hashed words); a gated attention, learned
from labels of documents alone, weighs the passages, and the weighted representation is scored.

Defined cases. Null and empty texts have one passage of zeros and are scored like others. Documents without an id
are scored and not learned from. Repeated rows are scored alike; of a document's several labels all are learned.
Without labels all scores are 0.5, with labels of one class they are that class's smoothed share. An empty table
gives an empty table. Only the id and the text are read.

Plan. Training takes a bounded sample (labelled.MAX_DOCS documents of MAX_PASSAGES passages), encoded on the
executors; the driver gets WIDTH numbers a passage of it and fits some hundred weights. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, text_of
from .labelled import MAX_DOCS, held_out, sample
from .shingles import WordHashes, mix

PASSAGE = 64
HIDDEN, GATES = 16, 8


def _classes() -> np.ndarray:
    kind = np.full(256, 10, np.uint8)  # brackets, quotes and the like
    for chars, k in (
        ("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\r\x0b\x0c", 3), ("\n", 4),
        (".", 5), (",;:", 6), ("!?", 7), ("|", 8), ("#*$%&<>=@/\\~^_+-{}", 9),
    ):
        for c in chars:
            kind[ord(c)] = k
    kind[128:] = 11
    return kind


_KIND, _KINDS = _classes(), 12
#: Signed buckets that the words of a passage are hashed to.
HASHED = 16
WIDTH = _KINDS + 7 + HASHED
#: Passages of the sample that the driver gets at most; documents are taken whole, in the order of the digest of their ids.
MAX_PASSAGES = 200_000


def encode(text: str, cache: WordHashes) -> np.ndarray:
    """One row of WIDTH numbers for each passage."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    points = np.frombuffer(raw, np.uint8)
    kind = _KIND[points]
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    starts = ~blank & np.r_[True, blank[:-1]]
    of_byte = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE
    passages = (n - 1) // PASSAGE + 1
    counts = np.bincount(of_byte * _KINDS + kind, minlength=passages * _KINDS).reshape(passages, _KINDS)
    of_word = np.arange(n) // PASSAGE
    size = np.bincount(of_word, minlength=passages)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    mixed = mix(h)
    length = np.fromiter(map(len, words), np.float64, n)
    per = lambda x: np.bincount(of_word, weights=x, minlength=passages) / size
    mean = per(length)
    distinct = np.unique(mixed + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
    pairs = mixed[:-1] ^ h[1:]
    seen = np.ones(n)
    seen[0] = 0
    seen[np.unique(pairs, return_index=True)[1] + 1] = 0
    same = np.r_[0.0, h[1:] == h[:-1]]
    out = np.empty((passages, WIDTH), np.float32)
    out[:, :_KINDS] = counts / counts.sum(axis=1, keepdims=True)
    signs = np.where(mixed >> np.uint64(63), 1.0, -1.0)
    bucket = (mixed & np.uint64(HASHED - 1)).astype(np.int64)
    out[:, _KINDS + 7 :] = np.bincount(of_word * HASHED + bucket, weights=signs, minlength=passages * HASHED).reshape(passages, HASHED) / np.sqrt(size)[:, None]
    out[:, _KINDS : _KINDS + 7] = np.stack(
        [mean / 10, np.sqrt(np.maximum(per(length**2) - mean**2, 0)) / 10, np.bincount(of_word[distinct], minlength=passages) / size, per(seen), per(same), per(length <= 3), np.log1p(size) / 4], axis=1
    )
    return out


class AttentionModel:
    """Weights, in plain arrays; `fit` is full-batch Adam, so it doesn't depend on the order of Spark's rows."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.shift, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"E": draw(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES), "c": draw(HIDDEN), "b": np.zeros(1)}

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z = np.clip((x - self.shift) / self.scale, -6, 6)
        h = np.tanh(z @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        sizes = np.diff(np.r_[starts, len(x)])
        top = np.repeat(np.maximum.reduceat(a, starts), sizes)
        a = np.exp(a - top)
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        r = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(r @ p["c"] + p["b"], -30, 30)))
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "r": r, "y": y, "sizes": sizes}

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self._forward(x, starts)["y"]

    def attention(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self._forward(x, starts)["a"]

    def _gradient(self, f: dict[str, np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        p, m = self.p, len(labels)
        dy = (f["y"] - labels) / m
        dr = np.repeat(dy[:, None] * p["c"], f["sizes"], axis=0)
        da = (dr * f["h"]).sum(axis=1)
        starts = np.r_[0, np.cumsum(f["sizes"])[:-1]]
        mean = np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"])
        ds = f["a"] * (da - mean)  # before the softmax
        dt, dg = ds[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dr + dt @ p["V"].T + dg @ p["U"].T
        dz = dh * (1 - f["h"] ** 2)
        return {"E": f["z"].T @ dz, "e": dz.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["s"]).T @ ds, "c": f["r"].T @ dy, "b": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int = 120, rate: float = 0.04, decay: float = 1e-4) -> AttentionModel:
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            g = self._gradient(self._forward(x, starts), labels)
            for k, v in self.p.items():
                d = g[k] + decay * v
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                self.p[k] = v - rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
        return self


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        rows = [encode(t.as_py(), cache) for t in batch.column("text")]
        columns = [batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(map(len, rows), pa.int32()), batch.column("label")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "x", "n", "label"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES, **columns) -> AttentionModel | float:
    """The fitted model; a constant score where the labels don't have both classes."""
    small_batches(docs.sparkSession)
    rows = sample(docs, labels, label, max_docs, **columns)
    shape = T.StructType([rows.schema["doc_id"]]).add("x", "binary").add("n", "integer").add("label", "integer")
    encoded = cut(rows.mapInArrow(_encoded, shape)).withColumn("digest", F.xxhash64("doc_id", "x"))
    # At most `max_docs` rows, or as many as their ids have: the window is over a bounded table.
    before = F.sum("n").over(Window.orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
    kept = encoded.select("digest", "n").withColumn("before", before).where(F.col("before") <= max_passages).select("digest").distinct()
    got = sorted(encoded.join(F.broadcast(kept), "digest", "left_semi").collect(), key=lambda r: (r["doc_id"], r["label"], bytes(r["x"])))
    y = np.array([r["label"] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 2))
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    return AttentionModel().fit(np.concatenate(parts).astype(np.float64), starts, y)


def _scores(model: AttentionModel | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            if not len(batch):
                continue
            if isinstance(model, float):
                y = np.full(len(batch), model)
            else:
                parts = [encode(t.as_py(), cache) for t in batch.column("text")]
                y = model.score(np.concatenate(parts).astype(np.float64), np.cumsum([0, *map(len, parts[:-1])]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(y)], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`."""
    model = fit(docs, labels, label, max_docs, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    scored = rows.mapInArrow(_scores(model), T.StructType([rows.schema["doc_id"]]).add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
