"""Document fingerprints by winnowing.

Every run of `k` code points of a text is hashed by a rolling polynomial; of every `window` consecutive hashes the
least one is chosen, of equal ones the rightmost. Any two texts that share `window + k - 1` consecutive code points
share a chosen hash. Positions are kept. A fingerprint is written as ten hex digits for each chosen hash, in the
order of the text: eight of the hash, two of the distance from the position chosen before (from 0 for the first).

Defined cases. Null is the empty text, whose fingerprint is empty. A text of fewer than `k` code points is one run;
one of fewer than `window` runs is one window. Likeness is the Jaccard coefficient of the sets of chosen hashes;
two empty fingerprints are alike (1.0). The next document follows in the order of doc_id, then of the text's
digest and length; null ids come first; after the last comes the first, and a single document follows itself.
Repeated rows are documents of their own.

Ids may be of any type that can be ordered.

Plan. Blocks of consecutive ids are cut at quantiles of the ids (of a sample of them, if they are no numbers), as many
as the shuffle has partitions and at least one for each BLOCK_BYTES of text. A text is moved once, to its block, which
is a partition of its own; the first document of each block goes also to the block before. Inside a partition rows are
sorted and read as a stream, so a task holds two documents. What the driver gets is a list of block starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of
from .shingles import mix

K, WINDOW = 16, 32
#: Text of a block, on average at most; ids of which the cuts are taken, for each block, where ids are no numbers.
BLOCK_BYTES, SAMPLED = 64 << 20, 50
_BASE = np.uint64(0x100000001B3 * 2 + 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all runs of k code points (of the whole, if it is shorter)."""
    n = len(points)
    if not n:
        return np.empty(0, np.uint32)
    k = min(k, n)
    with np.errstate(over="ignore"):
        x = mix(points.astype(np.uint64) + np.uint64(1))
        # The run of length 2m is two runs of length m; k is put together from its bits.
        out, size, power, width = np.zeros(n - k + 1, np.uint64), 0, _BASE, 1
        while True:
            if k & width:
                out = out * power + x[size : size + len(out)]
                size += width
            if width * 2 > k:
                break
            x = x[:-width] * power + x[width:]
            power, width = power * power, width * 2
        return (mix(out + np.uint64(k)) >> np.uint64(32)).astype(np.uint32)


def chosen(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window, rightmost of equals, each once."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    w = min(window, n)
    # Least of 2m = least of two m; the right one wins a tie.
    best = np.arange(n)
    width = 1
    while width * 2 <= w:
        left, right = best[:-width], best[width:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        width *= 2
    if width < w:
        left, right = best[: n - w + 1], best[w - width :]
        best = np.where(hashes[right] <= hashes[left], right, left)
    return best[np.r_[True, best[1:] != best[:-1]]]


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions), in the order of the text."""
    return print_points(code_points(text), k, window)


def print_points(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    h = gram_hashes(points, k)
    at = chosen(h, window)
    return h[at], at


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    out = np.empty((len(hashes), 5), np.uint8)
    out[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = np.diff(positions, prepend=0)
    return out.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next document."""
    half = len(points) // 2
    return np.concatenate([points[: len(points) - half], following[:half]])


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, with `fingerprint` hashes and `positions` as arrays: no shuffle."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("hashes array<bigint>, positions array<bigint>")
    def run(texts):
        import pandas as pd

        return pd.DataFrame([tuple(x.astype(np.int64).tolist() for x in fingerprint(t, k, window)) for t in texts], columns=["hashes", "positions"])

    return docs.withColumn("fingerprint", run(text_of(text_col)))


def _stream(k: int, window: int, schema: T.StructType):
    names = schema.names

    def one(doc: tuple, points: np.ndarray, own: tuple, following: np.ndarray, after: tuple) -> tuple:
        new = edited(points, following)
        other = print_points(new, k, window)
        raw = new.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        return (doc, len(points), hashlib.sha256(raw).hexdigest(), written(*own), written(*other), likeness(own[0], other[0]), likeness(own[0], after[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (block, doc_id, points, print), which waits for the next of its block
        for batch in batches:
            out = []
            for block, ahead, doc, text in zip(*(batch.column(c).to_pylist() for c in ("block", "ahead", "doc_id", "text"))):
                points = code_points(text)
                own = print_points(points, k, window)
                if held is not None and held[0] == block:
                    out.append(one(held[1], held[2], held[3], points, own))
                held = None if ahead else (block, doc, points, own)
            if out:
                columns = list(zip(*out))
                types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    cuts = _cuts(rows.select("doc_id").where("doc_id IS NOT NULL"), blocks)
    # 1 + the number of cuts up to the id, by a binary search in a constant array; null ids are the first block.
    block = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_bucket(F.col("doc_id"), cuts))
    placed = rows.select(block.alias("block"), "doc_id", "text")
    order = F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    starts = placed.groupBy("block").agg(F.min(order).alias("least")).select("block", "least.id", "least.digest").collect()
    starts.sort(key=lambda r: r["block"])
    before = {r["block"]: starts[i - 1]["block"] for i, r in enumerate(starts)}
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)])
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        schema = schema.add(name, kind)
    first = spark.createDataFrame(
        [(r["block"], before[r["block"]], r["id"], r["digest"]) for r in starts],
        T.StructType([T.StructField("s_block", T.IntegerType()), T.StructField("s_before", T.IntegerType()), T.StructField("s_id", docs.schema[id_col].dataType), T.StructField("s_digest", T.StringType())]),
    )
    # One row for each block: at most as many as the shuffle has partitions.
    is_first = (F.col("block") == F.col("s_block")) & F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.md5("text") == F.col("s_digest"))
    joined = placed.join(F.broadcast(first), is_first, "left")
    places = F.array_compact(F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("ahead")), F.when(F.col("s_before").isNotNull(), F.struct(F.col("s_before").alias("block"), F.lit(True).alias("ahead")))))
    spread = joined.select(F.explode(places).alias("p"), "doc_id", "text").select("p.block", "p.ahead", "doc_id", "text")
    parted = spread.repartitionById(len(cuts) + 2, F.col("block")).sortWithinPartitions("block", "ahead", F.asc_nulls_first("doc_id"), F.md5("text"))
    return parted.mapInArrow(_stream(k, window, schema), schema)


def _cuts(ids: DataFrame, blocks: int) -> list:
    """Ids that part all of them into about `blocks` equal runs; where they lie has no effect on any result."""
    if blocks < 2:
        return []
    if isinstance(ids.schema["doc_id"].dataType, T.NumericType):
        return sorted(set(ids.select(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10 * blocks).alias("q")).first()["q"] or []))
    some = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLED * blocks)
    # Ordered by Spark, whose order of text is that of its bytes.
    found = [r["doc_id"] for r in some.orderBy("doc_id").collect()]
    return list(dict.fromkeys(found[len(found) * i // blocks] for i in range(1, blocks))) if found else []


def _bucket(c: Column, cuts: list) -> Column:
    """1 + the number of cuts that are at most c, by binary search in a constant array."""
    if not cuts:
        return F.lit(1)
    values = F.array(*map(F.lit, cuts))
    middle = lambda a: ((a["lo"] + a["hi"]) / 2).cast("int")

    def step(a: Column, _: Column) -> Column:
        above = F.get(values, middle(a)) <= c
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & above, middle(a) + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~above, middle(a)).otherwise(a["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, step, lambda a: a["lo"]) + 1
