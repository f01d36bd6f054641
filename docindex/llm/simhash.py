"""SimHash near-dedup by random bit-sampling: several tables group sampled coordinates of a fingerprint.

Similarity is the Jaccard coefficient of the sets of five-word shingles; two texts are linked at `similarity` (0.8)
or more, and classes are the connected components of the links. Equal texts are one class whatever they are.

Method. A fingerprint has 512 coordinates, each the sign of a sum over the distinct shingles. Each of at least `tables`
tables (more, where a larger input needs more bits: a pair at the threshold has a chance of MISS to meet in none) orders all distinct texts by 64 coordinates of its own, followed by the whole fingerprint. A bucket is a run
that agrees on the first coordinates; a run of over `cap` texts takes additional bits until no bucket is larger.
Texts of one bucket are compared by the distance of their fingerprints: far ones are no candidates, very near ones
are linked, and the pairs between are decided by an exact comparison of their shingles. Texts of equal fingerprints
that even all bits don't part are linked to one of them, which stands for them.

Oversized buckets. Additional bits part pairs. Each text therefore has a chance that a partner at the threshold has
met it in none of its buckets, from the bits that these really took. Texts for which it is above MISS go to
further tables among themselves, until none is left; where that takes longer than comparing all their fingerprints,
those are compared, in blocks. A pair of which one text is done was met with that text's chance.

Defined cases. Null is the empty text; texts without words are linked only with equal texts. A text of fewer than
five words is one shingle. The class id is the least doc_id of the class (null where none has an id). Repeated rows
are equal texts. An empty table gives an empty table; other columns are not read by `classes`.

Plan. Texts are read once for fingerprints and once for the pairs that need the exact comparison. Equal texts are
collapsed by a partial aggregate before tables are made, so a group of copies is one row. Tables are
range-partitioned on the sampled bits and the fingerprint: a hot prefix, or key, is spread over partitions, and a task
holds `cap` rows at once, or two blocks of texts of which all pairs are compared. A bucket at the edge of a partition
may have been cut in two there; its texts count as parted by SPREAD bits, which calls for further tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, release, small_batches, text_of
from .components import components
from .shingles import WordHashes, mix, shingles

WORDS = 8
BITS = 64 * WORDS
_STEPS = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
#: From so many shingles on, a distance is a good estimate of the similarity.
MANY = 64
#: How often a pair at the threshold itself may meet in no table, whatever the size of the input.
MISS = 0.01
#: Tables that are shuffled at once; the next group comes when the shuffle of the last one is gone.
GROUP = 12
#: A bucket at the edge of a partition counts as one of so many bits more.
SPREAD = 8
#: What a bucket of more bits counts for: the coordinates that split a hot run are also those in which near copies differ.
DEEP = 0.5
#: Texts of a block where all pairs are compared; up to so many texts for each further table, that is the shorter way.
BLOCK, PER_TABLE = 2048, 1024


def agreement(similarity: float) -> float:
    """The chance that a coordinate agrees in two sets of that similarity, at its least, which is for equal sizes."""
    return 1 - math.acos(min(2 * similarity / (1 + similarity), 1)) / math.pi


def tables_for(similarity: float, bits: int) -> int:
    """Tables after which a pair at the threshold has met in a bucket of `bits` coordinates, but for MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-min(agreement(similarity) ** bits, 1 - MISS)))


def coordinates(tables: int, first: int = 0) -> np.ndarray:
    """The 64 sampled coordinates of each table from `first` on."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(BITS)[:64] for _ in range(first + tables)])[first:]


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of distinct shingles, one byte for each coordinate; a tie is settled by the coordinate."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255 * 8):
        block = mix(hashes[at : at + 255 * 8, None] + _STEPS)
        bits = np.unpackbits(block.view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return (2 * total + np.arange(BITS) % 2 > len(hashes)).astype(np.uint8)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        texts = batch.column("text")
        n, bits = np.zeros(len(texts), np.int32), np.zeros((len(texts), BITS), np.uint8)
        for i, text in enumerate(texts):
            h = shingles(text.as_py(), cache)
            n[i] = len(h)
            if len(h):
                bits[i] = bits_of(h)
        prints = pa.array(list(map(bytes, np.packbits(bits, axis=1))), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(n), prints], ["doc_id", "tid", "n", "print"])
    del cache
    release()


def _tables(tables: int, first: int = 0):
    """A row for each table of each fingerprint, with the 64 coordinates that the table samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = coordinates(tables, first).ravel()
        for batch in batches:
            m = len(batch)
            if not m:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(m, BITS // 8), axis=1)
            keys = np.ascontiguousarray(np.packbits(bits[:, at].reshape(m, tables, 64), axis=2)).view(">i8").astype(np.int64)
            rows = pa.array(np.repeat(np.arange(m), tables))
            columns = [pa.array(np.tile(np.arange(tables, dtype=np.int32), m)), pa.array(keys.ravel()), *[batch.column(c).take(rows) for c in ("tid", "n", "print")]]
            yield pa.RecordBatch.from_arrays(columns, ["t", "key", "tid", "n", "print"])

    return run


def estimate(distance: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Jaccard coefficient that a distance between sets of a and b shingles stands for."""
    common = np.cos(np.pi * distance / BITS) * np.sqrt(a * b)
    return common / np.maximum(a + b - common, 1e-9)


#: Deviations by which the distance of a pair at the threshold may be off; a tie of few shingles adds to it.
MANY_OFF, FEW_OFF = 4, 7


def farthest(similarity: float, a: np.ndarray, b: np.ndarray, off) -> np.ndarray:
    """The distance that sets of a and b shingles have at the threshold, and `off` deviations more; most for a = b."""
    apart = np.arccos(np.minimum(similarity / (1 + similarity) * (a + b) / np.sqrt(np.maximum(a * b, 1)), 1)) / np.pi
    return BITS * apart + off * np.sqrt(BITS * apart * (1 - apart))


def _shared_bits(rows: np.ndarray, with_row: np.ndarray | None = None) -> np.ndarray:
    """For each row of big 64-bit words: leading bits that it shares with the first, or with another row."""
    x = rows ^ (rows[0] if with_row is None else with_row)
    word = (x != 0).argmax(axis=1)
    first = x[np.arange(len(x)), word]
    high = (first >> np.uint64(32)).astype(np.float64)
    low = (first & np.uint64(0xFFFFFFFF)).astype(np.float64)
    lead = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])
    return np.where(first == 0, 64 * x.shape[1], 64 * word + lead)


def bucket_links(prints: np.ndarray, n: np.ndarray, similarity: float, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of one bucket, or of some pairs. Sure pairs come as stars, unsure ones only between different stars."""
    i, j = np.triu_indices(len(n), 1) if pairs is None else pairs
    d = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64)
    near = d <= farthest(similarity, np.ones(1), np.ones(1), FEW_OFF)[0]
    i, j, d = i[near], j[near], d[near]
    a, b = n[i].astype(np.float64), n[j].astype(np.float64)
    s = estimate(d, a, b)
    many = np.minimum(a, b) >= MANY
    sure = many & (s >= similarity + 0.6 * (1 - similarity))
    maybe = ~sure & (d <= farthest(similarity, a, b, np.where(many, MANY_OFF, FEW_OFF))) & (np.minimum(a, b) >= similarity * np.maximum(a, b))
    label = np.arange(len(n))
    if sure.any():
        p, q = i[sure], j[sure]
        while True:
            new = label.copy()
            np.minimum.at(new, p, label[q])
            np.minimum.at(new, q, label[p])
            new = new[new]
            if (new == label).all():
                break
            label = new
    stars = np.flatnonzero(label != np.arange(len(n)))
    maybe &= label[i] != label[j]
    return np.r_[label[stars], i[maybe]], np.r_[stars, j[maybe]], np.r_[np.ones(len(stars), bool), np.zeros(maybe.sum(), bool)]


def missed(similarity: float, bits):
    """Logarithm of the chance that a pair at the threshold doesn't meet in a bucket of so many bits."""
    return np.log1p(-np.minimum(agreement(similarity) ** np.asarray(bits, float), 1 - MISS))


def _links(similarity: float, base_bits: int, cap: int, lost: bool = False):
    """(a, b, sure); if wanted, also (a, null, null, lost) for texts whose buckets took more bits: what `missed` is short of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, sizes, ids = np.empty(0, np.int32), np.empty((0, 1 + WORDS), np.uint64), np.empty(0, np.int32), np.empty(0, object)
        found: list[tuple] = []
        before: tuple[int, np.ndarray] | None = None  # the row before the first; unknown where a partition begins

        def emit() -> pa.RecordBatch:
            a, b, sure, short = zip(*found) if found else ((), (), (), ())
            found.clear()
            columns = [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sure, pa.bool_()), pa.array(short, pa.float64())]
            return pa.RecordBatch.from_arrays(columns[: 3 + lost], ["a", "b", "sure", "lost"][: 3 + lost])

        def shares(m: int, other: tuple[int, np.ndarray] | None) -> np.ndarray:
            """Leading bits that each of the first m rows has in common with a row outside their bucket, at most."""
            if other is None:
                return np.full(m, base_bits + SPREAD - 1)
            return _shared_bits(words[:m], other[1]) if other[0] == table[0] else np.full(m, -1)

        def note(m: int) -> None:
            after = (table[m], words[m]) if m < len(ids) else None
            depth = np.maximum(shares(m, before), shares(m, after)) + 1
            deep = np.flatnonzero(depth > base_bits)
            short = DEEP * missed(similarity, depth[deep]) - missed(similarity, base_bits)
            found.extend((ids[i], None, None, float(x)) for i, x in zip(deep, short))

        def bucket(m: int) -> None:
            if m > 1:
                for i, j, sure in zip(*bucket_links(words[:m, 1:], sizes[:m], similarity)):
                    a, b = ids[i], ids[j]
                    found.append((min(a, b), max(a, b), bool(sure), None))

        def advance(last: bool) -> None:
            nonlocal table, words, sizes, ids, before
            while len(ids) > cap or last and len(ids):
                shared = _shared_bits(words[: cap + 1])
                shared[table[: cap + 1] != table[0]] = -1
                bits = max(base_bits, shared[cap] + 1) if len(ids) > cap else base_bits
                m = int((shared >= bits).sum())
                step = m
                if not m:  # equal in all bits: link these, and keep the first for the rest
                    m, step = cap, cap - 1
                bucket(m)
                first = 0 if step == m else 1
                if lost and first:
                    found.extend((x, None, None, STANDS) for x in ids[1:cap])
                elif lost:
                    note(m)
                    before = table[m - 1], words[m - 1].copy()
                keep = np.r_[np.zeros(first, np.int64), np.arange(step + first, len(ids))]
                table, words, sizes, ids = table[keep], words[keep], sizes[keep], ids[keep]

        for batch in batches:
            k = len(batch)
            if not k:
                continue
            prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), ">u8").reshape(k, WORDS).astype(np.uint64)
            key = batch.column("key").to_numpy().view(np.uint64)
            table = np.r_[table, batch.column("t").to_numpy()]
            words = np.concatenate([words, np.concatenate([key[:, None], prints], axis=1)])
            sizes = np.r_[sizes, batch.column("n").to_numpy()]
            ids = np.r_[ids, np.array(batch.column("tid").to_pylist(), object)]
            advance(False)
            if found:
                yield emit()
        advance(True)
        yield emit()

    return run


#: Lost by a text for which another one of the same fingerprint stands: it is done.
STANDS = -1e9


def _block_links(similarity: float, rows: int = 256):
    """(a, b, sure) of all pairs between the two blocks of a group, or within its only one."""

    def run(part: pa.Table) -> pa.Table:
        prints = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint64).reshape(len(part), WORDS)
        n, ids = part.column("n").to_numpy(), np.array(part.column("tid").to_pylist(), object)
        right = part.column("right").to_numpy(zero_copy_only=False).astype(bool)
        left, other = np.flatnonzero(~right), np.flatnonzero(right)
        one = part.column("o")[0].as_py() == 0
        out: list[tuple] = []
        for at in range(0, len(left), rows):
            i, j = (x.ravel() for x in np.meshgrid(left[at : at + rows], left if one else other, indexing="ij"))
            pairs = (i[i < j], j[i < j]) if one else (i, j)
            out += ((min(ids[x], ids[y]), max(ids[x], ids[y]), bool(z)) for x, y, z in zip(*bucket_links(prints, n, similarity, pairs)))
        a, b, sure = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "sure": pa.array(sure, pa.bool_())})

    return run


def _all_pairs(left: DataFrame, count: int, similarity: float) -> list[DataFrame]:
    """(a, b, sure) of all pairs of `left`: block k meets block k + o, for a group of offsets o at once."""
    blocks = max(1, -(-count // BLOCK))
    k, out, last = F.pmod(F.xxhash64("tid"), F.lit(blocks)), [], blocks // 2
    for at in range(0, last + 1, GROUP):
        offsets = F.explode(F.sequence(F.lit(at), F.lit(min(at + GROUP - 1, last))))
        rows = left.select("tid", "n", "print", k.alias("k"), offsets.alias("o"))
        mate = rows.where("o > 0").withColumn("k", F.pmod(F.col("k") - F.col("o"), F.lit(blocks)))
        both = rows.withColumn("right", F.lit(False)).unionAll(mate.withColumn("right", F.lit(True)))
        out.append(cut(both.groupBy("o", "k").applyInArrow(_block_links(similarity), "a binary, b binary, sure boolean")))
    return out


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_a"), batch.column("text_b")):
                p, q = shingles(x.as_py(), cache), shingles(y.as_py(), cache)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        del cache
        release()

    return run


#: Bits of the filter that spares texts that no pair asks for the shuffle: 16 for each wanted text, 32 MB at most.
FILTER_BITS = 1 << 28


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `docs` whose digest may be in `wanted`: a bitmap of bounded size, so it may keep more, never less."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64("tid"), F.lit(bits))
    words = wanted.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 AS int)))").alias("bits"))
    bitmap = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()
    bitmap[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def may(b):
        import pandas as pd

        at = b.to_numpy()
        return pd.Series((held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return docs.where(may(bit))


def _met(distinct: DataFrame, tables: int, first: int, similarity: float, base: int, cap: int) -> DataFrame:
    """(a, b, sure, lost) of the tables from `first` on."""
    rows = distinct.mapInArrow(_tables(tables, first), "t int, key long, tid binary, n int, print binary")
    rows = rows.repartitionByRange("t", "key", "print").sortWithinPartitions("t", "key", "print", "tid")
    return cut(rows.mapInArrow(_links(similarity, base, cap, lost=True), "a binary, b binary, sure boolean, lost double"))


def _base(count: int, cap: int) -> int:
    return max(8, int(np.ceil(np.log2(max(2 * count / cap, 1)))))


def _candidates(distinct: DataFrame, similarity: float, tables: int, cap: int) -> list[DataFrame]:
    """(a, b, sure) of all tables, until no text is left that may have been parted from a partner too often."""
    left, first, out = distinct.withColumn("missed", F.lit(0.0)), 0, []
    count = distinct.count()
    base = _base(count, cap)
    number = max(tables, tables_for(similarity, base))
    while True:
        found = [_met(left.drop("missed"), min(GROUP, number - at), first + at, similarity, base, cap) for at in range(0, number, GROUP)]
        first += number
        out += [f.where("b IS NOT NULL").drop("lost") for f in found]
        lost = reduce(DataFrame.unionAll, found).where("b IS NULL").groupBy(F.col("a").alias("tid")).agg(F.sum("lost").alias("lost"))
        now = F.col("missed") + F.lit(float(number * missed(similarity, base))) + F.coalesce("lost", F.lit(0.0))
        before = left
        left = cut(left.join(lost, "tid", "left").select("tid", "n", "print", now.alias("missed")).where(F.col("missed") > math.log(MISS)))
        discard(before)
        count, mean, most = left.agg(F.count(F.lit(1)), F.avg("missed"), F.max("missed")).first()
        if not count:
            return out
        if count <= PER_TABLE * max(1, (mean - math.log(MISS)) / max(-mean / first, 1e-9)):
            return out + _all_pairs(left, count, similarity)
        base = _base(count, cap)
        number = min(2 * GROUP, math.ceil((most - math.log(MISS)) / -float(missed(similarity, base))))


def links(docs: DataFrame, distinct: DataFrame, similarity: float, tables: int, cap: int) -> DataFrame:
    """(a, b) by text digest, from `distinct` (tid, n, print) and the texts of `docs` (tid, text)."""
    found = _candidates(cut(distinct), similarity, tables, cap)
    pairs = cut(reduce(DataFrame.unionAll, found).groupBy("a", "b").agg(F.max("sure").alias("sure")))
    unsure = pairs.where(~F.col("sure")).select("a", "b")
    wanted = cut(unsure.select(F.col("a").alias("tid")).unionAll(unsure.select(F.col("b").alias("tid"))).distinct())
    texts = _likely(docs, wanted).join(wanted, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    side = lambda c: texts.select(F.col("tid").alias(c), F.col("text").alias(f"text_{c}"))
    checked = unsure.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(similarity), "a binary, b binary")
    return pairs.where("sure").select("a", "b").unionAll(checked)


def classes(docs: DataFrame, similarity: float = 0.8, tables: int = 24, cap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tid, class_id, first): one row for each row of `docs`; `first` marks the document that stays."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("tid"), text_of(text_col).alias("text"))
    shape = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("tid", "binary").add("n", "integer").add("print", "binary")
    prints = cut(texts.mapInArrow(_fingerprints, shape))
    # The least document of each distinct text; ids before nulls.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tid").alias("tid"))
    per_text = prints.groupBy("tid").agg(F.min(rank).alias("least"))
    distinct = prints.where("n > 0").groupBy("tid").agg(F.first("n").alias("n"), F.first("print").alias("print"))
    roots = components(links(texts.select("tid", "text"), distinct, similarity, tables, cap))
    labelled = per_text.join(roots.withColumnRenamed("node", "tid"), "tid", "left").select("tid", "least", F.coalesce("root", "tid").alias("root"))
    of_class = labelled.groupBy("root").agg(F.min("least").alias("least"))
    of_text = cut(labelled.select("tid", "root").join(of_class, "root").select("tid", "least"))
    joined = prints.select("doc_id", "tid").join(of_text, "tid")
    first = F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("tid") == F.col("least.tid"))
    return joined.select("doc_id", "tid", F.col("least.id").alias("class_id"), first.alias("first"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with the columns of `docs`; of repeated rows only one stays."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    kept = classes(docs, **options).where("first").select(F.col("doc_id").alias("_id"), F.col("tid").alias("_tid")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(text_of(text_col))).alias("tid"))
    joined = rows.join(kept, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tid") == F.col("_tid")))
    one = joined.dropDuplicates(["id", "tid"])
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
