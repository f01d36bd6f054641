"""BPE encoding and decoding through a table of distinct words.

A text is split into the words that the tokenizer's own pre-tokenizer makes of it. Each distinct word of the corpus is
encoded once, its pieces are joined to it by id, and both come back to the texts by position.

Plan. Rows of (document, position, word) would be several times the texts, so words are counted up before they are
shuffled: a task numbers the distinct words of a block of documents (up to BLOCK_WORDS words or BLOCK_DISTINCT distinct
ones) and writes the numbers of each document by position, and each block's words once.

1. Block words are shuffled by word. There, a word is one row of the table of distinct words: it is encoded once, its
   ids are joined to the table of pieces (broadcast; its size is the vocabulary's and checked), and the row joins
   the block words, from the same shuffle. A hot word has one row for each block, and these are streamed. This is done
   for one of SLICES slices of the words after another, so that the shuffles of all needn't fit on the disk at once.
2. (block, number, ids, bytes) goes back to its block, packed. The table of the documents' numbers is bucketed by block
   when it is written, so only the packed words are shuffled. A task holds one block.

Everything between is a table in the shared folder.

Defined cases. Null and empty texts have no tokens. Special tokens in a text are matched as the tokenizers library
does by default. Repeated rows are encoded alike; an empty table gives an empty table. Bytes that are no UTF-8 are read
with replacement characters.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, release, scratch, small_batches, text_of

#: The word pattern of byte-level BPE, as its files' pre-tokenizer has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of ASCII characters alone.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

#: A block ends with the document that reaches one of these.
BLOCK_WORDS, BLOCK_DISTINCT = 1 << 23, 1 << 19
#: Words of a row of a block's words; words of a row that goes back to its block.
ROW_WORDS, PACKED_WORDS = 20_000, 100_000
#: Slices of the words, by their hash.
SLICES = 4
#: A larger vocabulary isn't broadcast.
BROADCAST_PIECES = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Splits texts into words; `special` are the contents of tokens that are matched before."""

    def __init__(self, special: list[str]):
        self.special = special
        self.specials = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.words, self.ascii_words = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall

    def split(self, text: str) -> list[str]:
        find = self.ascii_words if text.isascii() else self.words
        if not any(s in text for s in self.special):
            return find(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*find(text[at : m.start()]), m[0]]
            at = m.end()
        return out + find(text[at:])


class Codec:
    """Encodes words; `path` is a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        if tokenizer.normalizer is not None or '"use_regex":true' not in tokenizer.to_str().partition('"pre_tokenizer"')[2].partition("}")[0]:
            raise ValueError("not a byte-level tokenizer with the usual words")
        self.model = tokenizer.model
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.alphabet = _byte_alphabet()
        self.stand_in = [c for _, c in sorted((b, c) for c, b in self.alphabet.items())]

    def pieces(self) -> dict[int, bytes]:
        """The bytes of each id."""
        found = {i: bytes(self.alphabet[c] for c in piece) for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        return found | {i: t.encode() for t, i in self.special.items()}

    def encode_word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.model.tokenize("".join(map(self.stand_in.__getitem__, word.encode())))]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as all low bytes, then all second bytes and so on: the high ones take no room once compressed."""
    return np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Numbers(dict):
    """word -> its number, in the order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _split(special: list[str], schema: pa.Schema, block_words: int, block_distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers, words, block = Splitter(special), Numbers(), 0, uuid.uuid4().int >> 65

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) if f.name not in columns or isinstance(columns[f.name], list) else columns[f.name] for f in schema], schema=schema)

        def block_rows() -> Iterator[pa.RecordBatch]:
            every = list(numbers)
            for at in range(0, len(every), ROW_WORDS):
                yield rows(block=[block], first=[at], words=[every[at : at + ROW_WORDS]], kind=[0])

        for batch in batches:
            docs, blocks = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                split = own.split(text)
                docs.append(_planes(np.fromiter(map(numbers.__getitem__, split), np.uint32, len(split))))
                blocks.append(block)
                words += len(split)
                if words >= block_words or len(numbers) >= block_distinct:
                    yield from block_rows()
                    numbers, words, block = Numbers(), 0, uuid.uuid4().int >> 65
            if docs:
                yield rows(block=blocks, doc_id=batch.column("doc_id"), codes=docs, kind=[1] * len(docs))
            del docs, blocks
        yield from block_rows()
        numbers = split = None
        release()

    return run


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the vocabulary; broadcast up to BROADCAST_PIECES."""
    held = codec(path).pieces()
    table = spark.createDataFrame(pa.table({"id": pa.array(held, pa.int32()), "piece": pa.array(held.values(), pa.binary())}))
    return F.broadcast(table) if len(held) <= BROADCAST_PIECES else table


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and number, as few rows of compressed numbers, ids and bytes."""

    def packed(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, piece = part.column("ids"), part.column("bytes")
        code = part.column("code").to_numpy()
        lengths, sizes = ids.value_lengths().to_numpy(), pa.compute.binary_length(piece).to_numpy()
        fields = [_planes(np.diff(code, prepend=0)), _planes(lengths), _planes(ids.flatten().to_numpy()), _planes(sizes), b"".join(piece.to_pylist())]
        return pa.RecordBatch.from_arrays([part.column("block")[:1], *[pa.array([zstandard.compress(f)], pa.binary()) for f in fields]], ["block", "codes", "lengths", "ids", "sizes", "bytes"])

    for batch in batches:
        block = batch.column("block").to_numpy()
        ends = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *ends], [*ends, len(block)]):
            for at in range(a, b, PACKED_WORDS):
                yield packed(batch.slice(at, min(b - at, PACKED_WORDS)))
    release()


def _ragged(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the slices `which` of flat, one after the other; the length of each)."""
    sizes = offsets[which + 1] - offsets[which]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[which] - ends + sizes, sizes)
    return flat[at], sizes


class Block:
    """The words of a block by number: ids and bytes."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, *fields: bytes) -> None:
        codes, lengths, ids, sizes, raw = map(zstandard.decompress, fields)
        self.parts.append((np.cumsum(_of_planes(codes)), _of_planes(lengths), _of_planes(ids), _of_planes(sizes), np.frombuffer(raw, np.uint8)))

    def close(self) -> None:
        codes, lengths, ids, sizes, raw = map(np.concatenate, zip(*self.parts)) if self.parts else (np.empty(0, np.int64),) * 5
        order = np.argsort(codes)
        starts = lambda x: np.r_[0, np.cumsum(x, dtype=np.int64)]
        self.ids, n = _ragged(ids.astype(np.uint32), starts(lengths), order)
        self.bytes, m = _ragged(raw.astype(np.uint8), starts(sizes), order)
        self.at_id, self.at_byte, self.parts = starts(n), starts(m), []


def _assemble(with_ids: bool, schema: pa.Schema, group_words: int = 1 << 18):
    """The results of a block's documents, from their numbers and the block's words."""

    def results(block: Block, ids: pa.Array, codes: list[np.ndarray]) -> pa.RecordBatch:
        word_ends = np.cumsum([0, *map(len, codes)])
        flat = np.concatenate(codes).astype(np.int64)
        tokens, lengths = _ragged(block.ids, block.at_id, flat)
        raw, sizes = _ragged(block.bytes, block.at_byte, flat)
        ends = np.r_[0, np.cumsum(lengths)][word_ends]
        byte_ends = np.r_[0, np.cumsum(sizes)][word_ends]
        tokens, raw = np.ascontiguousarray(tokens, "<u4"), raw.tobytes()
        sums = [hashlib.sha256(tokens[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
        back = [hashlib.sha256(raw[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(byte_ends, byte_ends[1:])]
        columns = [ids.cast(schema.field("doc_id").type), pa.array(np.diff(ends)), pa.array(sums), pa.array(back)]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens.view("<i4"))))
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        block = Block()
        for row in zip(*(words.column(c).to_pylist() for c in ("codes", "lengths", "ids", "sizes", "bytes"))):
            block.add(*row)
        block.close()
        ids, out, first, codes, n = docs.column("doc_id").combine_chunks(), [], 0, [], 0
        for i, code in enumerate(docs.column("codes"), 1):
            codes.append(_of_planes(code.as_py()))
            n += len(codes[-1])
            if n >= group_words or i == len(docs):
                out.append(results(block, ids.slice(first, i - first), codes))
                first, codes, n = i, [], 0
        del block, codes
        release()
        return pa.Table.from_batches(out, out[0].schema) if out else schema.empty_table()

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, block_distinct: int = BLOCK_DISTINCT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids, for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or default_path()
    id_field = T.StructField("doc_id", docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    split = T.StructType([T.StructField("block", T.LongType()), id_field]).add("codes", "binary").add("first", "integer").add("words", T.ArrayType(T.StringType())).add("kind", "integer")
    numbered = _bucketed(rows.mapInArrow(_split(list(codec(path).special), _arrow(split), block_words, block_distinct), split), "block")
    named = _named(numbered.where("kind = 0"), path)
    schema = T.StructType([id_field]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    texts = numbered.where("kind = 1").select("block", "doc_id", "codes")
    return texts.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(_assemble(with_ids, _arrow(schema)), schema)


def _bucketed(df: DataFrame, by: str) -> DataFrame:
    """`df` as a table in the shared folder, in four times as many buckets as a shuffle has partitions: few meet in one."""
    spark, at = df.sparkSession, scratch(df.sparkSession)
    name = "bpe_" + uuid.uuid4().hex
    df.write.bucketBy(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", at).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _named(split: DataFrame, path: str) -> DataFrame:
    """The ids and bytes of each block's words, packed: one join with the table of distinct words."""

    @F.arrow_udf("array<int>")
    def ids_of(words: pa.Array) -> pa.Array:
        return pa.array(map(codec(path).encode_word, words.to_pylist()), pa.list_(pa.int32()))

    ids_of = ids_of.asNondeterministic()  # else it is also a filter, below the aggregate and for each of its rows
    listed = split.select("block", "first", F.posexplode("words").alias("pos", "word"))
    listed = listed.select("word", "block", (F.col("first") + F.col("pos")).alias("code"))
    pieces, out = piece_table(split.sparkSession, path), []
    for k in range(SLICES):
        used = listed.where(F.pmod(F.xxhash64("word"), F.lit(SLICES)) == k).repartition("word")
        # The columns of `used` are all read here too, so that both sides of the join are one shuffle.
        distinct = used.groupBy("word").agg(F.count("block").alias("blocks"), F.max("code").alias("last")).where("blocks > 0 AND last >= 0").select("word", ids_of("word").alias("ids"))
        tokens = distinct.select("word", F.posexplode("ids").alias("pos", "id")).join(pieces, "id")
        whole = F.array_sort(F.collect_list(F.struct("pos", "id", "piece")))
        encoded = tokens.groupBy("word").agg(whole.alias("t")).select("word", F.col("t.id").alias("ids"), F.array_join(F.col("t.piece").cast("array<string>"), "").cast("binary").alias("bytes"))
        back = used.join(encoded, "word").select("block", "code", "ids", "bytes").sortWithinPartitions("block", "code")
        out.append(cut(back.mapInArrow(_pack, "block long, codes binary, lengths binary, ids binary, sizes binary, bytes binary")))
    return reduce(DataFrame.unionAll, out)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns of `encoded`, with `text` from its ids: each is joined to its piece, and pieces go by position."""
    spark = encoded.sparkSession
    table = cut(encoded.select(F.struct("*").alias("row"), F.uuid().alias("key")))
    tokens = table.select("key", F.posexplode(F.col("row").getField(ids_col)).alias("pos", "id")).join(piece_table(spark, path or default_path()), "id")
    whole = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    texts = tokens.groupBy("key").agg(F.array_join(F.transform(whole, lambda t: t["piece"].cast("string")), "").alias("text"))
    joined = table.join(texts, "key", "left").withColumn("text", F.make_valid_utf8(F.coalesce("text", F.lit(""))))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in encoded.columns if c != "text"], "text")
