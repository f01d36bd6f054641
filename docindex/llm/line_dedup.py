"""Line dedup across documents: explode normalised lines, hash, count documents, drop, reassemble.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z in lower case. A key of at least
`min_chars` code points that is found in at least `min_docs` documents loses all its lines, except in the
document of the largest id that holds it.

Defined cases. Every row is a document of its own: repeated rows count as often as they come, and all rows of the
largest id keep their lines. A null id is smaller than any other; when no holder has an id, all keep theirs. Null
and empty texts are one empty line. A document that loses all its lines has the empty text. An empty table gives
an empty table. Extra columns pass through `dedup_lines` untouched, whatever their names.

Plan. Keys are made distinct inside each row, so the count per key is a plain partial aggregate and a line that a
third of all documents hold costs one row for each map task. Only keys at the threshold are joined back with the
line positions, without texts; that join is on the key, and adaptive execution splits a hot one. Texts are moved
once, to meet the list of positions they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, let, text_of


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    """128 bits: two xxhash64 with different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, positions): the lines each document loses; documents that lose none are absent."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    split = F.split("text", "\n")
    keys = F.array_distinct(F.filter(F.transform(split, line_key), lambda k: F.length(k) >= min_chars))
    frequent = (
        rows.select("id", F.explode(keys).alias("key"))
        .groupBy(*_hashes(F.col("key")))
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    lines = (
        rows.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(split).alias("pos", "line"))
        .select("id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "text_hash", "pos", *_hashes(F.col("key")))
    )
    lost = lines.join(frequent, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("positions"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row` (struct of all columns of `docs`), `n_lines`, `n_dropped`, `kept` (the remaining text)."""
    lost = dropped_positions(docs, min_chars, min_docs, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    joined = rows.join(lost, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    split = F.split("text", "\n")

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("positions"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return joined.select(
        "row",
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("positions").isNull(), F.col("text")).otherwise(let(split, rest)).alias("kept"),
    )


def apply_dedup(docs: DataFrame, **options) -> DataFrame:
    """`docs` with its columns, the texts without the dropped lines and `n_chars`, where there is one, to match."""
    text_col = options.get("text_col", "text")
    done = dedup_lines(docs, **options)
    changed = F.col("n_dropped") > 0

    def column(c: str) -> Column:
        old = F.col("row").getField(c)
        if c == text_col:
            return F.when(changed, F.col("kept")).otherwise(old).alias(c)
        if c == "n_chars":
            return F.when(changed, F.length("kept")).otherwise(old).cast(docs.schema[c].dataType).alias(c)
        return old.alias(c)

    return done.select(*map(column, docs.columns))
