"""Sharding by a permutation-filled lookup table.

Each shard has a permutation of the slots of a table of prime size, from two digests of its name. Shards take turns
to claim the first slot of their permutation that is still free, until none is. A row's slot is a digest of its key
modulo the size, and its shard is the slot's: even within one slot a shard, and when shards come or go few other
slots change hands.

Defined cases. A null key counts as the text `null`. Rows of equal keys share a shard; repeated rows stay. An empty
table gives an empty table; extra columns pass through `place` as the struct `row`.

Plan. The table has `size` rows whatever the input (65,537: about 1 MB), so it is broadcast: rows are placed by one
hash look-up each, without a shuffle, and a hot source is spread like any other rows since keys are single rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(96))


def _digests(name: str) -> tuple[int, int]:
    d = hashlib.md5(name.encode()).digest()
    return int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big")


def lookup_table(shards=SHARDS, size: int = SIZE) -> list[int]:
    """The index of each slot's shard."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > size or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("shards must be distinct, and no more than the size, a prime")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at, skip = zip(*((a % size, b % (size - 1) + 1) for a, b in map(_digests, shards)))
    at, table, free = list(at), [-1] * size, size
    while free:
        for i in order:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def place(rows: DataFrame, key: str, shards=SHARDS, size: int = SIZE) -> DataFrame:
    """`row` (struct of all columns), slot and shard."""
    table = lookup_table(shards, size)
    of_slot = rows.sparkSession.createDataFrame(pd.DataFrame({"slot": range(size), "shard": [shards[i] for i in table]}), "slot int, shard string")
    return rows.select(F.struct("*").alias("row"), slot_of(F.col(key), size).alias("slot")).join(F.broadcast(of_slot), "slot").select("row", "slot", "shard")


def write_shards(rows: DataFrame, key: str, path: str, shards=SHARDS, size: int = SIZE) -> None:
    """Writes each shard as a folder of its own; a shard is spread over several tasks."""
    placed = place(rows, key, shards, size)
    placed.select("row.*", "shard").repartition("shard", F.pmod(F.xxhash64("slot"), F.lit(8))).write.partitionBy("shard").parquet(path)
