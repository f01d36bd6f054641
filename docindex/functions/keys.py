"""Key functions: joined keys, jump consistent hashing, identifiers, ring slots. All but the hash are built-in expressions."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the parts of a joined key.
SEPARATOR = "\x19"
_FACTOR = 2862933555777941757


def gen_key(parts: Sequence[Column], case_sensitive: bool = False, strict: bool | Column = True) -> Column:
    """The joined key. A missing part raises `badkey` if strict, and makes the key null otherwise.

    A column as `strict` tells for each row: the optimiser may evaluate a key before a filter that would drop its row.
    """
    if not parts:
        return F.lit(None).cast("string")
    cased = [p if case_sensitive else F.lower(p) for p in parts]
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    joined = F.concat_ws(SEPARATOR, *cased)
    absent = F.lit(None).cast("string")
    if strict is not False:
        wrong = F.raise_error(F.lit("badkey")).cast("string")
        absent = wrong if strict is True else F.when(strict, wrong)
    return F.when(missing, absent).otherwise(joined)


def gen_key_value(parts: Sequence[str], case_sensitive: bool = False) -> str:
    """`gen_key` of plain values."""
    return SEPARATOR.join(p if case_sensitive else p.lower() for p in parts)


def split_key(joined: Column, names: Sequence[str]) -> Column:
    """A joined key as a struct of its parts."""
    parts = F.split(joined, SEPARATOR, -1)
    return F.struct(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def string_hash(key: Column) -> Column:
    """A portable number below 2^28 of a string."""
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long")


def string_hash_value(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:7], 16)


def jump_bucket_value(key: int, buckets: int) -> int:
    """The bucket of a number among `buckets`, by jump consistent hashing."""
    state, found, jump = key % (1 << 64), -1, 0
    while jump < buckets:
        found = jump
        state = (state * _FACTOR + 1) % (1 << 64)
        jump = int((found + 1) * (2147483648.0 / ((state >> 33) + 1)))
    return found


def jump_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The same of an array of 64-bit numbers; each round moves the keys that haven't jumped past the end."""
    state, found, jump = keys.astype(np.int64).view(np.uint64).copy(), np.zeros(len(keys), np.int32), np.zeros(len(keys))
    left = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(left):
            found[left] = jump
            state = state * np.uint64(_FACTOR) + np.uint64(1)
            jump = np.floor((jump + 1) * (2147483648.0 / ((state >> np.uint64(33)).astype(np.float64) + 1)))
            on = jump < buckets
            left, state, jump = left[on], state[on], jump[on]
    return found


def jump_bucket(key: Column, buckets: int) -> Column:
    """The same of a bigint column, null for null.

    By Arrow batches in numpy: a tenth of a microsecond a key. As a built-in expression the jumps are a higher-order
    function, which Spark interprets: measured at 10 to 25 microseconds a key, and written out they are too large to
    be compiled. Several buckets of one row are computed in one pass over the batch.
    """
    if buckets < 1:
        raise ValueError("badarg: buckets")
    if buckets == 1:
        return F.when(key.isNotNull(), F.lit(0))

    @F.arrow_udf("int")
    def bucket(keys: pa.Array) -> pa.Array:
        valid = keys.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(jump_buckets(keys.fill_null(0).to_numpy(zero_copy_only=False), buckets), pa.int32(), mask=~valid)

    return bucket(key)


def identifier(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), x.cast("string"))


def data_bucket(prefix: str) -> str:
    return f"{prefix}-index_data"


def collection_bucket(prefix: str) -> str:
    return f"{prefix}-index_collection"


def parse_patch_path(path: str) -> list[str]:
    """`/a/b` as `[a, b]`; empty parts at the end are dropped."""
    if not path.startswith("/"):
        raise ValueError(f"badpath: {path!r}")
    parts = path[1:].split("/")
    while parts and not parts[-1]:
        parts.pop()
    return parts


def to_key(key) -> str:
    """The field name of a key, or of a (name, type) pair."""
    name = key[0] if isinstance(key, tuple) and len(key) == 2 else key
    if not isinstance(name, str):
        raise KeyError(f"badkey: {key!r}")
    return name


def ring_day(ts: Column, slots: int) -> Column:
    """The slot of a day on a ring of `slots` days."""
    if not 1 <= slots <= 366:
        raise ValueError("badarg: slots")
    return F.pmod(F.floor(F.unix_seconds(ts.cast("timestamp")) / 86400), F.lit(slots)).cast("int")


def ring_week(ts: Column, slots: int, now: datetime.datetime) -> Column:
    """The slot of an ISO week, null (out of bounds) unless it is one of the last `slots` weeks before `now`."""
    age = F.datediff(F.lit(now.date()), ts.cast("date"))
    return F.when((age >= 0) & (age < 7 * slots), F.weekofyear(ts) % slots).cast("int")
