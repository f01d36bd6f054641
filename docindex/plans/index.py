"""Indices: their definition, routing, entries, matching, and change by batches of actions.

An index is a flat table with one row for each leaf: partition_id, agg_key, index_key, value (joined covered
fields), and the typed fields beside them, so nothing is split when it is read. Hash indices are stored by
`partition_id`, which a match on literals derives while the plan is built, so the scan reads one partition.
"""

from __future__ import annotations

import datetime
import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docindex.functions.keys import data_bucket, gen_key, gen_key_value, identifier, jump_bucket, jump_bucket_value, ring_day, ring_week, string_hash, string_hash_value, to_key
from docindex.operators.changes import normalise

IDENTITY = ("partition_id", "agg_key", "index_key", "value")


class BadPattern(ValueError):
    pass


class MissingPatternKey(KeyError):
    pass


def _and(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


@dataclass(frozen=True)
class Index(ABC):
    """What all index types share. Fields are names of columns, or (name, type) pairs."""

    name: str
    bucket_prefix: str
    index_by: tuple[str, ...]
    covered_fields: tuple[str, ...] = ()
    bucket_type: str = "index_data"
    case_sensitive: bool = False

    def __post_init__(self):
        for f in ("index_by", "covered_fields"):
            object.__setattr__(self, f, tuple(map(to_key, getattr(self, f))))
        if not self.index_by:
            raise ValueError("invalid_configuration: index_by is empty")

    @property
    def type(self) -> str:
        return type(self).__name__

    @property
    def bucket(self) -> str:
        return data_bucket(self.bucket_prefix)

    @property
    def typed_bucket(self) -> tuple[str, str]:
        return self.bucket_type, self.bucket

    @property
    def identifier_prefix(self) -> str:
        return f"{self.name}_partition"

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.key_fields, *self.covered_fields)))

    @property
    def distinguished(self) -> tuple[str, ...]:
        """The keys whose change changes the index."""
        return self.fields

    def _cased(self, c: Column) -> Column:
        return c if self.case_sensitive else F.lower(c)

    def to_json(self) -> str:
        return json.dumps({"type": self.type} | self.__dict__)

    @property
    @abstractmethod
    def key_fields(self) -> tuple[str, ...]: ...

    @abstractmethod
    def number_of_partitions(self) -> int | None: ...

    @abstractmethod
    def partition_identifiers(self, order: str = "asc") -> list[str]: ...

    @abstractmethod
    def route(self, columns: Mapping[str, Column], strict: bool | Column = True) -> Column:
        """The partition of a row."""

    @abstractmethod
    def route_values(self, pattern: Mapping[str, str]):
        """The partition of a pattern."""

    @abstractmethod
    def match(self, entries: DataFrame, pattern: Mapping[str, str]) -> DataFrame: ...

    @abstractmethod
    def agg_fields(self) -> tuple[str, ...]: ...

    @property
    @abstractmethod
    def one(self) -> bool:
        """One value for each key, or a set of them."""

    def leaves(self, rows: DataFrame, carry: Sequence[str] = (), strict: bool | Column = True) -> DataFrame:
        """The index row of each row; `carry` names further columns to keep."""
        for f in self.fields:
            if not isinstance(rows.schema[f].dataType, T.StringType):
                raise TypeError(f"badkeytype: {f} is no string")
        col = {f: F.col(f) for f in self.fields}
        return rows.select(
            *carry,
            self.route(col, strict).alias("partition_id"),
            F.coalesce(gen_key([col[f] for f in self.agg_fields()], self.case_sensitive, strict), F.lit("")).alias("agg_key"),
            gen_key([col[f] for f in self.index_by], self.case_sensitive, strict).alias("index_key"),
            F.coalesce(gen_key([col[f] for f in self.covered_fields], self.case_sensitive, strict), F.lit("")).alias("value"),
            *[self._cased(col[f]).alias(f) for f in self.fields],
        )

    @property
    def identity(self) -> tuple[str, ...]:
        return IDENTITY[:3] if self.one else IDENTITY

    def complete(self, rows: DataFrame) -> Column:
        """Whether a row has all distinguished keys; others are in no index."""
        return _and([rows[f].isNotNull() for f in self.distinguished])

    def build(self, rows: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        """The entries of a whole table. Where keys have one value, the last of `order` wins."""
        flat = self.leaves(rows.where(self.complete(rows)), order, strict=False)
        if not self.one:
            return flat.drop(*order).dropDuplicates(list(IDENTITY))
        kept = [c for c in flat.columns if c not in self.identity and c not in order]
        # Of equal order the greater value wins, so the outcome doesn't hang on the order of rows.
        best = flat.groupBy(*self.identity).agg(F.max(F.struct(*order, "value", *[c for c in kept if c != "value"])).alias("_best"))
        return best.select(*self.identity, *[F.col("_best")[c].alias(c) for c in ["value", *[c for c in kept if c != "value"]]]).select(*IDENTITY, *self.fields)

    def changes(self, actions: DataFrame, force: bool = False) -> DataFrame:
        """(seq, part, kind, entry columns): the inserts and deletes of a batch of `actions`, any number on an identity."""
        flat = normalise(actions, self.distinguished, force).select("seq", "part", "kind", "data.*")
        return self.leaves(flat, ("seq", "part", "kind"), F.col("kind").isNotNull())

    def delta(self, actions: DataFrame, force: bool = False) -> DataFrame:
        """(kind, entry columns): the last action on each identity, of a batch of `actions`."""
        leaves = self.changes(actions, force)
        rest = [c for c in leaves.columns if c not in self.identity and c not in ("seq", "part", "kind")]
        last = leaves.groupBy(*self.identity).agg(F.max(F.struct("seq", "part", "kind", *rest)).alias("_last"))
        return last.select(F.col("_last.kind").alias("kind"), *self.identity, *[F.col("_last")[c].alias(c) for c in rest]).select("kind", *IDENTITY, *self.fields)

    def apply(self, entries: DataFrame, delta: DataFrame) -> DataFrame:
        """The entries after a delta: identities it names go, those it inserts come."""
        kept = entries.join(delta.select(*self.identity), list(self.identity), "left_anti")
        return kept.select(*IDENTITY, *self.fields).unionByName(delta.where("kind = 'insert'").drop("kind"))

    def slim(self, leaves: DataFrame, files: int, carry: Sequence[str] = ()) -> DataFrame:
        """Leaves without their joined keys, which follow from the fields, but with `_file`, a hash of the identity."""
        return leaves.select(*carry, "partition_id", F.pmod(F.xxhash64(*self.identity), F.lit(files)).cast("int").alias("_file"), *self.fields)

    def keyed(self, slim: DataFrame) -> DataFrame:
        """The joined keys put back."""
        key = lambda fields: gen_key([F.col(f) for f in fields], True, False)  # noqa: E731  the fields have their case already
        return slim.withColumns({"agg_key": F.coalesce(key(self.agg_fields()), F.lit("")), "index_key": key(self.index_by), "value": F.coalesce(key(self.covered_fields), F.lit(""))})

    def by_partition(self, delta: DataFrame) -> DataFrame:
        """A delta in groups by partition, each in the order of its keys; no group is collected."""
        return delta.repartition("partition_id").sortWithinPartitions("partition_id", "agg_key", "index_key", "value")

    def changed_partitions(self, delta: DataFrame) -> DataFrame:
        return delta.select("partition_id").distinct()

    def pattern_route(self, patterns: DataFrame, columns: Mapping[str, Column]) -> Column:
        return self.route(columns)

    def match_many(self, entries: DataFrame, patterns: DataFrame) -> DataFrame:
        """The entries of each row of `patterns`, which has all key fields; its other columns come along.

        An equality join on partition and keys: Spark broadcasts the patterns if they are measured to be few.
        """
        col = {f: patterns[f] for f in self.key_fields}
        extra = [c for c in patterns.columns if c not in self.fields]
        keyed = patterns.select(
            *extra,
            self.pattern_route(patterns, col).alias("partition_id"),
            F.coalesce(gen_key([col[f] for f in self.agg_fields()], self.case_sensitive), F.lit("")).alias("agg_key"),
            gen_key([col[f] for f in self.index_by], self.case_sensitive).alias("index_key"),
        )
        return entries.join(keyed, ["partition_id", "agg_key", "index_key"]).select(*extra, *self.fields)

    def page(self, entries: DataFrame, size: int, after: Mapping[str, str] | None = None, descending: bool = False) -> DataFrame:
        """The next `size` entries by (agg_key, index_key, value) after the last of the page before."""
        order = ("agg_key", "index_key", "value")
        if after is not None:
            # Plain comparisons of columns, so that files are skipped by their statistics.
            past = [F.col(o) < after[o] if descending else F.col(o) > after[o] for o in order]
            same = [F.col(o) == after[o] for o in order]
            entries = entries.where((same[0] | past[0]) & (past[0] | same[0] & (past[1] | same[1] & past[2])))
        return entries.orderBy(*[F.desc(o) if descending else F.asc(o) for o in order]).limit(size)

    def cursor(self, entries: DataFrame, size: int = 1000, after: Mapping[str, str] | None = None, descending: bool = False) -> Cursor:
        return Cursor(self, entries, size, after, descending)

    def fold(self, entries: DataFrame, **aggregates: Column) -> DataFrame:
        """One row of aggregates over all entries."""
        return entries.agg(*[c.alias(n) for n, c in aggregates.items()])

    def foreach(self, entries: DataFrame, fun: Callable[[Iterator], None]) -> None:
        """Runs `fun` on the rows of each partition, on the executors."""
        entries.foreachPartition(fun)


class Cursor:
    """Moves over an index in the order of its keys, a page at a time."""

    def __init__(self, index: Index, entries: DataFrame, size: int, after: Mapping[str, str] | None, descending: bool):
        self._index, self._entries, self._size, self._after, self._descending = index, entries, size, after, descending
        self._page, self._at = [], -1
        self.move()

    def move(self) -> bool:
        """To the next entry; False at the end."""
        self._at += 1
        if self._at >= len(self._page):
            self._page, self._at = self._index.page(self._entries, self._size, self._after, self._descending).collect(), 0
            if self._page:
                self._after = {k: self._page[-1][k] for k in ("agg_key", "index_key", "value")}
        return not self.done

    @property
    def done(self) -> bool:
        return self._at >= len(self._page)

    @property
    def key(self) -> tuple[str, str]:
        return self._page[self._at]["agg_key"], self._page[self._at]["index_key"]

    @property
    def values(self) -> dict[str, str]:
        return {f: self._page[self._at][f] for f in self._index.covered_fields}


@dataclass(frozen=True)
class HashIndex(Index):
    """Entries in a fixed number of partitions, by jump hash of `partition_by`."""

    partition_by: tuple[str, ...] = ()
    aggregate_by: tuple[str, ...] = ()
    partitions: int = 8
    cardinality: str = "one"
    sort_ordering: str = "asc"
    partition_algorithm: str = "jch"
    full_index_by: tuple[str, ...] = field(default=(), repr=False)

    def __post_init__(self):
        super().__post_init__()
        for f in ("partition_by", "aggregate_by"):
            object.__setattr__(self, f, tuple(map(to_key, getattr(self, f))))
        if not self.partition_by or self.partitions < 1 or self.cardinality not in ("one", "many") or self.sort_ordering not in ("asc", "desc") or self.partition_algorithm != "jch":
            raise ValueError("invalid_configuration")
        n = len(self.aggregate_by)
        if self.index_by[:n] != self.aggregate_by:
            raise ValueError("invalid_configuration: aggregate_by is no prefix of index_by")
        if len(self.index_by) == n:
            raise ValueError("invalid_configuration: nothing of index_by remains")
        object.__setattr__(self, "full_index_by", self.index_by)
        object.__setattr__(self, "index_by", self.index_by[n:])

    @property
    def key_fields(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.partition_by, *self.aggregate_by, *self.index_by)))

    @property
    def one(self) -> bool:
        return self.cardinality == "one"

    def agg_fields(self) -> tuple[str, ...]:
        return self.aggregate_by

    def number_of_partitions(self) -> int:
        return self.partitions

    def partition_identifiers(self, order: str = "asc") -> list[str]:
        ids = [f"{self.identifier_prefix}_{i}" for i in range(self.partitions)]
        return ids if order == self.sort_ordering else ids[::-1]

    def partition_meta(self, spark: SparkSession) -> DataFrame:
        """A row for each partition, empty ones included."""
        return spark.range(self.partitions).select(F.col("id").cast("int").alias("partition_id"), identifier(self.identifier_prefix, F.col("id")).alias("identifier"))

    def route(self, columns: Mapping[str, Column], strict: bool | Column = True) -> Column:
        return jump_bucket(string_hash(gen_key([columns[f] for f in self.partition_by], self.case_sensitive, strict)), self.partitions)

    def route_values(self, pattern: Mapping[str, str]) -> int:
        for f in self.partition_by:
            if pattern.get(f) is None:
                raise MissingPatternKey(f"missing_pattern_key: {f}")
        return jump_bucket_value(string_hash_value(gen_key_value([pattern[f] for f in self.partition_by], self.case_sensitive)), self.partitions)

    def _value(self, pattern: Mapping[str, str], fields: Sequence[str]) -> str | None:
        return None if any(pattern.get(f) is None for f in fields) else gen_key_value([pattern[f] for f in fields], self.case_sensitive)

    def match(self, entries: DataFrame, pattern: Mapping[str, str]) -> DataFrame:
        where = [F.col("partition_id") == self.route_values(pattern)]
        index_key = self._value(pattern, self.index_by)
        if not self.aggregate_by:
            if index_key is None:
                raise BadPattern("badpattern")
            found = entries.where(_and([*where, F.col("index_key") == index_key]))
            return found.orderBy(F.desc("value")).select(*self.covered_fields)
        agg_key = self._value(pattern, self.aggregate_by)
        if agg_key is None:
            raise BadPattern("badpattern")
        where.append(F.col("agg_key") == agg_key)
        if index_key is None:
            found = entries.where(_and(where)).orderBy(F.desc("index_key"), F.desc("value"))
            return found.select(*dict.fromkeys((*self.aggregate_by, *self.index_by, *self.covered_fields)))
        found = entries.where(_and([*where, F.col("index_key") == index_key])).orderBy(F.desc("value"))
        return found.select(*dict.fromkeys((*self.aggregate_by, *self.covered_fields)))


@dataclass(frozen=True)
class SimpleIndex(Index):
    """A partition for each index key, which is its name."""

    @property
    def key_fields(self) -> tuple[str, ...]:
        return self.index_by

    @property
    def one(self) -> bool:
        return False

    def agg_fields(self) -> tuple[str, ...]:
        return ()

    def number_of_partitions(self) -> None:
        return None

    def partition_identifiers(self, order: str = "asc") -> list[str]:
        return []

    def route(self, columns: Mapping[str, Column], strict: bool | Column = True) -> Column:
        return identifier(self.identifier_prefix, gen_key([columns[f] for f in self.index_by], self.case_sensitive, strict))

    def route_values(self, pattern: Mapping[str, str]) -> str:
        for f in self.index_by:
            if pattern.get(f) is None:
                raise MissingPatternKey(f"missing_pattern_key: {f}")
        return f"{self.identifier_prefix}_{gen_key_value([pattern[f] for f in self.index_by], self.case_sensitive)}"

    def match(self, entries: DataFrame, pattern: Mapping[str, str]) -> DataFrame:
        return entries.where(F.col("partition_id") == self.route_values(pattern)).orderBy("value").select(*self.covered_fields)


@dataclass(frozen=True)
class RingIndex(SimpleIndex):
    """A tumbling ring: a row's partition is the slot of its day or ISO week among the last `slots`.

    Rows of weeks out of bounds (or of no time) are in no partition; a match names the slot in the pattern.
    """

    timestamp_field: str = ""
    slots: int = 16
    unit: str = "day"
    now: str = ""

    def __post_init__(self):
        super().__post_init__()
        if not self.timestamp_field or self.unit not in ("day", "week") or self.slots < 1 or self.slots & (self.slots - 1) or self.unit == "week" and not self.now:
            raise ValueError("invalid_configuration")

    def number_of_partitions(self) -> int:
        return self.slots

    def partition_identifiers(self, order: str = "asc") -> list[str]:
        ids = [f"{self.identifier_prefix}_{i}" for i in range(self.slots)]
        return ids if order == "asc" else ids[::-1]

    def slot(self, ts: Column) -> Column:
        return ring_day(ts, self.slots) if self.unit == "day" else ring_week(ts, self.slots, datetime.datetime.fromisoformat(self.now))

    @property
    def distinguished(self) -> tuple[str, ...]:
        return (*self.fields, self.timestamp_field)

    def leaves(self, rows: DataFrame, carry: Sequence[str] = (), strict: bool | Column = True) -> DataFrame:
        slot = identifier(self.identifier_prefix, self.slot(F.col(self.timestamp_field)))
        flat = super().leaves(rows.withColumn("_slot", slot).where(F.col("_slot").isNotNull()), (*carry, "_slot"), strict)
        return flat.withColumn("partition_id", F.col("_slot")).drop("_slot")

    def pattern_route(self, patterns: DataFrame, columns: Mapping[str, Column]) -> Column:
        return identifier(self.identifier_prefix, patterns["slot"])

    def route_values(self, pattern: Mapping[str, str]) -> str:
        if pattern.get("slot") is None:
            raise MissingPatternKey("missing_pattern_key: slot")
        return f"{self.identifier_prefix}_{pattern['slot']}"

    def match(self, entries: DataFrame, pattern: Mapping[str, str]) -> DataFrame:
        super().route_values(pattern)
        index_key = gen_key_value([pattern[f] for f in self.index_by], self.case_sensitive)
        found = entries.where((F.col("index_key") == index_key) & (F.col("partition_id") == self.route_values(pattern)))
        return found.orderBy("value").select(*self.covered_fields)


TYPES: dict[str, type[Index]] = {"HashIndex": HashIndex, "SimpleIndex": SimpleIndex, "RingIndex": RingIndex}


def from_json(text: str) -> Index:
    given = json.loads(text)
    kind = TYPES[given.pop("type")]
    full = given.pop("full_index_by", None)
    if full:
        given["index_by"] = full
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def renamed(index: Index, name: str) -> Index:
    full = {"index_by": index.full_index_by} if isinstance(index, HashIndex) else {}
    return replace(index, name=name, **full)


def join_base(matched: DataFrame, base: DataFrame, on: str, base_key: str, how: str = "inner") -> DataFrame:
    """Base rows of the ids in a match; ids are text, so the base key is compared as text of its own type."""
    ids = matched.select(F.col(on).cast(base.schema[base_key].dataType).alias("_id")).distinct()
    return base.join(ids, base[base_key] == F.col("_id"), how).select(*base.columns)


def ranked_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole last rows by key, for tables whose rows are wide and keys many."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
