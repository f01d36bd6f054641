"""Index collections, and workflows that change them and index data in a safe order.

The catalog is one small table of index definitions. Work is collected as ordered steps and runs when the outermost
workflow ends: index data before the catalog when an index is created, the catalog before the data when one is
dropped, so that a listed index always has its data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docindex.functions.keys import collection_bucket, string_hash, string_hash_value
from docindex.plans.index import IDENTITY, HashIndex, Index, from_json
from docindex.sources.store import SLICE, NotFound, Store

CATALOG = "collection string, index_name string, index_type string, config string"


class BadIndex(KeyError):
    pass


class AlreadyExists(ValueError):
    pass


@dataclass
class Collection:
    """Named indices of one kind of entity."""

    id: str
    bucket_prefix: str
    data: dict[str, Index] = field(default_factory=dict)

    @property
    def bucket(self) -> str:
        return collection_bucket(self.bucket_prefix)

    def add_index(self, index: Index) -> Collection:
        return Collection(self.id, self.bucket_prefix, self.data | {index.name: index})

    def delete_index(self, name: str) -> Collection:
        return Collection(self.id, self.bucket_prefix, {k: v for k, v in self.data.items() if k != name})

    def index(self, name: str) -> Index:
        if name not in self.data:
            raise BadIndex(f"badindex: {name}")
        return self.data[name]

    def is_index(self, name: str) -> bool:
        return name in self.data

    def index_names(self) -> list[str]:
        return sorted(self.data)

    def indices(self) -> list[Index]:
        return [self.data[n] for n in self.index_names()]

    def fold(self, fun: Callable, start):
        """`fun(name, index, acc)` in order of name."""
        return reduce(lambda acc, n: fun(n, self.data[n], acc), self.index_names(), start)

    @property
    def size(self) -> int:
        return len(self.data)

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.id, i.name, i.type, i.to_json()) for i in self.indices()], CATALOG)


@dataclass
class Work:
    """A workflow that runs in the background."""

    future: Future

    def status(self) -> str:
        if not self.future.done():
            return "pending"
        return "failed" if self.future.exception() else "completed"

    def wait(self, timeout_s: float | None = None):
        """Its result; raises what it raised, or TimeoutError."""
        return self.future.result(timeout_s)


class Manager:
    """Creates, changes and drops indices in a store."""

    BUCKET_TYPE = "index_collection"

    def __init__(self, store: Store):
        self.store = store
        self._steps: list[tuple[str, Callable[[], None]]] = []
        self._depth = 0
        self._deleted: set[str] = set()
        self._pool: ThreadPoolExecutor | None = None

    # Workflows

    def submit(self, fun: Callable[[Manager], object]) -> Work:
        """Runs `fun` in a workflow of its own, after those submitted before."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(1)

        def run():
            other = Manager(self.store)
            with other.workflow():
                return fun(other)

        return Work(self._pool.submit(run))

    @contextmanager
    def workflow(self):
        """Collects steps; the outermost one runs them in order, and an exception drops them all."""
        self._depth += 1
        try:
            yield self
        except BaseException:
            if self._depth == 1:
                self._steps.clear()
                self._deleted.clear()
            raise
        else:
            if self._depth == 1:
                steps, self._steps = self._steps, []
                self._deleted.clear()
                for _, run in steps:
                    run()
        finally:
            self._depth -= 1

    def steps(self) -> list[str]:
        return [name for name, _ in self._steps]

    def _add(self, name: str, run: Callable[[], None]) -> None:
        self._steps.append((name, run))

    # Collections

    def _bucket(self, collection: Collection) -> str:
        return f"{collection.bucket}/{collection.id}"

    def lookup(self, bucket_prefix: str, id: str) -> Collection | None:
        try:
            return self.fetch(bucket_prefix, id)
        except NotFound:
            return None

    def fetch(self, bucket_prefix: str, id: str) -> Collection:
        rows = self.store.read(self.BUCKET_TYPE, f"{collection_bucket(bucket_prefix)}/{id}").orderBy("index_name").collect()
        return Collection(id, bucket_prefix, {r["index_name"]: from_json(r["config"]) for r in rows})

    def save(self, collection: Collection) -> None:
        self.store.overwrite(collection.frame(self.store.spark).coalesce(1), self.BUCKET_TYPE, self._bucket(collection))

    def delete(self, collection: Collection) -> None:
        self._deleted.add(collection.id)
        with self.workflow():
            self._add(f"delete {collection.id}", lambda: self.store.drop(self.BUCKET_TYPE, self._bucket(collection)))

    def _alive(self, collection: Collection) -> None:
        if collection.id in self._deleted:
            raise BadIndex(f"scheduled_for_delete: {collection.id}")

    # Index data

    def _data(self, index: Index) -> tuple[str, str]:
        return index.bucket_type, f"{index.bucket}/{index.name}"

    def entries(self, index: Index) -> DataFrame:
        return self.store.read(*self._data(index)).drop(SLICE)

    def _part(self, index: Index) -> tuple[str, Column | None]:
        """The column that an index is stored by. A simple index has a partition for each key: it is stored by their hash."""
        if isinstance(index, HashIndex):
            return "partition_id", None
        return SLICE, F.pmod(string_hash(F.col("partition_id")), F.lit(self.store.slices)).cast("int")

    def _files(self, index: Index) -> int:
        """Parts of each folder, so that a table is spread over all tasks, however few folders it has."""
        folders = index.partitions if isinstance(index, HashIndex) else self.store.slices
        tasks = int(self.store.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(-(-4 * min(tasks, 32) // folders), tasks // folders)

    def _laid_out(self, index: Index, slim: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        """The last row of each identity by `order`, sorted for skipping: one shuffle and one sort for both.

        Identities are mostly unique, so they aren't aggregated before the shuffle, which would sort the rows twice.
        `_file` follows from the identity; as a key it tells Spark that equal identities have met.
        """
        by, part = self._part(index)
        spread = slim if part is None else slim.withColumn(by, part)
        rows = index.keyed(spread.repartition(by, "_file"))
        keys = tuple(dict.fromkeys((by, *index.identity)))
        rest = [c for c in ("value", *index.fields) if c not in keys]
        last = rows.groupBy(*keys, "_file").agg(F.max(F.struct(*order, *rest)).alias("_last"))
        if order:
            last = last.where("_last.kind = 'insert'")
        names = dict.fromkeys((*IDENTITY, *index.fields, by))
        return last.select(*[n if n in keys else F.col("_last")[n].alias(n) for n in names]).sortWithinPartitions(*keys)

    def _write(self, index: Index, base: DataFrame) -> None:
        leaves = index.leaves(base.where(index.complete(base)), strict=False)
        self.store.overwrite(self._laid_out(index, index.slim(leaves, self._files(index))), *self._data(index), partition_by=self._part(index)[0])

    def _touched(self, index: Index, changes: DataFrame) -> list[str]:
        """The partitions (of a simple index, the slices) that changes touch: as many as folders, at most."""
        by, part = self._part(index)
        return [str(r[0]) for r in (changes if part is None else changes.withColumn(by, part)).select(by).distinct().collect()]

    def _apply(self, index: Index, changes: DataFrame, touched: list[str], files: int) -> None:
        """Reads and rewrites the touched partitions. Of an identity the last change decides, else its entry stays."""
        entries = index.slim(index.keyed(self.store.read(*self._data(index), partitions=touched).select("partition_id", *index.fields)), files)
        before = {"seq": F.lit(None).cast(changes.schema["seq"].dataType), "part": F.lit(-1), "kind": F.lit("insert")}
        new = self._laid_out(index, entries.withColumns(before).unionByName(changes), tuple(before))
        self.store.replace_partitions(new, *self._data(index), self._part(index)[0], touched)
        changes.unpersist()

    def partition(self, index: Index, identifier: str) -> DataFrame:
        """The entries of one partition by its identifier; NotFound for one that the index can't have."""
        prefix = f"{index.identifier_prefix}_"
        known = index.partition_identifiers()
        if not identifier.startswith(prefix) or known and identifier not in known:
            raise NotFound(f"partition_not_found: {identifier}")
        if isinstance(index, HashIndex):
            found = self.store.lookup_partition(*self._data(index), identifier.removeprefix(prefix))
            return self.entries(index).where("false") if found is None else found
        at = str(string_hash_value(identifier) % self.store.slices)
        return self.store.read(*self._data(index), partitions=[at]).drop(SLICE).where(F.col("partition_id") == identifier)

    def drop_partition(self, index: HashIndex, identifier: str) -> None:
        self.store.delete_partition(*self._data(index), identifier.removeprefix(f"{index.identifier_prefix}_"))

    def match(self, index: Index, pattern: dict[str, str]) -> DataFrame:
        """Reads the one partition that the pattern routes to."""
        routed = index.route_values(pattern)
        if isinstance(index, HashIndex):
            return index.match(self.store.read(*self._data(index), partitions=[str(routed)]), pattern)
        return index.match(self.partition(index, routed), pattern)

    def create_index(self, index: Index, collection: Collection, base: DataFrame) -> Collection:
        self._alive(collection)
        if collection.is_index(index.name):
            raise AlreadyExists(f"already_exists: {index.name}")
        new = collection.add_index(index)
        with self.workflow():
            self._add(f"write {index.name}", lambda: self._write(index, base))
            self._add(f"save {collection.id}", lambda: self.save(new))
        return new

    def rebuild_index(self, name: str, collection: Collection, base: DataFrame) -> dict[str, int]:
        """Builds the index anew; how many rows of `base` it took and how many lack one of its keys, in one pass."""
        index = collection.index(name)
        counts = base.agg(F.count_if(index.complete(base)).alias("succeeded"), F.count_if(~index.complete(base)).alias("failed")).first()
        with self.workflow():
            self._add(f"write {name}", lambda: self._write(index, base))
        return counts.asDict()

    def drop_index(self, name: str, collection: Collection) -> Collection:
        return self.drop_indices([name], collection)

    def drop_indices(self, names: list[str], collection: Collection) -> Collection:
        self._alive(collection)
        gone = [collection.index(n) for n in names]
        new = reduce(lambda c, n: c.delete_index(n), names, collection)
        with self.workflow():
            self._add(f"save {collection.id}", lambda: self.save(new))
            for index in gone:
                self._add(f"drop {index.name}", lambda i=index: self.store.drop(*self._data(i)))
        return new

    def drop_all_indices(self, collection: Collection) -> Collection:
        return self.drop_indices(collection.index_names(), collection)

    def update_indices(self, actions: DataFrame, names: list[str], collection: Collection, force: bool = False) -> list[str]:
        """Applies one batch of actions to several indices; the names of those that it changes."""
        self._alive(collection)
        changed = []
        with self.workflow():
            for index in map(collection.index, names):
                files = self._files(index)
                changes = index.slim(index.changes(actions, force), files, ("seq", "part", "kind")).persist()
                touched = self._touched(index, changes)
                if touched:
                    changed.append(index.name)
                    self._add(f"write {index.name}", lambda i=index, c=changes, t=touched, n=files: self._apply(i, c, t, n))
                else:
                    changes.unpersist()
        return changed

    def update_all_indices(self, actions: DataFrame, collection: Collection, force: bool = False) -> list[str]:
        return self.update_indices(actions, collection.index_names(), collection, force)

    def partition_meta(self, index: HashIndex) -> DataFrame:
        """identifier, created_ts, last_updated_ts and n of every partition, empty ones included."""
        times = [(int(k), *v) for k, v in self.store.times(*self._data(index)).items()]
        known = self.store.spark.createDataFrame(times, "partition_id int, created_ts long, last_updated_ts long")
        return index.partition_meta(self.store.spark).join(known, "partition_id", "left").join(self.partition_sizes(index), "partition_id", "left").fillna(0, ["n"])

    def partition_sizes(self, index: Index) -> DataFrame:
        return self.entries(index).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))
