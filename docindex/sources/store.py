"""Tables of typed documents and of index data: a folder for each (bucket type, bucket), in published versions.

A write goes to a new folder and becomes visible when a manifest that names its parts is renamed to the next number, so
a table can be rewritten from itself and readers see whole versions. Of two writers that start from the same version
one gets a Conflict. The parts of the last KEPT versions stay, for plans that read them. A partitioned table names each
partition's folder, so a change rewrites the partitions that it touches and leaves the others where they are; documents
are partitioned by a hash of their key.
"""

from __future__ import annotations

import atexit
import json
import logging
import tempfile
import time
import uuid
from collections import OrderedDict
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docindex.functions.keys import string_hash, string_hash_value

log = logging.getLogger("docindex")


#: Versions of a table whose parts stay.
KEPT = 2
#: The column that spreads documents over folders, by a hash of the key.
SLICE = "_slice"


class NotFound(KeyError):
    pass


class Conflict(RuntimeError):
    """Another writer published first."""


class Overload(RuntimeError):
    """The cluster has no room for the request now."""


class DatatypeMismatch(TypeError):
    pass


def tidy(error: Exception) -> Exception:
    """The error that a caller should see for one of Spark's."""
    text = str(error)
    if isinstance(error, PySparkException):
        if "DATATYPE_MISMATCH" in text or "CAST_INVALID_INPUT" in text or "FIELD_DATA_TYPE" in text:
            return DatatypeMismatch(text.splitlines()[0])
        if "maxResultSize" in text or "OutOfMemory" in text or "No space left" in text:
            return Overload(text.splitlines()[0])
    return error


@dataclass(frozen=True)
class Options:
    """Request options. Quorums and timeouts of other stores are accepted and mean nothing here."""

    timeout_ms: int = 60_000
    return_body: bool = False
    telemetry_name: str | None = None
    quorum: dict = field(default_factory=dict)

    KNOWN = ("timeout", "return_body", "telemetry_name", "r", "w", "pr", "pw", "n_val", "basic_quorum", "notfound_ok", "sloppy_quorum")

    @classmethod
    def of(cls, given: dict, strict: bool = True) -> Options:
        if strict and (unknown := set(given) - set(cls.KNOWN)):
            raise ValueError(f"badarg: {sorted(unknown)}")
        plain = {"timeout": "timeout_ms", "return_body": "return_body", "telemetry_name": "telemetry_name"}
        return cls(**{plain[k]: v for k, v in given.items() if k in plain}, quorum={k: v for k, v in given.items() if k in cls.KNOWN and k not in plain})

    #: What each kind of request takes.
    BY_OPERATION = {"get": KNOWN, "put": KNOWN, "delete": tuple(k for k in KNOWN if k != "return_body"), "execute": ("timeout", "telemetry_name")}

    @classmethod
    def validated(cls, operation: str, given: dict, mode: str = "strict") -> Options:
        """Options of one kind of request; `relaxed` drops what it doesn't take."""
        known = cls.BY_OPERATION[operation]
        if mode == "strict" and (unknown := set(given) - set(known)):
            raise ValueError(f"badarg: {sorted(unknown)}")
        return cls.of({k: v for k, v in given.items() if k in known})

    def request(self) -> dict:
        """As a flat dict, of what a request carries."""
        return {"timeout": self.timeout_ms, "return_body": self.return_body} | self.quorum


@contextmanager
def telemetry(name: str, **about):
    """Logs the start and the end, or failure, of a request."""
    start = time.monotonic()
    log.debug("%s start %s", name, about)
    try:
        yield
    except Exception as error:
        log.exception("%s exception after %.3f s %s", name, time.monotonic() - start, about)
        if (seen := tidy(error)) is not error:
            raise seen from error
        raise
    log.debug("%s stop after %.3f s %s", name, time.monotonic() - start, about)


@dataclass
class Cache:
    """Tables that stay persisted: at most `entries`, least recently used first out, for `ttl_s` seconds."""

    entries: int = 100
    ttl_s: float = 600
    held: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key: str, version: dict) -> DataFrame | None:
        if key not in self.held:
            return None
        since, of, df = self.held[key]
        if of != version or time.monotonic() - since > self.ttl_s:
            self.drop(key)
            return None
        self.held.move_to_end(key)
        return df

    def put(self, key: str, version: dict, df: DataFrame) -> DataFrame:
        self.drop(key)
        self.held[key] = (time.monotonic(), version, df.persist())
        while len(self.held) > self.entries:
            self.drop(next(iter(self.held)))
        return df

    def drop(self, key: str) -> None:
        if key in self.held:
            self.held.pop(key)[2].unpersist()


class Store:
    """Documents under `root`, any path that Hadoop's file systems know."""

    def __init__(self, spark: SparkSession, root: str, cache: Cache | None = None, slices: int = 16):
        self.spark, self.root, self.cache, self.slices = spark, root.rstrip("/"), cache, slices

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folder(self, bucket_type: str, bucket: str) -> str:
        return f"{self.root}/{bucket_type}/{bucket}"

    def _versions(self, folder: str) -> list[int]:
        path, fs = self._fs(f"{folder}/_manifests")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()) if fs.exists(path) else []

    def _load(self, folder: str, version: int) -> dict:
        path, fs = self._fs(f"{folder}/_manifests/{version}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"version": version}
        finally:
            stream.close()

    def _current(self, folder: str) -> dict | None:
        """{version, schema, parts: {partition or "": path below the folder}, times}."""
        versions = self._versions(folder)
        return self._load(folder, versions[-1]) if versions else None

    def exists(self, bucket_type: str, bucket: str) -> bool:
        return self._current(self.folder(bucket_type, bucket)) is not None

    def _manifest(self, bucket_type: str, bucket: str) -> dict:
        now = self._current(self.folder(bucket_type, bucket))
        if now is None:
            raise NotFound(f"not_found: {bucket_type}/{bucket}")
        return now

    def partitions(self, bucket_type: str, bucket: str) -> list[str]:
        return list(self._manifest(bucket_type, bucket)["parts"])

    def lookup_partition(self, bucket_type: str, bucket: str, partition: str) -> DataFrame | None:
        """The rows of one partition, from the cache if it holds the table; None without it."""
        if partition not in self.partitions(bucket_type, bucket):
            return None
        folder, now = f"{self.folder(bucket_type, bucket)}#{partition}", self._manifest(bucket_type, bucket)
        if self.cache is None:
            return self.read(bucket_type, bucket, [partition])
        at = {partition: now["parts"][partition]}
        return self.cache.get(folder, at) or self.cache.put(folder, at, self.read(bucket_type, bucket, [partition]))

    def fetch_partition(self, bucket_type: str, bucket: str, partition: str) -> DataFrame:
        found = self.lookup_partition(bucket_type, bucket, partition)
        if found is None:
            raise NotFound(f"partition_not_found: {bucket_type}/{bucket}/{partition}")
        return found

    def delete_partition(self, bucket_type: str, bucket: str, partition: str) -> None:
        now = self._manifest(bucket_type, bucket)
        if partition not in now["parts"]:
            raise NotFound(f"partition_not_found: {bucket_type}/{bucket}/{partition}")
        self.publish(bucket_type, bucket, now | {"parts": {k: p for k, p in now["parts"].items() if k != partition}}, now["version"])

    def read(self, bucket_type: str, bucket: str, partitions: Sequence[str] | None = None, force_refresh: bool = True) -> DataFrame:
        """The table, or some of its partitions. Only without `force_refresh` a whole table may come from the cache."""
        folder, now = self.folder(bucket_type, bucket), self._manifest(bucket_type, bucket)
        if self.cache is not None and not force_refresh and partitions is None:
            return self.cache.get(folder, now["parts"]) or self.cache.put(folder, now["parts"], self.read(bucket_type, bucket))
        schema = T.StructType.fromJson(now["schema"])
        paths = [f"{folder}/{p}" for k, p in now["parts"].items() if partitions is None or k in partitions]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", folder).parquet(*paths).select(*schema.names)

    def times(self, bucket_type: str, bucket: str) -> dict[str, tuple[int, int]]:
        """(created, last updated), in milliseconds, of each partition."""
        return {k: tuple(v) for k, v in self._manifest(bucket_type, bucket)["times"].items()}

    def stage(self, df: DataFrame, bucket_type: str, bucket: str, partition_by: str | None = None) -> dict:
        """Writes a new version and gives its manifest; nothing is visible before `publish`."""
        version, folder = f"version={uuid.uuid4().hex}", self.folder(bucket_type, bucket)
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(f"{folder}/{version}")
        parts = {"": version}
        if partition_by:
            path, fs = self._fs(f"{folder}/{version}")
            found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
            parts = {n.partition("=")[2]: f"{version}/{n}" for n in found if "=" in n}
        return {"schema": df.schema.jsonValue(), "parts": parts}

    def publish(self, bucket_type: str, bucket: str, manifest: dict, after: int | None = None) -> None:
        """Makes a manifest the current one; Conflict if `after` (or what is current now) isn't any more."""
        folder = self.folder(bucket_type, bucket)
        versions = self._versions(folder)
        last = versions[-1] if versions else 0
        if after is not None and after != last:
            raise Conflict(f"conflict: {bucket_type}/{bucket} is at version {last}, not {after}")
        old = self._load(folder, last) if versions else None
        now, before = int(time.time() * 1000), (old or {}).get("times", {})
        same = {k for k, p in manifest["parts"].items() if old and old["parts"].get(k) == p}
        times = {k: before[k] if k in same and k in before else [before.get(k, [now])[0], now] for k in manifest["parts"]}
        path, fs = self._fs(f"{folder}/_manifests/new-{uuid.uuid4().hex}")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "version"} | {"times": times}).encode()))
        stream.close()
        self._rename(path, f"{folder}/_manifests/{last + 1}")
        dropped, held = versions[: 1 - KEPT], [manifest, *(self._load(folder, v) for v in versions[1 - KEPT :])]
        named = {p for m in held for p in m["parts"].values()}
        for v in dropped:
            for gone in set(self._load(folder, v)["parts"].values()) - named:
                fs.delete(self._fs(f"{folder}/{gone}")[0], True)
            fs.delete(self._fs(f"{folder}/_manifests/{v}")[0], True)

    def _rename(self, path, to: str) -> None:
        """Renames a file; Conflict if there is one of that name."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.isAbsolute() and path.toUri().getScheme() else jvm.java.net.URI("file:///"), self.spark._jsc.hadoopConfiguration())
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(path, self._fs(to)[0], options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"conflict: {to}") from error
            raise

    def overwrite(self, df: DataFrame, bucket_type: str, bucket: str, partition_by: str | None = None) -> None:
        self.publish(bucket_type, bucket, self.stage(df, bucket_type, bucket, partition_by))

    def replace_partitions(self, df: DataFrame, bucket_type: str, bucket: str, partition_by: str, touched: Sequence[str]) -> None:
        """The rows of `df` become all rows of the touched partitions; other partitions stay as they are."""
        old = self._manifest(bucket_type, bucket)
        new = self.stage(df, bucket_type, bucket, partition_by)
        kept = {k: p for k, p in old["parts"].items() if k not in touched}
        self.publish(bucket_type, bucket, {"schema": old["schema"], "parts": kept | new["parts"]}, old["version"])

    def drop(self, bucket_type: str, bucket: str) -> None:
        path, fs = self._fs(self.folder(bucket_type, bucket))
        fs.delete(path, True)

    # Documents, by key. Their tables have a hidden partition column, SLICE.

    def documents(self, bucket_type: str, bucket: str) -> DataFrame:
        return self.read(bucket_type, bucket).drop(SLICE)

    def _sliced(self, rows: DataFrame, key_col: str) -> DataFrame:
        return rows.withColumn(SLICE, F.pmod(string_hash(F.col(key_col).cast("string")), F.lit(self.slices)).cast("int"))

    def _slice(self, key: str) -> str:
        return str(string_hash_value(str(key)) % self.slices)

    def get(self, bucket_type: str, bucket: str, key: str, key_col: str = "key", **options) -> DataFrame:
        """The one row of a key, from its slice alone; NotFound without it."""
        opts = Options.validated("get", options)
        with telemetry(opts.telemetry_name or "get", bucket=bucket, key=key):
            row = self.read(bucket_type, bucket, [self._slice(key)]).drop(SLICE).where(F.col(key_col) == key).limit(1)
            if row.isEmpty():
                raise NotFound(f"not_found: {key}")
            return row

    def _changed(self, bucket_type: str, bucket: str, keys: DataFrame, key_col: str, rows: DataFrame | None) -> None:
        """Rewrites the slices of `keys`: their rows go, `rows` come."""
        now, sliced = self._manifest(bucket_type, bucket), self._sliced(keys.select(key_col), key_col)
        touched = [str(r[0]) for r in sliced.select(SLICE).distinct().collect()]  # at most as many as there are slices
        old = self.read(bucket_type, bucket, touched)
        new = old.join(keys.select(key_col), key_col, "left_anti")
        if rows is not None:
            new = new.unionByName(self._sliced(rows, key_col), allowMissingColumns=True)
        staged = self.stage(new.repartition(SLICE), bucket_type, bucket, SLICE)
        kept = {k: p for k, p in now["parts"].items() if k not in touched}
        self.publish(bucket_type, bucket, {"schema": new.schema.jsonValue(), "parts": kept | staged["parts"]}, now["version"])

    def put(self, bucket_type: str, bucket: str, rows: DataFrame, key_col: str = "key", order: Sequence[str] = (), **options) -> DataFrame | None:
        """Upserts by key; with return_body, the rows as they are stored.

        Of several rows of one key the last of `order` is stored; without an order they are refused.
        """
        opts = Options.validated("put", options)
        with telemetry(opts.telemetry_name or "put", bucket=bucket):
            if order:
                best = rows.groupBy(key_col).agg(F.max(F.struct(*order, F.struct(*rows.columns).alias("_row"))).alias("_best"))
                rows = best.select("_best._row.*")
            elif not rows.groupBy(key_col).count().where("count > 1").isEmpty():
                raise ValueError("badarg: several rows of one key, and no order")
            if self.exists(bucket_type, bucket):
                self._changed(bucket_type, bucket, rows, key_col, rows)
            else:
                self.overwrite(self._sliced(rows, key_col).repartition(SLICE), bucket_type, bucket, SLICE)
        return self.documents(bucket_type, bucket).join(rows.select(key_col), key_col, "left_semi") if opts.return_body else None

    def delete(self, bucket_type: str, bucket: str, keys: DataFrame, key_col: str = "key", **options) -> None:
        opts = Options.validated("delete", options)
        with telemetry(opts.telemetry_name or "delete", bucket=bucket):
            self._changed(bucket_type, bucket, keys, key_col, None)


def get_connection(spark: SparkSession | None = None) -> SparkSession:
    """The session in use."""
    found = spark or SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("no_connection")
    return found


def execute(fun, spark: SparkSession | None = None, **options):
    """Runs `fun` with the session."""
    opts = Options.validated("execute", options)
    with telemetry(opts.telemetry_name or "execute"):
        return fun(get_connection(spark))


def scratch_store(spark: SparkSession, **options) -> Store:
    """A store of its own below `spark.checkpoint.dir`, which goes when the driver ends. Without that setting it is a
    temporary folder, if this machine is all there is."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.gettempdir()
    store = Store(spark, f"{root}/docindex-store-{uuid.uuid4().hex}", **options)

    def clean() -> None:
        try:
            path, fs = store._fs(store.root)
            fs.delete(path, True)
        except Exception:  # the JVM may be gone first
            pass

    atexit.register(clean)
    return store


@dataclass
class Config:
    """Settings of the engine; those of a session begin with `spark.docindex.`."""

    bucket_slices: int = 16
    cache_entries: int = 100
    cache_ttl_s: float = 600
    cache: bool = False

    @classmethod
    def of(cls, spark: SparkSession, **given) -> Config:
        """What is given, else what the session has, else the defaults."""
        kinds = {"int": int, "float": float, "bool": lambda v: str(v).lower() == "true"}
        own = {k: spark.conf.get(f"spark.docindex.{k}", None) for k in cls.__dataclass_fields__}
        return cls(**{k: kinds[cls.__dataclass_fields__[k].type](v) for k, v in (own | given).items() if v is not None})

    def get(self, key: str):
        if key not in self.__dataclass_fields__:
            raise KeyError(f"badkey: {key}")
        return getattr(self, key)

    def set(self, key: str, value) -> None:
        self.get(key)
        setattr(self, key, value)

    def store(self, spark: SparkSession, root: str) -> Store:
        return Store(spark, root, Cache(self.cache_entries, self.cache_ttl_s) if self.cache else None, self.bucket_slices)
