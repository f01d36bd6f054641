"""What the operators of this subpackage share: scratch tables, row identity, text columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, `[\x20\x09-\x0D]`; Java's `\s` is the same set.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; where that is unset, one of our own, if this machine is all there is."""
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="docindex-")
    return _own_dir


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder written by `scratch`."""
    path, fs = _path(spark, at)
    fs.delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    at = f"{shared_dir(spark)}/docindex-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            remove(spark, at)
        except Exception:  # the JVM may be gone first
            pass

    atexit.register(clean)
    return at


#: Spark then deletes the shuffles of an execution when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it again: no lineage, no recomputation, no shuffle left."""
    spark, at = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(at)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(at)
    table._scratch = at
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table made by `cut` that nothing reads any more."""
    if at := getattr(table, "_scratch", None):
        remove(table.sparkSession, at)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 64 << 20) -> None:
    """Arrow batches of texts hold at most `rows` rows and about `size` bytes, so that long documents don't add up.

    Spark reads these settings when a plan runs, so they stay as they are set, unless the session's are smaller.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if not (now or "").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine: Spark keeps workers, with all they ever held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for each row, not once for each use."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
