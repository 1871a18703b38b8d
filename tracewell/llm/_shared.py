"""Shared-folder staging: the only place where operators of this subpackage leave intermediate data."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Removes the shuffle files of a statement when it ends, so that those of a long operator don't add up.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes that a task gathers before it writes a row group of a staged table.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if sc.applicationId not in _OWN:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
    return _OWN[sc.applicationId]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tracewell/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the JVM may already be gone at exit; the folder is temporary either way
        pass


def make_dirs(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Texts cross to Python in batches of at most so many rows and bytes (the session's own limits, where they are smaller), so
    that executors hold little besides one batch a task."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, rows):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors. What the statement
    shuffled is removed when the table is written."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in staged:
        _remove(df.sparkSession, df._staged_at)


#: What workers remember between tasks of one operator: name -> function that forgets it.
HELD: dict[str, Callable[[], None]] = {}


def tidied(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: str | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, before which a worker forgets what other operators (but `holds`) remember, and after which it gives free memory back."""

    def with_release(batches):
        for name, forget in HELD.items():
            if name != holds:
                forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return with_release


def open_filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works for local, HDFS and object-store folders."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
