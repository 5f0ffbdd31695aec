"""Shared storage and Arrow helpers for the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


class _Given(threading.local):
    """Paths that scratch() has given out in this thread, so that no other thread's work is released."""

    def __init__(self):
        self.paths: list[str] = []


_given = _Given()
_tidying, _lock = [0, None], threading.Lock()
#: Spark's switch: an execution's shuffle files go when it ends, not when the driver's JVM happens to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the session is local (tests) a temporary folder
    of our own is used; on a cluster an unset one is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        # with its file system's name, as executors open files there themselves
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        made = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own[app] = f"file://{made}"
    return _own[app]


def unique() -> str:
    return uuid.uuid4().hex


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_root(spark)}/{name}-{unique()}"
    _given.paths.append(path)
    return path


def own(path: str) -> None:
    """Let release() delete a path too."""
    _given.paths.append(path)


def mark() -> int:
    """A point in time for release()."""
    return len(_given.paths)


def release(spark: SparkSession, since: int) -> None:
    """Delete every path that scratch() has given out in this thread since a mark. Results that read them must be written before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_given.paths) > since:
        path = jvm.org.apache.hadoop.fs.Path(_given.paths.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def workspace(spark: SparkSession):
    """What operators leave in the shared folder goes at the end of the block; write results that read it inside."""
    since = mark()
    try:
        yield
    finally:
        release(spark, since)


@contextmanager
def _tidy(spark: SparkSession):
    """Executions begun inside delete their shuffle files at their end; the session's own setting is put back."""
    with _lock:
        if not _tidying[0]:
            _tidying[1] = spark.conf.get(CLEANUP, None)
        _tidying[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _tidying[0] -= 1
            if not _tidying[0]:
                spark.conf.unset(CLEANUP) if _tidying[1] is None else spark.conf.set(CLEANUP, _tidying[1])


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, a lost executor takes nothing with it, and the shuffle files of the steps before go."""
    path = scratch(df.sparkSession, name)
    with _tidy(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last(df: DataFrame, name: str, since: int) -> DataFrame:
    """stored() for a result: what scratch() has given out since a mark, which nothing else may read, is deleted."""
    kept = stored(df, name)
    path = _given.paths.pop()
    release(df.sparkSession, since)
    own(path)
    return kept


def filesystem(uri: str):
    """(pyarrow file system, path in it) for a URI that executors open themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def task_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def slices(batches, rows: int = 2000):
    """The same rows in record batches of at most `rows`, so that a task's own arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of length n + 1 from 0, bytes) of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    return at - at[0], np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)


def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one byte array cut at offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.uint8))])
