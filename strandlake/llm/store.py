"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch handed to Python; long texts make small batches.
BATCH_ROWS = 4096
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a local folder is made, but only for a local master: executors elsewhere could not read it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Folders that tables go to at present; the last one counts.
_folders: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


def table_path(spark: SparkSession, name: str) -> str:
    folder = _folders.get()[-1] if _folders.get() else f"{shared_dir(spark)}/strandlake"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here and survives lost executors."""
    path = path or table_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Where tables that are still in use lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def delete(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that no later job reads."""
    for t in tables:
        if path := _paths.pop(t, None):
            _remove(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go to a folder of their own, which goes at the end: have all that is to stay written to a path outside."""
    at = table_path(spark, "scratch")
    token = _folders.set((*_folders.get(), at))
    try:
        yield
    finally:
        _folders.reset(token)
        _remove(spark, at)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes as well as by rows, so that long texts don't pile up in one batch.

    The settings stay, as a result that is not yet computed reads them when it is.
    """
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """``small_batches`` while an operator runs its jobs; the session's own settings come back. For operators whose result no Arrow function makes any more."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = [spark.conf.get(n) for n in names]
    small_batches(spark)
    try:
        yield
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


#: What a Python worker keeps for its next tasks: one operator's encoder, counter or finder at a time.
_held: dict[str, object] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def let_go() -> None:
    """Give back the memory that a worker's earlier tasks, of other operators, left behind."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def held(name: str, make: Callable[[], Any]) -> Any:  # noqa: ANN401
    """The worker's object of this name; another operator's goes before it is made."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]
