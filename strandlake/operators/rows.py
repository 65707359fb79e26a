"""What operators on whole reads share: reads in Arrow batches, one row a read, and global order without a single task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Complement of A, C, G, T and N; any other byte reads A.
COMPLEMENT = np.full(256, ord("A"), dtype=np.uint8)
COMPLEMENT[list(b"ACGTN")] = list(b"TGCAN")
#: Rows of a batch that is given out.
ROWS = 1 << 14
#: Rows and bytes of an Arrow batch handed to Python, whatever the size of a partition.
BATCH_ROWS = 4096
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes as well as by rows: a worker's memory doesn't grow with the partitions.

    The settings stay, as a result that is not yet computed reads them when it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)


def back(seq: np.ndarray) -> np.ndarray:
    """The reverse complement."""
    return COMPLEMENT[seq][::-1]


def numbers(column: pa.Array, i: int, kind: type = np.float64) -> np.ndarray | None:
    """The i-th array of a column; null where it is null."""
    v = column[i]
    return v.values.to_numpy(zero_copy_only=False).astype(kind, copy=False) if v.is_valid else None


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all arrays (or bytes of all texts) of a column in a row, and where each begins, with the end."""
    if pa.types.is_list(column.type):
        at = column.offsets.to_numpy()
        return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at.astype(np.int64) - at[0]
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def cut(b: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some ``most`` values or letters of a column each, or one longer row."""
    at, i = flat(b.column(column))[1], 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield b.slice(i, j - i)
        i = j


def by_read(rows: DataFrame, f: Callable[[pa.RecordBatch, int], dict[str, pa.Array | np.ndarray] | None], schema: str) -> DataFrame:
    """What ``f`` makes of each row (columns of equal length, or nothing), some thousand rows a batch; ``read_id`` is put in front."""
    kind = rows.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, made, count = [], [], 0
            ids = b.column("read_id")
            for i in range(b.num_rows):
                out = f(b, i)
                if out is not None and (n := len(next(iter(out.values())))):
                    place += [i] * n
                    made.append({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})
                    count += n
                if made and (count >= ROWS or i + 1 == b.num_rows):
                    cols = [pa.concat_arrays([m[k] for m in made]) for k in made[0]]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(place)), *cols], ["read_id", *made[0]])
                    place, made, count = [], [], 0

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"read_id {kind}, {schema}")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a local folder is made, but only for a local master: executors elsewhere could not read it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def held(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once to the shared folder and read again: every later job sees the same ones, whatever executors are lost."""
    path = f"{shared_dir(rows.sparkSession)}/strandlake/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    _paths[out] = path
    return out


#: Where tables of ``held`` lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def dropped(*tables: DataFrame) -> None:
    """Remove tables of ``held`` that no later job reads."""
    for t in tables:
        if path := _paths.pop(t, None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of a row's place within its partition in Spark's increasing ids.
_PLACE_BITS = 33


def _running(weight: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            before = total + np.cumsum(b.column(weight).to_numpy()) - b.column(weight).to_numpy()
            total += int(b.column(weight).to_numpy().sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before)], [*b.schema.names, "_before"])

    return run


def ranged(rows: DataFrame, *order: str, weight: str | None = None) -> DataFrame:
    """``rows`` in ranges of ``order``, sorted and held: with ``_part``, ``_place`` (from 0 in its part) and ``_before``, the rows (or the sum of
    ``weight``, whole numbers) before it in its part.

    One shuffle. What a row's range is has been written with it, so ranks and sums by range speak of the same ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    if weight:
        parts = parts.mapInArrow(_running(weight), T.StructType([*parts.schema.fields, T.StructField("_before", T.LongType())]))
    out = held(parts.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    out = out.withColumns({"_part": F.shiftright("_at", _PLACE_BITS), "_place": place}).drop("_at")
    return out if weight else out.withColumn("_before", F.col("_place"))


def totals(parts: DataFrame, weight: str | None = None) -> DataFrame:
    """(_part, _earlier, _all) of ranged rows: what all earlier parts hold, and what all hold together. One row a part."""
    order = Window.orderBy("_part")
    n = parts.groupBy("_part").agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.select("_part", earlier.alias("_earlier"), F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))


def numbered(rows: DataFrame, *order: str, name: str = "ordinal", weight: str | None = None) -> DataFrame:
    """Column ``name``: how many rows (or how much of ``weight``) come before in the order of ``order``; equal rows in any order, each with a number of its own.

    Evaluated again, the result is the same: the rows are held as they were first ranged.
    """
    parts = ranged(rows, *order, weight=weight)
    out = parts.join(F.broadcast(totals(parts, weight)), "_part")
    return out.select(*rows.columns, (F.col("_earlier") + F.col("_before")).cast("long").alias(name))


def order_statistic(values: DataFrame, column: str, k: int, few: int = 10_000) -> float:
    """The k-th smallest value (from 0; null and not-a-number are none), narrowed down by histograms: no sort, and at most ``few`` values leave the executors.

    Infinite values are counted apart, as no histogram holds them.
    """
    value = F.col(column).cast("double")
    values = values.where(value.isNotNull() & ~F.isnan(value)).select(value.alias("v"))
    infinite = float("inf")
    low, high, n = values.agg(F.count_if(F.col("v") == -infinite), F.count_if(F.col("v") == infinite), F.count("*")).first()
    if not 0 <= k < n:
        raise IndexError(f"no value at {k} of {n}")
    if k < low or k >= n - high:
        return -infinite if k < low else infinite
    values, k = values.where(F.abs("v") != infinite), k - low
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    while lo < hi:
        inside = values.where(F.col("v").between(lo, hi))
        half = 0.5 if hi - lo == infinite else 1.0  # the difference of two doubles may be none
        share = (F.col("v") * half - lo * half) / (hi * half - lo * half)
        place = F.least(F.lit(4095), F.floor(share * 4096)).alias("place")
        for r in sorted(inside.groupBy(place).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()):
            if k < r.n:
                break
            k -= r.n
        lo, hi = r.lo, r.hi
        if r.n <= few:
            return sorted(x[0] for x in inside.where(F.col("v").between(lo, hi)).collect())[k]
    return lo


def quantile(values: DataFrame, column: str, q: float) -> float | None:
    """Exact, with linear interpolation between neighbours; null and not-a-number don't count, and nothing gives None.

    Between an infinite value and another one lies that infinite value; between the two infinite ones, not-a-number.
    """
    known = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(column)
    n = known.count()
    if not n:
        return None
    place = (n - 1) * q
    low = order_statistic(known, column, int(place))
    if place == int(place):
        return low
    high = order_statistic(known, column, int(place) + 1)
    return low if low == high else low + (high - low) * (place - int(place))
