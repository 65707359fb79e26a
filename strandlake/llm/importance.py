"""Importance resampling: documents drawn by how much likelier they are under the target's n-gram model than under the corpus's.

Words and word pairs are hashed into buckets; a bag-of-buckets model of the whole corpus and one of the target rows (clean rows of good
quality, at most some ``TARGET_ROWS`` of them) give each document the logarithm of its importance weight. Adding Gumbel noise and taking
the k largest sums draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import kernel
from strandlake.llm.store import small_batches, written

BUCKETS = 10_000
TARGET_ROWS = 20_000
SEED = 1
#: Keys that may come to the driver to find where the k-th largest lies.
FEW = 10_000


def buckets(w: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and pairs, text by text, and of each text its first and the end."""
    one = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
    two = (kernel.grams(w.hash, 2) % np.uint64(BUCKETS)).astype(np.int64)
    n = len(one)
    both = np.full(2 * n, -1, dtype=np.int64)
    both[::2] = one
    both[1 : 2 * len(two) : 2] = two
    last = w.first[1:][np.diff(w.first) > 0] - 1
    both[2 * last + 1] = -1  # a pair reaches into the next text
    keep = both >= 0
    at = np.concatenate([[0], np.cumsum(keep)])[2 * w.first]
    return both[keep], at[:-1], at[1:]


def _counts(ids):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = ids.value
        raw, own = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            found, lo, hi = buckets(kernel.words(b.column(1), kernel.ALNUM))
            raw += np.bincount(found, minlength=BUCKETS)
            doc = b.column(0).cast(pa.string()).to_pylist()
            for i in [i for i, d in enumerate(doc) if d in target]:
                own += np.bincount(found[lo[i] : hi[i]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(own)], ["bucket", "raw", "target"])

    return run


def _weights(ratio):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ratio.value
        for b in batches:
            found, lo, hi = buckets(kernel.words(b.column(1), kernel.ALNUM))
            total = np.zeros(b.num_rows)
            some = np.flatnonzero(hi > lo)
            if len(some):
                total[some] = np.add.reduceat(of[found], lo[some])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, mask=hi <= lo)], ["id", "log_weight"])

    return run


def _threshold(keys: DataFrame, k: int) -> float:
    """The k-th largest of column ``key``: narrowed down by histograms, so that no sort and no more than FEW values leave the executors."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        inside = keys.where(F.col("key").between(lo, hi))
        if lo == hi:
            return lo
        place = F.least(F.lit(4095), F.floor((F.col("key") - lo) / (hi - lo) * 4096)).alias("place")
        rows = sorted(inside.groupBy(place).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), reverse=True)
        for r in rows:
            if r.n >= k:
                break
            k -= r.n
        lo, hi = r.lo, r.hi
        if r.n <= FEW:
            return sorted((x[0] for x in inside.where(F.col("key").between(lo, hi)).select("key").collect()), reverse=True)[k - 1]


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, target: str = "quality = 1 and coalesce(toxic, 0) = 0", id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, log_weight, gumbel_key and selected (among the ``share`` with the largest keys; equal keys at the cut all are).

    Target rows are those of ``labels`` for which ``target`` holds. Noise is a hash of the id, so a run repeats itself. A text without words
    (or null) has null weight and key and isn't selected; without target rows the weights are those of an even model. Ids may be null or
    repeat; an empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    good = labels.where(target).select(F.col(label_id).cast("string").alias("id")).where("id is not null")
    chance = min(1.0, TARGET_ROWS / max(1, good.count()))
    picked = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < F.lit(int(chance * (1 << 31))))
    ids = spark.sparkContext.broadcast({r[0] for r in picked.distinct().collect()})  # some TARGET_ROWS ids
    counted = texts.mapInArrow(_counts(ids), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, own = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counted["bucket"]], own[counted["bucket"]] = counted["raw"], counted["target"]
    ratio = np.log((own + 1) / (own.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    kind = texts.schema["id"].dataType.simpleString()
    scored = texts.mapInArrow(_weights(spark.sparkContext.broadcast(ratio)), f"id {kind}, log_weight double")
    even = (F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = written(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(even))), "importance")
    n = scored.where("key is not null").count()
    cut = _threshold(scored.where("key is not null"), max(1, int(np.ceil(share * n)))) if n else float("inf")
    return scored.select(F.col("id").alias(id_col), "log_weight", F.col("key").alias("gumbel_key"), F.coalesce(F.col("key") >= cut, F.lit(False)).alias("selected"))
