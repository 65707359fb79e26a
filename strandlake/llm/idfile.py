"""Token-id files of bit-plane shuffled blocks.

A file set is a Parquet folder of segments in ascending id order. A segment holds whole documents; its ids are
cut into blocks of a fixed size, each block is transposed into byte planes (or bit planes) and each plane is compressed
with zstandard by itself. ``plane_sizes`` is the chunk index: with it any plane of any block can be found in ``payload``.
Parquet carries the segments, so that Spark's committers and any store that Spark reaches serve for them; reading
the index alone leaves the payload column on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.store import small_batches
from strandlake.llm.tokens import encoder

END_ID = 2
BLOCK_IDS = 1 << 16
#: A segment ends with the document that makes it this long.
SEGMENT_IDS = 1 << 20
LEVEL = 3
PLANES = {"byte": 4, "bit": 32}


def shuffle_block(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """The planes of a block of uint32 ids: byte i (or bit i) of every id together."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def restore_block(found: list[bytes], n: int, planes: str = "byte") -> np.ndarray:
    if planes == "byte":
        octets = np.stack([np.frombuffer(p, dtype=np.uint8) for p in found], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in found], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


def encode_segment(ids: np.ndarray, planes: str = "byte", block_ids: int = BLOCK_IDS) -> tuple[list[int], bytes]:
    """Sizes of all compressed planes, block by block, and the planes themselves."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    parts = [press.compress(p) for lo in range(0, len(ids), block_ids) for p in shuffle_block(ids[lo : lo + block_ids], planes)]
    return [len(p) for p in parts], b"".join(parts)


def decode_segment(sizes: list[int], payload: bytes, n: int, planes: str = "byte", block_ids: int = BLOCK_IDS) -> np.ndarray:
    loosen, width = zstandard.ZstdDecompressor(), PLANES[planes]
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    view, blocks = memoryview(payload), []
    for k, lo in enumerate(range(0, n, block_ids)):
        found = [loosen.decompress(view[at[i] : at[i + 1]]) for i in range(k * width, (k + 1) * width)]
        blocks.append(restore_block(found, min(block_ids, n - lo), planes))
    return np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)


_SEGMENT = "shard int, segment int, start long, n_ids long, doc_ids array<{0}>, lengths array<long>, planes string, block_ids int, plane_sizes array<int>, payload binary"


def _segments(path: str, end_id: int | None, planes: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        n = 0
        kind = None

        def flush() -> pa.RecordBatch:
            plane_sizes, payload = encode_segment(np.concatenate(held), planes, block_ids)
            row = [(shard, pa.int32()), (segment, pa.int32()), (start, pa.int64()), (n, pa.int64()), (docs, pa.list_(kind)), (sizes, pa.list_(pa.int64())), (planes, pa.string()), (block_ids, pa.int32()), (plane_sizes, pa.list_(pa.int32())), (payload, pa.binary())]
            names = ["shard", "segment", "start", "n_ids", "doc_ids", "lengths", "planes", "block_ids", "plane_sizes", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names)

        for b in batches:
            kind = b.column(0).type
            ids, at = encoder(path).encode(b.column(1), end_id)
            for doc, lo, hi in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                docs.append(doc)
                sizes.append(hi - lo)
                held.append(ids[lo:hi])
                n += hi - lo
                if n >= SEGMENT_IDS:
                    yield flush()
                    segment, start, n = segment + 1, start + n, 0
                    docs, sizes, held = [], [], []
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, planes: str = "byte", block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the ids to ``path`` in ascending order of ``id_col``.

    Null texts are empty (``end_id`` alone), null ids come first, rows that repeat an id are in the order of their texts' hashes.
    An empty table writes an empty file set; other columns play no part.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_segments(tokenizer, end_id, planes, block_ids), _SEGMENT.format(texts.schema["doc_id"].dataType.simpleString())).write.mode("overwrite").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(b.num_rows):
            one = b.slice(row, 1)
            n, sizes = one["n_ids"][0].as_py(), one["lengths"].flatten()
            ids = decode_segment(one["plane_sizes"].flatten().to_pylist(), one["payload"][0].as_py(), n, one["planes"][0].as_py(), one["block_ids"][0].as_py())
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
            begins = ends - sizes.to_numpy(zero_copy_only=False)
            raw = ids.astype("<u4").tobytes()
            texts = pa.array([raw[4 * lo : 4 * hi] for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([one["doc_ids"].flatten(), pa.array(begins + one["start"][0].as_py()), sizes, texts], ["doc_id", "start", "n_tokens", "ids"])


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of a file set: id, start (ids of all documents before it), n_tokens and ids (binary, little-endian uint32)."""
    segments = spark.read.parquet(path)
    # One row a shard, and shards are the writer's partitions: a few bytes each.
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = segments.join(F.broadcast(totals.select("shard", before.alias("before"))), "shard").withColumn("start", F.col("start") + F.col("before"))
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    out = placed.select("n_ids", "start", "doc_ids", "lengths", "planes", "block_ids", "plane_sizes", "payload").mapInArrow(_documents, f"doc_id {kind}, start long, n_tokens long, ids binary")
    return out.withColumnRenamed("doc_id", id_col)
