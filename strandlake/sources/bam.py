"""BAM files: a Python data source that reads and writes BGZF in tasks.

    reads = bam.reads(spark, "/data/*.bam")
    reads.write.format("bam").option("contigs", "c1:1000,c2:500").mode("append").save("/out")

A path is a file, a folder of .bam files or a pattern, on any store that pyarrow knows; one without a file is an error. ``read_id`` numbers a
file's reads in file order, the file's place in the upper bits. A file that is cut off, or whose blocks don't match their checksums, is an error.
Pulse signals are codes of 0 to 255: those stored as raw frames (B:S) are encoded as they are read. Cigars of more than 65,535 operations
go to and come from tag CG.

``reads`` takes files apart into ranges of bytes, each a task's work. A task looks for the first block that begins in its range, and in it for
a record that others follow without a gap; it takes all records that begin in its range's blocks. A first pass counts each range's records, for
the numbers, and sees to it that each range begins where the one before has ended: where a guess was wrong, the job ends with an error.
``spark.read.format("bam")`` by itself reads a file in one task.

A task writes one file. It lies in a temporary folder until the whole job has ended, so a task that runs twice leaves its reads once.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandlake.operators.rows import held
from strandlake.sources import paths
from strandlake.sources.bam_decode import BASES, CIGAR, MOST_OPS, SCHEMA, decoded, likely_heads

#: Bytes of a range, of records decoded at once, and of unpacked data that is searched at once for a record.
SPLIT_BYTES, BATCH_BYTES, SEARCH_BYTES = 32 << 20, 4 << 20, 1 << 18
#: Ranges of all files at most; larger files have larger ranges.
MOST_RANGES = 200_000
#: Records that must follow one another for the first of them to be taken as one.
CHAIN = 4
#: Beyond the last block of any file.
FILE_END = 1 << 46
_LARGEST_BLOCK = 1 << 16
_MAGIC = b"\x1f\x8b\x08\x04"


def _exactly(f, n: int) -> bytes:  # noqa: ANN001
    out = f.read(n)
    if len(out) != n:
        raise ValueError("BAM file is cut off within a block")
    return out


def _block(f) -> tuple[int, bytes] | None:  # noqa: ANN001
    """Size and contents of the BGZF block that begins here; none at the file's end."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or head[:4] != _MAGIC:
        raise ValueError("no BGZF block")
    extra, at, size = _exactly(f, struct.unpack_from("<H", head, 10)[0]), 0, None
    while at + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC" and n == 2:
            size = struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    if size is None or size < 20 + len(extra):
        raise ValueError("BGZF block without its size")
    body = _exactly(f, size - 12 - len(extra))
    data = zlib.decompress(body[:-8], -15)
    if struct.unpack("<II", body[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("BGZF block does not match its checksum")
    return size, data


def _blocks_from(f, at: int) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """Place and contents of the BGZF blocks from one on. The file's last one must be empty, as that marks the end."""
    f.seek(at)
    data = None
    while (found := _block(f)) is not None:
        size, data = found
        yield at, data
        at += size
    if data != b"":
        raise ValueError("BAM file is cut off: no end block")


def find_block(f, at: int, size: int) -> int:  # noqa: ANN001
    """Where the first BGZF block at or after a place begins; the file's size if there is none."""
    f.seek(at)
    data = f.read(2 * _LARGEST_BLOCK)
    p = data.find(_MAGIC)
    while p >= 0:
        f.seek(at + p)
        try:
            _block(f)
        except (ValueError, zlib.error, struct.error):
            p = data.find(_MAGIC, p + 1)
            continue
        return at + p
    if at + len(data) < size:
        raise ValueError(f"no BGZF block within {len(data)} bytes from byte {at}")
    return size


class _Stream:
    """Unpacked data from a block on, with what is needed of it held, and the block in which each byte lies."""

    def __init__(self, f, at: int) -> None:  # noqa: ANN001
        self.blocks, self.data, self.ended = _blocks_from(f, at), bytearray(), False
        self.gone = 0  # bytes that were dropped
        self.begins: list[int] = []  # of blocks with data, counted from the first byte of all
        self.places: list[int] = []

    def fill(self, n: int) -> bool:
        """Hold n bytes, if there are as many."""
        while len(self.data) < n and not self.ended:
            found = next(self.blocks, None)
            if found is None:
                self.ended = True
            elif found[1]:
                self.begins.append(self.gone + len(self.data))
                self.places.append(found[0])
                self.data += found[1]
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.gone += n
        old = bisect.bisect_right(self.begins, self.gone) - 1
        if old > 0:
            del self.begins[:old], self.places[:old]

    def place(self, at: int = 0) -> tuple[int, int]:
        """Block, and place in it, of a held byte (or of the one that comes next)."""
        if not self.fill(at + 1):
            return FILE_END, 0
        i = bisect.bisect_right(self.begins, self.gone + at) - 1
        return self.places[i], self.gone + at - self.begins[i]

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("BAM file is cut off within a record")
        out = bytes(self.data[:n])
        self.drop(n)
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _header(s: _Stream) -> list[str]:
    """Contig names; the stream is at the first record then."""
    if s.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    s.take(s.number())
    names = []
    for _ in range(s.number()):
        names.append(s.take(s.number())[:-1].decode())
        s.number()
    return names


def _follow(s: _Stream, at: int, n_refs: int) -> bool:
    """Whether CHAIN records, or all to the file's end, follow one another from a held place on."""
    for _ in range(CHAIN):
        if not s.fill(at + 4):
            return len(s.data) == at
        size = struct.unpack_from("<i", s.data, at)[0]
        if size < 33 or (s.fill(at + 36) and not any(p == 0 for p in likely_heads(bytes(s.data[at : at + 37 + 255]) + b"\0" * 40, n_refs))):
            return False
        if not s.fill(at + 4 + size):
            return False
        at += 4 + size
    return True


def _find_record(s: _Stream, end: int, n_refs: int) -> bool:
    """Bring the stream to the first record that begins in a block before ``end``, if there is one."""
    while s.place()[0] < end:
        s.fill(SEARCH_BYTES + 300)
        for p in likely_heads(bytes(s.data[: SEARCH_BYTES + 300]), n_refs):
            if p >= SEARCH_BYTES or s.place(p)[0] >= end:
                break
            if _follow(s, p, n_refs):
                s.drop(p)
                return True
        s.drop(min(SEARCH_BYTES, len(s.data)))
    return False


def _range_of(f, lo: int, end: int, size: int) -> tuple[_Stream, list[str], bool]:  # noqa: ANN001
    """A stream at the first record that begins in blocks of a range, the contigs, and whether there is one."""
    s = _Stream(f, 0)
    names = _header(s)
    if lo <= s.place()[0]:
        return s, names, s.place()[0] < end
    at = find_block(f, lo, size)
    if at >= end:
        return s, names, False
    s = _Stream(f, at)
    return s, names, _find_record(s, end, len(names))


def _records(s: _Stream, end: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Bytes of some records, and where each begins (after its length field) and its size; records begin in blocks before ``end``."""
    parts, sizes, held_bytes = [], [], 0
    while s.place()[0] < end:
        n = s.number()
        if n < 32:
            raise ValueError("a record is too short")
        parts.append(s.take(n))
        sizes.append(n)
        held_bytes += n
        if held_bytes >= BATCH_BYTES:
            size = np.array(sizes, dtype=np.int64)
            yield b"".join(parts), np.cumsum(size) - size, size
            parts, sizes, held_bytes = [], [], 0
    if parts:
        size = np.array(sizes, dtype=np.int64)
        yield b"".join(parts), np.cumsum(size) - size, size


def read_file(f, first: int = 0, lo: int = 0, end: int = FILE_END, size: int = FILE_END) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Batches of the reads of a file, or of a range of its bytes, numbered from ``first`` on."""
    s, names, some = _range_of(f, lo, end, size)
    if some:
        for data, start, n in _records(s, end):
            yield decoded(data, start, n, names, first + np.arange(len(start)))
            first += len(start)
    elif lo == 0:
        s.fill(1)  # without a record, too, the file must have its end


def count_range(f, lo: int, end: int, size: int) -> tuple[int, int, int]:  # noqa: ANN001
    """Records that begin in a range, and the places (block and byte in it, as one number) of the first of them and of the one after the last."""
    s, _, some = _range_of(f, lo, end, size)
    if not some:
        return 0, 0, 0
    at = lambda: s.place()[0] << 16 | s.place()[1]
    first, n = at(), 0
    while s.place()[0] < end:
        left = s.number()
        n += 1
        while left:  # a long record is not held whole
            if not s.fill(1):
                raise ValueError("BAM file is cut off within a record")
            part = min(left, len(s.data))
            s.drop(part)
            left -= part
    return n, first, at()


def reads(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All reads of some files, in ranges of some ``split_bytes``, numbered in file order whatever the ranges are.

    Files are read twice: the first pass, which runs at once, counts. Its one row a range goes along with every task, MOST_RANGES at most.
    """
    spark.dataSource.register(BamSource)
    store = paths.store_of(path)[0]
    total = sum(i.size for i in store.get_file_info(files(path)))
    source = lambda mode: spark.read.format("bam").option("splitBytes", max(split_bytes, total // MOST_RANGES + 1)).option("mode", mode).load(path)
    counts = held(source("count"), "bam-ranges")
    own = Window.partitionBy("file").orderBy("lo")
    seen = counts.where("reads > 0")
    earlier = F.coalesce(F.sum("reads").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.lag("next_at").over(own) != F.col("first_at")
    broken = F.raise_error(F.concat(F.lit("records don't join at byte "), F.shiftright("first_at", 16).cast("string"))).cast("long")
    starts = seen.select("file", "lo", F.when(F.coalesce(gap, F.lit(False)), broken).otherwise(F.shiftleft(F.col("file").cast("long"), 40) + earlier).alias("_start"))
    rows = source("ranges").join(F.broadcast(starts), ["file", "lo"])
    return rows.withColumn("read_id", F.col("_start") + F.col("read_id")).drop("file", "lo", "_start")


def files(path: str) -> list[str]:
    """Paths, as the path's file system knows them, of all BAM files that it names, in order."""
    return paths.files(path, (".bam",), "BAM")


def write(rows: DataFrame, path: str, contigs: str, mode: str = "append", parts: int | None = None) -> None:
    """Write reads in the order of ``read_id``: files hold ranges of it, their names are in its order, and each is sorted."""
    rows.sparkSession.dataSource.register(BamSource)
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "read_id").sortWithinPartitions("read_id").drop("read_id")
    ordered.write.format("bam").option("contigs", contigs).mode(mode).save(path)


class BamSource(DataSource):
    """Option ``splitBytes``: size of ranges. ``mode``: ``files`` (the default: a file a task), or what ``reads`` asks for: ``count`` and ``ranges``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        mode = self.options.get("mode", "files")
        return {"files": SCHEMA, "ranges": f"file int, lo long, {SCHEMA}", "count": "file int, lo long, reads long, first_at long, next_at long"}[mode]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return BamWriter(self.options, overwrite)


class BamReader(DataSourceReader):
    def __init__(self, options) -> None:  # noqa: ANN001
        self.path, self.mode, self.split = options["path"], options.get("mode", "files"), int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        found = files(self.path)
        sized = list(enumerate((p, i.size) for p, i in zip(found, paths.store_of(self.path)[0].get_file_info(found), strict=True)))
        if self.mode == "files":
            return [InputPartition((i, p, 0, n, n)) for i, (p, n) in sized]
        return [InputPartition((i, p, lo, min(n, lo + self.split), n)) for i, (p, n) in sized for lo in range(0, max(1, n), self.split)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        i, path, lo, hi, size = partition.value
        end = FILE_END if hi >= size else hi
        with paths.store_of(self.path)[0].open_input_file(path) as f:
            if self.mode == "count":
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([v], pa.int64()) for v in (lo, *count_range(f, lo, end, size)))], ["file", "lo", "reads", "first_at", "next_at"])
                return
            for b in read_file(f, i << 40 if self.mode == "files" else 0, lo, end, size):
                if self.mode == "ranges":
                    n = b.num_rows
                    b = pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, lo, np.int64)), *b.columns], ["file", "lo", *b.schema.names])
                yield b


@dataclass
class Written(WriterCommitMessage):
    name: str


class BamWriter(DataSourceWriter):
    """Files of a job's tasks. Option ``contigs`` lists all contigs as name:length, comma-separated; a read of another one is an error."""

    def __init__(self, options, overwrite: bool) -> None:  # noqa: ANN001
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        pairs = [c.rpartition(":") for c in options.get("contigs", "").split(",") if c]
        self.contigs = [(name, int(size)) for name, _, size in pairs]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, at = paths.store_of(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bam"
        store.create_dir(f"{at}/_temporary-{self.job}", recursive=True)
        with store.open_output_stream(f"{at}/_temporary-{self.job}/{name}", compression=None) as f:
            write_file((_defaults(r.asDict()) for r in iterator), f, self.contigs)
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = paths.store_of(self.path)
        store.create_dir(at, recursive=True)
        old = files(self.path) if self.overwrite and _has_files(self.path) else []
        for m in messages:
            store.move(f"{at}/_temporary-{self.job}/{m.name}", f"{at}/{m.name}")
        for path in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, at = paths.store_of(self.path)
        if store.get_file_info(f"{at}/_temporary-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_temporary-{self.job}")


def _has_files(path: str) -> bool:
    try:
        return bool(files(path))
    except FileNotFoundError:
        return False


def _defaults(row: dict) -> dict:
    """A row with what a read without an alignment has, where columns are missing or null."""
    given = {k: v for k, v in row.items() if v is not None}
    return {"flag": 4, "rname": "*", "pos": -1, "mapq": 0, "cigar": "*", "seq": ""} | given


def encode_record(row: dict, ref: int) -> bytes:
    name = row["qname"].encode() + b"\0"
    ops = [] if row["cigar"] == "*" else _cigar(row["cigar"])
    codes = _BASE_CODE[np.frombuffer(row["seq"].encode("latin-1", "replace"), dtype=np.uint8)]
    if (codes > 15).any():
        raise ValueError(f"no base: {row['seq'][int(np.argmax(codes > 15))]}")
    codes = np.append(codes, np.zeros(len(codes) % 2, np.uint8))
    packed = (codes[::2] << 4 | codes[1::2]).tobytes()
    qual = bytes(row["qual"]) if row.get("qual") is not None else b"\xff" * len(row["seq"])
    tags, kept = b"", ops
    if len(ops) > MOST_OPS:
        tags = b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *ops)
        ops = [len(row["seq"]) << 4 | CIGAR.index("S"), sum(o >> 4 for o in kept if CIGAR[o & 15] in "MDN=X") << 4 | CIGAR.index("N")]
    for t in ("fi", "ri", "fp", "rp"):
        if row.get(t) is not None:
            wide = max(row[t], default=0) > 255
            tags += t.encode() + (b"BS" if wide else b"BC") + struct.pack(f"<I{len(row[t])}{'H' if wide else 'B'}", len(row[t]), *row[t])
    tags += b"".join(t.encode() + b"i" + struct.pack("<i", row[t]) for t in ("fn", "rn") if row.get(t) is not None)
    tags += b"ecf" + struct.pack("<f", row["ec"]) if row.get("ec") is not None else b""
    tags += b"MMZ" + row["mm"].encode() + b"\0" if row.get("mm") is not None else b""
    tags += b"MLBC" + struct.pack(f"<I{len(row['ml'])}B", len(row["ml"]), *row["ml"]) if row.get("ml") is not None else b""
    tags += b"ZPBf" + struct.pack(f"<I{len(row['zp'])}f", len(row["zp"]), *row["zp"]) if row.get("zp") is not None else b""
    data = struct.pack("<iiBBHHHiiii", ref, row["pos"], len(name), row["mapq"], 4680, len(ops), row["flag"], len(row["seq"]), -1, -1, 0)
    data += name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
    return struct.pack("<i", len(data)) + data


_BASE_CODE = np.full(256, 16, dtype=np.uint8)
_BASE_CODE[list(BASES.encode())] = np.arange(16)


def _cigar(text: str) -> list[int]:
    return [int(n) << 4 | CIGAR.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", text)]


def _blocks(data: bytes) -> Iterator[bytes]:
    """BGZF blocks of some data."""
    for at in range(0, len(data), 65280):
        part = data[at : at + 65280]
        press = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = press.compress(part) + press.flush()
        yield b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def write_file(rows: Iterator[dict], f, contigs: list[tuple[str, int]], program: str = "strandlake") -> None:  # noqa: ANN001
    """Rows as one BAM file with a program line in its header."""
    text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs) + f"@PG\tID:{program}\tPN:{program}\n"
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    place = {n: i for i, (n, _) in enumerate(contigs)}
    held = bytearray(head)
    for row in rows:
        if row["rname"] != "*" and row["rname"] not in place:
            raise ValueError(f"unknown contig: {row['rname']}")
        held += encode_record(row, place.get(row["rname"], -1))
        if len(held) > 1 << 20:
            f.write(b"".join(_blocks(bytes(held))))
            held.clear()
    f.write(b"".join(_blocks(bytes(held))) + END)
