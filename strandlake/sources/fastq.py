"""FASTQ files in ranges of bytes.

Where a record begins can't be told from one line, as a quality may begin with an @ too. It can from three: a line that begins with @ begins a record
if the one after next begins with +, for two lines after a quality stands a sequence. A task takes the records that begin in its range.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.sources.paths import files, store_of

SPLIT_BYTES, CHUNK_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 4 << 20
ENDINGS = (".fastq", ".fq", ".fastq.gz", ".fq.gz")


def _lines(f, at: int) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """Lines and where they begin, from the first one that begins at ``at`` or after it. ``f`` is at ``at`` - 1, or at 0 if that is where it begins."""
    left, begin, skip = b"", max(0, at - 1), at > 0
    while chunk := f.read(CHUNK_BYTES):
        parts = (left + chunk).split(b"\n")
        left = parts.pop()
        for p in parts:
            if not skip:
                yield begin, p.rstrip(b"\r")
            skip = False
            begin += len(p) + 1
    if left and not skip:
        yield begin, left.rstrip(b"\r")


def records(f, lo: int, end: int | None) -> Iterator[tuple[bytes, bytes, bytes]]:  # noqa: ANN001
    """Head line, sequence and quality of the records that begin in a range. A line that begins none is passed over."""
    lines, seen = _lines(f, lo), deque()
    while True:
        while len(seen) < 4 and (line := next(lines, None)) is not None:
            seen.append(line)
        if not seen or end is not None and seen[0][0] >= end:
            return
        if len(seen) > 2 and seen[0][1][:1] == b"@" and seen[2][1][:1] == b"+":
            yield seen[0][1], seen[1][1], seen[3][1] if len(seen) > 3 else b""
            for _ in range(min(4, len(seen))):
                seen.popleft()
        else:
            seen.popleft()


def _batch(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
    text = lambda i: pa.array([r[i].decode("utf-8", "replace") for r in rows], pa.string())
    return pa.RecordBatch.from_arrays([text(i) for i in range(3)], ["head", "seq", "qual"])


class FastqSource(DataSource):
    """(head, seq, qual) of records. Option ``splitBytes``: size of ranges; a file whose name ends with .gz is one."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "head string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FastqReader(self.options)


class FastqReader(DataSourceReader):
    def __init__(self, options) -> None:  # noqa: ANN001
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        paths, out = files(self.path, ENDINGS, "FASTQ"), []
        for p, info in zip(paths, store_of(self.path)[0].get_file_info(paths), strict=True):
            step = max(1, info.size) if p.endswith(".gz") else self.split
            out += [InputPartition((p, lo, None if lo + step >= info.size else lo + step)) for lo in range(0, max(1, info.size), step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, lo, end = partition.value
        store, rows, held = store_of(self.path)[0], [], 0
        with store.open_input_stream(path, compression="gzip") if path.endswith(".gz") else store.open_input_file(path) as f:
            if lo:
                f.seek(lo - 1)
            for r in records(f, lo, end):
                rows.append(r)
                held += sum(map(len, r))
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)
