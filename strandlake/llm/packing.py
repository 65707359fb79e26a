"""Sum-of-squares packing of tokenised documents into fixed windows.

Every task packs the documents of its partition as they come. Whole windows of a long document stand
alone; the rest of it goes, uncut, into the open window whose fill level makes the sum of the squared
numbers of open windows at each level grow least (a new window is level 0). The counts are held in an
array by level, so a placement looks at levels and never at windows.

Documents are packed in runs of some ``RUN_IDS`` ids, which bounds the memory whatever their lengths. At a run's end the fullest
open windows are filled from the emptiest ones by cutting, and the one window left over stays open for the next run; that of the
partition's last run is written as sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.store import small_batches
from strandlake.llm.tokens import encoder

CAPACITY, END_ID = 2048, 1
#: Ids of a run: 64 MB.
RUN_IDS = 1 << 24

#: row of the document, first of its ids, ids
Piece = tuple[int, int, np.ndarray]


class SquaresPacker:
    """Calls ``emit(pieces)`` for each finished sequence."""

    def __init__(self, capacity: int, emit) -> None:  # noqa: ANN001
        self.capacity, self.emit = capacity, emit
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.run = 0

    def add(self, doc: object, ids: np.ndarray) -> None:
        full = len(ids) - len(ids) % self.capacity
        for start in range(0, full, self.capacity):
            self.emit([(doc, start, ids[start : start + self.capacity])])
        if full < len(ids):
            self.place((doc, full, ids[full:]))
        self.run += len(ids)
        if self.run >= RUN_IDS:
            self.close(last=False)

    def place(self, piece: Piece) -> None:
        size, n = len(piece[2]), self.counts
        # Growth of the sum of squares when a window goes from level h to level h + size.
        growth = 2 * n[size:] + 1
        growth[-1] = 0
        growth[1:] += 1 - 2 * n[1 : self.capacity - size + 1]
        growth[1:][n[1 : self.capacity - size + 1] == 0] = np.iinfo(np.int64).max
        level = int(growth.argmin())
        window = self.open[level].pop() if level else []
        n[level] -= level > 0
        window.append(piece)
        if level + size == self.capacity:
            self.emit(window)
            return
        self.open[level + size].append(window)
        n[level + size] += 1

    def close(self, last: bool = True) -> None:
        windows = [(level, w) for level in range(self.capacity - 1, 0, -1) for w in self.open[level]]
        self.counts[:], self.run = 0, 0
        self.open = [[] for _ in range(self.capacity)]
        i, j = 0, len(windows) - 1
        while i < j:
            level, filled = windows[i]
            while level < self.capacity and i < j:
                doc, start, ids = windows[j][1].pop()
                take = min(len(ids), self.capacity - level)
                filled.append((doc, start, ids[:take]))
                level += take
                if take < len(ids):
                    windows[j][1].append((doc, start + take, ids[take:]))
                elif not windows[j][1]:
                    j -= 1
            if level == self.capacity:
                self.emit(filled)
                i += 1
            else:
                windows[i] = (level, filled)
        if i == j and windows[i][1]:
            rest = windows[i][1]
            size = sum(len(p[2]) for p in rest)
            if last:
                self.powers(rest)
            else:
                self.open[size].append(rest)
                self.counts[size] += 1

    def powers(self, pieces: list[Piece]) -> None:
        """Sequences of the powers of two that make up the pieces' size, largest first."""
        left = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            out = []
            while want:
                doc, start, ids = pieces.pop()
                out.append((doc, start, ids[:want]))
                if len(ids) > want:
                    pieces.append((doc, start + want, ids[want:]))
                want -= len(out[-1][2])
            self.emit(out)


def _pack(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        done: list[tuple] = []
        sequence = [first]
        kind = None

        def emit(pieces: list[Piece]) -> None:
            offset = 0
            for (doc, total), start, ids in pieces:
                done.append((doc, start, len(ids), ids.tobytes(), total, sequence[0], offset))
                offset += len(ids)
            sequence[0] += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * 7
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        packer = SquaresPacker(capacity, emit)
        for b in batches:
            kind = b.column(0).type
            ids, at = encoder(path).encode(b.column(1), end_id)
            for doc, lo, hi in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                packer.add((doc, hi - lo), ids[lo:hi].copy())
                if len(done) >= 512:
                    yield flush()
        packer.close()
        if done:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences of at most ``capacity`` ids: id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, followed by ``end_id``; a null or empty text is ``end_id`` alone. Each id is in one piece.
    Every sequence has ``capacity`` ids but, at the end of a partition, some whose lengths are powers of two. ``sequence_id`` is unique,
    and the same if a task runs again. A null id stays null; rows that repeat an id are documents of their own; an empty table gives no
    rows; other columns play no part.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    out = texts.mapInArrow(_pack(tokenizer, end_id, capacity), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
