"""Token counts of whole texts, encoded in batches inside Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import kernel
from strandlake.llm.store import held, small_batches
from strandlake.llm.tokens import WordEncoder

LIMIT = 4096
#: Bytes of texts encoded at once, and of a part of a long text at least.
BATCH_BYTES, PART_BYTES = 1 << 20, 1 << 16
#: One space between two ASCII letters: the parts on its sides are normalised and merged independently.
_SAFE = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


class PieceCounter:
    """Counts of a sentencepiece model. A long text is split at safe spaces if the model puts a space in front of a text,
    keeps all white space and has no piece with a space after another character."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        rule = spec.normalizer_spec
        plain = rule.name == "identity" and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        self.splits = plain and not any("▁" in p.piece.lstrip("▁") for p in spec.pieces)

    def parts(self, text: bytes) -> list[bytes]:
        out, lo = [], 0
        while self.splits and len(text) - lo > PART_BYTES and (m := _SAFE.search(text, lo + PART_BYTES)):
            out.append(text[lo : m.start()])
            lo = m.end()
        return [*out, text[lo:]]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        own = [self.parts(t) for t in texts]
        flat = [p.decode("utf-8", "replace") for o in own for p in o]
        each = np.array([len(x) for x in self.model.encode(flat, num_threads=1)], dtype=np.int64)
        return np.add.reduceat(each, np.cumsum([0, *map(len, own)])[:-1]) if own else each


class JsonCounter:
    def __init__(self, path: str) -> None:
        self.encoder = WordEncoder(path)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        return np.diff(self.encoder.encode(pa.array(texts, pa.binary()).cast(pa.string()))[1])


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(f"counter {path}", lambda: (JsonCounter if path.endswith(".json") else PieceCounter)(path))
        for b in batches:
            buf, at = kernel.text_bytes(b.column(1))
            raw, out, i = buf.tobytes(), [np.zeros(0, np.int64)], 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH_BYTES, "right")) - 1)
                out.append(counter.counts([raw[lo:hi] for lo, hi in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]))
                i = j
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(np.concatenate(out))], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes (UTF-8), n_tokens as the library of ``model`` (.json: tokenizers, .model: sentencepiece) gives them
    without added tokens, and over_limit (n_tokens > ``limit``). A null text counts as empty; ids may be null or repeat; an empty table
    gives no rows; other columns play no part.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(_count(model), f"id {texts.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
