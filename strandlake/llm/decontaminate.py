"""Benchmark decontamination: a prefix-filtered join of item windows with document texts.

A window is ``k`` consecutive words of an item. Seen as a set of short shingles, it can only lie in a document
that holds every one of them, so for exact containment one shingle is prefix enough: the window's rarest, counted
over all documents. Documents meet windows at those shingles only; the shingle's place in its window and the
document's bounds fix where the window would lie, and all its words are then compared.

Items are taken in blocks of at most ``BLOCK_BYTES`` of text, whose index, flat arrays of some hundred bytes a word, is broadcast; more items mean
more passes. A block's index takes some 250 MB on the driver while it is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import kernel
from strandlake.llm.store import let_go, small_batches, written

K, SHINGLE = 10, 3
BLOCK_BYTES = 4 << 20
_BITS = 22


class Index(NamedTuple):
    """Distinct windows of a block of items, in flat arrays."""

    buf: np.ndarray  # bytes of all items, and the words in them
    start: np.ndarray
    end: np.ndarray
    begin: np.ndarray  # of each window, its first word
    length: np.ndarray
    hash: np.ndarray
    items: np.ndarray  # ids as text, sorted
    owners: np.ndarray  # items of all windows in a row
    owner_at: np.ndarray
    shingle: int
    # Prefix: sorted shingle hashes by shingle size, with the windows they stand for and their place in them.
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    maybe: np.ndarray  # by the low bits of a shingle hash


def windows_of(ids: list[str], texts: list[str | None], k: int, shingle: int) -> tuple[Index, np.ndarray]:
    """The index without its prefixes, and the hashes of all items' words."""
    w = kernel.words(pa.array(texts, pa.string()), kernel.ALNUM)
    count = np.diff(w.first)
    items, item_of = np.unique(np.array(ids, dtype=object).astype(str), return_inverse=True) if ids else (np.zeros(0, str), np.zeros(0, np.int64))
    begins, lengths, hashes, owners = [], [], [], []
    for n in np.unique(np.minimum(count, k)).tolist():
        if not n:
            continue
        which = np.flatnonzero(np.minimum(count, k) == n)
        many = count[which] - n + 1
        at = np.repeat(w.first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begins.append(at)
        lengths.append(np.full(len(at), n))
        hashes.append(kernel.grams(w.hash, n)[at])
        owners.append(np.repeat(item_of[which], many))
    none = [np.zeros(0, np.int64)]
    begin, length, owner = (np.concatenate(x or none).astype(np.int64) for x in (begins, lengths, owners))
    _, first, window = np.unique(np.concatenate(hashes or [np.zeros(0, np.uint64)]), return_index=True, return_inverse=True)
    pair = np.unique(window * max(1, len(items)) + owner)
    own_window, own_item = np.divmod(pair, max(1, len(items)))
    at = np.searchsorted(own_window, np.arange(len(first) + 1))
    hashed = np.concatenate(hashes or [np.zeros(0, np.uint64)])[first]
    return Index(w.buf, w.start, w.end, begin[first], length[first], hashed, items, own_item, at, shingle, {}, np.zeros(0, bool)), w.hash


#: Windows whose shingles are looked at together.
_TOGETHER = 1 << 17


def _shingles(index: Index, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By shingle size: some windows, and a matrix of the hashes of their shingles."""
    for n in np.unique(index.length):
        q = min(index.shingle, int(n))
        which = np.flatnonzero(index.length == n)
        all_grams = kernel.grams(hashes, q)
        for lo in range(0, len(which), _TOGETHER):
            some = which[lo : lo + _TOGETHER]
            yield q, some, all_grams[index.begin[some][:, None] + np.arange(int(n) - q + 1)]


def _mask(values: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << _BITS, dtype=bool)
    maybe[(values & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return maybe


def _found(grams: np.ndarray, known: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of known shingles, and which they are."""
    at = np.flatnonzero(maybe[(grams & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    place = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
    ok = known[place] == grams[at]
    return at[ok], place[ok]


def _frequencies(known, sizes):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        values = known.value
        maybe, total = _mask(values), np.zeros(len(values), dtype=np.int64)
        for b in batches:
            w = kernel.words(b.column(0), kernel.ALNUM)
            for q in sizes:
                _, place = _found(kernel.grams(w.hash, q), values, maybe)
                total += np.bincount(place, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"])

    return run


def _index(docs: DataFrame, items: list, k: int, shingle: int) -> Index | None:
    index, hashes = windows_of([r[0] for r in items], [r[1] for r in items], k, shingle)
    if not len(index.begin):
        return None
    known = np.unique(np.concatenate([np.unique(m) for _, _, m in _shingles(index, hashes)]))
    sizes = sorted({min(shingle, int(n)) for n in np.unique(index.length)})
    context = docs.sparkSession.sparkContext
    counted = docs.select("text").mapInArrow(_frequencies(context.broadcast(known), sizes), "shingle long, n long")
    # As many rows as the block of items has shingles at most.
    counts = counted.groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(len(known), dtype=np.int64)
    often[np.searchsorted(known, counts["shingle"].to_numpy(dtype=np.int64).view(np.uint64))] = counts["n"].to_numpy()
    prefix: dict[int, list] = {}
    for q, which, m in _shingles(index, hashes):
        rarest = np.lexsort((m, often[np.searchsorted(known, m)]), axis=1)[:, 0]
        prefix.setdefault(q, []).append((m[np.arange(len(m)), rarest], which, rarest))
    for q, found in prefix.items():
        value, which, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(value, kind="stable")
        value, at = np.unique(value[order], return_index=True)
        prefix[q] = value, np.append(at, len(order)), which[order], place[order]
    return index._replace(prefix=prefix, maybe=_mask(np.concatenate([p[0] for p in prefix.values()])))


def occurrences(w: kernel.Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """First document word and window of each occurrence of a window in a batch of documents."""
    starts, which = [], []
    text_of = lambda at: np.searchsorted(w.first, at, "right") - 1
    window_hash: dict[int, np.ndarray] = {}
    for q, (known, at, windows, places) in index.prefix.items():
        grams = kernel.grams(w.hash, q)
        if not len(grams):
            continue
        pos, hit = _found(grams, known, index.maybe)
        n = at[hit + 1] - at[hit]
        entry = np.repeat(at[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, window = np.repeat(pos, n) - places[entry], windows[entry]
        text = text_of(np.repeat(pos, n))
        end = start + index.length[window]
        ok = (start >= w.first[text]) & (end <= w.first[text + 1])
        start, window = start[ok], window[ok]
        for n in np.unique(index.length[window]).tolist():
            own = index.length[window] == n
            if n not in window_hash:
                window_hash[n] = kernel.grams(w.hash, n)
            own &= window_hash[n][np.minimum(start, len(window_hash[n]) - 1)] == index.hash[window]
            starts.append(start[own])
            which.append(window[own])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, window = np.concatenate(starts), np.concatenate(which)
    n = index.length[window]
    hit = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
    d, v = start[hit] + within, index.begin[window][hit] + within
    alike = w.end[d] - w.start[d] == index.end[v] - index.start[v]
    d, v = d[alike], v[alike]
    alike[alike] = kernel.spelled_alike(w.buf, w.start[d], w.end[d], index.buf, index.start[v])
    ok = np.bincount(hit[~alike], minlength=len(n)) == 0
    return start[ok], window[ok]


_OUT = "n_words long, spans array<struct<first:long,end:long>>, item_ids array<string>"


def _lists(text: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """A list for each of n texts; ``values`` are in the order of texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), values)


def _merged(earlier: pa.Array, first: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Ranges of words by text: earlier ones, within their texts, and new ones, within the batch; those that meet are one."""
    n = pc.fill_null(pc.list_value_length(earlier), 0).to_numpy(zero_copy_only=False)
    old = earlier.flatten()
    base = np.repeat(first[:-1], n)
    start = np.append(base + old.field("first").to_numpy(), start)
    end = np.append(base + old.field("end").to_numpy(), end)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    text = np.searchsorted(first, start, "right") - 1
    begins = np.append(True, (start[1:] > reach[:-1]) | (text[1:] != text[:-1])) if len(start) else np.zeros(0, bool)
    text, lo, hi = text[begins], start[begins], reach[np.append(np.flatnonzero(begins)[1:] - 1, len(start) - 1)] if len(start) else reach
    return _lists(text, len(first) - 1, pa.StructArray.from_arrays([pa.array(lo - first[text]), pa.array(hi - first[text])], ["first", "end"]))


def _owners(earlier: pa.Array, first: np.ndarray, start: np.ndarray, window: np.ndarray, known: Index | None) -> pa.Array:
    """Sorted ids by text of the items that own windows found in it, and of earlier ones."""
    texts = len(first) - 1
    n = known.owner_at[window + 1] - known.owner_at[window] if known else window
    entry = np.repeat(known.owner_at[window] - np.cumsum(n) + n, n) + np.arange(n.sum()) if known else window
    text = np.repeat(np.searchsorted(first, start, "right") - 1, n)
    size = max(1, len(known.items)) if known else 1
    text, item = np.divmod(np.unique(text * size + (known.owners[entry] if known else 0)), size)
    names = pa.array(known.items.tolist() if known else [], pa.string()).take(pa.array(item))
    if earlier.null_count == len(earlier):
        return _lists(text, texts, names)
    sets = [set(x or ()) for x in earlier.to_pylist()]  # another block's items
    for t, name in zip(text.tolist(), names.to_pylist(), strict=True):
        sets[t].add(name)
    return pa.array([sorted(x) for x in sets], pa.list_(pa.string()))


def _scan(index):  # noqa: ANN001
    """Appends n_words, spans and item_ids to (..., text, spans, item_ids); earlier passes' spans and ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = index.value if index else None
        for b in batches:
            w = kernel.words(b.column("text"), kernel.ALNUM)
            start, window = occurrences(w, known) if known else (np.zeros(0, np.int64),) * 2
            keep = [i for i, c in enumerate(b.schema.names) if c not in ("n_words", "spans", "item_ids")]
            spans = _merged(b.column("spans"), w.first, start, start + (known.length[window] if known else 0))
            cols = [b.column(i) for i in keep] + [pa.array(np.diff(w.first)), spans, _owners(b.column("item_ids"), w.first, start, window, known)]
            yield pa.RecordBatch.from_arrays(cols, [b.schema.names[i] for i in keep] + ["n_words", "spans", "item_ids"])

    return run


def _scanned(texts: DataFrame, items: DataFrame, k: int, shingle: int, item_col: str, item_text_col: str) -> DataFrame:
    """``texts`` (with a column text) and n_words, spans and item_ids."""
    spark = texts.sparkSession
    small_batches(spark)
    listed = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    size = listed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    out = texts.withColumns({"spans": F.expr("cast(null as array<struct<first:long,end:long>>)"), "item_ids": F.expr("cast(null as array<string>)")})
    scanned = T.StructType([*texts.schema.fields, *T._parse_datatype_string(_OUT).fields])
    for i in range(blocks):
        block = listed.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).distinct()
        index = _index(texts, [tuple(r) for r in block.collect()], k, shingle)  # a block is bounded by BLOCK_BYTES
        shared = spark.sparkContext.broadcast(index) if index else None
        out = out.select(*texts.columns, "spans", "item_ids").mapInArrow(_scan(shared), scanned)
        if i + 1 < blocks:
            out = written(out, "decontaminated")
    return out


def contamination(docs: DataFrame, items: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit (words inside any window's occurrence), n_items, item_ids (sorted as strings),
    spans (merged ranges of hit words) and contaminated.

    Words are runs of ASCII letters, digits and all other than ASCII characters, A-Z lower-cased. An item of fewer than ``k`` words, but
    not none, is one window. A null text has no words; a null item id reads "null"; items that repeat an id count as one. Without items or
    documents nothing is hit, or there are no rows. Other columns play no part.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = _scanned(texts, items, k, shingle, item_col, item_text_col)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["first"])
    cols = [F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans", (hit > 0).alias("contaminated")]
    return out.select(*cols)


def uncontaminated(docs: DataFrame, items: DataFrame, k: int = K, shingle: int = SHINGLE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without a hit word, all columns as they are, whatever their names. A row whose text is null or has no words stays; rows that
    repeat are kept or dropped together; ids play no part. Without items all rows stay, and an empty table gives none.
    """
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    return _scanned(named, items, k, shingle, item_col, item_text_col).where(F.size("spans") == 0).select("row.*")
