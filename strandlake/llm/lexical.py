"""Ranked lexical search: the best documents of each item of a query set, by a threshold-seeded join.

Documents meet items at the items' terms only. A first pass keeps, for each document, the terms of a block of items that it holds and how
often (its postings); a second one each term's document count and its ``k`` largest impacts. ``k`` documents hold a term with its kth impact
or more, so weight times kth impact is a lower bound of an item's kth best score: the seed of its threshold. An item's terms are put in order
of what they can add at most. Where all that a suffix of them can add stays below the threshold, those terms alone bring no document in: only
the others generate candidates. A candidate whose sum so far and the suffix's bound reach the threshold is scored exactly over all terms. A task
raises the thresholds by the exact scores that it has found.

Items are taken in blocks of at most ``BLOCK_BYTES`` of text, whose terms and bounds, some hundred bytes a word, are broadcast; more items mean
more passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import kernel
from strandlake.llm.store import bounded_batches, delete, let_go, written

K = 20
BLOCK_BYTES = 4 << 20
#: Cells (documents times items) that are summed up at once.
CELLS = 1 << 20
_BITS = 20


class Vocabulary(NamedTuple):
    """Distinct terms of a block of items, by their hashes."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    maybe: np.ndarray  # by the low bits of a hash

    def find(self, w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which ones: looked up by hash and compared by letters."""
        low = np.uint64((1 << _BITS) - 1)
        at = np.flatnonzero(self.maybe[(w.hash & low).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.hash, w.hash[at]), len(self.hash) - 1)
        ok = (self.hash[term] == w.hash[at]) & (self.end[term] - self.start[term] == w.end[at] - w.start[at])
        at, term = at[ok], term[ok]
        ok = kernel.spelled_alike(w.buf, w.start[at], w.end[at], self.buf, self.start[term])
        return at[ok], term[ok]


def vocabulary(texts: list[str | None]) -> tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all items, and (item, term, times) in the order of items."""
    w = kernel.words(pa.array(texts, pa.string()), kernel.ALNUM)
    hashes, first, term = np.unique(w.hash, return_index=True, return_inverse=True)
    if not kernel.spelled_alike(w.buf, w.start, w.end, w.buf, w.start[first][term]).all():
        raise ArithmeticError("two terms of the items have one hash")
    maybe = np.zeros(1 << _BITS, dtype=bool)
    maybe[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    item = np.repeat(np.arange(len(texts)), np.diff(w.first))
    pair, times = np.unique(item * max(1, len(hashes)) + term, return_counts=True)
    item, term = np.divmod(pair, max(1, len(hashes)))
    return Vocabulary(w.buf, w.start[first], w.end[first], hashes, maybe), item, term, times


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _postings(known):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        v = known.value
        for b in batches:
            w = kernel.words(b.column(1), kernel.ALNUM)
            at, term = v.find(w)
            doc = np.searchsorted(w.first, at, "right") - 1
            pair, times = np.unique(doc * len(v.hash) + term, return_counts=True)
            doc, term = np.divmod(pair, len(v.hash))
            begins = np.searchsorted(doc, np.arange(b.num_rows + 1))
            cols = [b.column(0), pa.array(np.diff(w.first)), _lists(term.astype(np.int32), begins), _lists(times.astype(np.int32), begins)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "terms", "times"])

    return run


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and impact of all postings of a batch of (m, terms, times)."""
    terms, times = b.column("terms"), b.column("times")
    n = terms.value_lengths().to_numpy()
    row = np.repeat(np.arange(b.num_rows), n)
    tf, m = times.flatten().to_numpy().astype(np.int64), b.column("m").to_numpy()[row]
    return row, terms.flatten().to_numpy().astype(np.int64), 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _first_of_each(group: np.ndarray, k: int) -> np.ndarray:
    """Of sorted groups, which rows are among the first k of theirs."""
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(group)))
    return np.arange(len(group)) - np.repeat(begin, size) < k


def _best_impacts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, impact, docs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            _, t, i = _flat(b)
            docs = np.bincount(t, minlength=len(docs)) + np.append(docs, np.zeros(max(0, int(t.max(initial=-1)) + 1 - len(docs)), np.int64))
            term, impact = np.append(term, t), np.append(impact, i)
            order = np.lexsort((-impact, term))
            order = order[_first_of_each(term[order], k)]
            term, impact = term[order], impact[order]
        begins = np.append(True, term[1:] != term[:-1]) if len(term) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(impact), pa.array(np.where(begins, docs[term], 0))], ["term", "impact", "docs"])

    return run


class Search(NamedTuple):
    """What a task needs: each item's entries (terms with weights) in order of what they can add, largest first, and by term the same entries."""

    n_items: int
    n_terms: int
    item: np.ndarray  # of each entry, sorted; each item's largest bound first
    term: np.ndarray
    weight: np.ndarray  # times times weight
    first: np.ndarray  # of each item, its first entry; one more than items
    later: np.ndarray  # what an entry and all after it in its item can add at most
    seed: np.ndarray  # of each item


def search_of(item: np.ndarray, term: np.ndarray, times: np.ndarray, n_items: int, n_terms: int, weight: np.ndarray, top: np.ndarray, kth: np.ndarray) -> Search:
    """``top`` and ``kth``: a term's largest and kth largest impact (0 if there are fewer)."""
    w = times * weight[term]
    bound, low = w * top[term], w * kth[term]
    seed = np.zeros(n_items, dtype=np.int64)
    np.maximum.at(seed, item, low)
    keep = bound > 0
    order = np.flatnonzero(keep)[np.lexsort((-bound[keep], item[keep]))]
    item, term, w, bound = item[order], term[order], w[order], bound[order]
    first = np.searchsorted(item, np.arange(n_items + 1))
    total = np.append(0, np.cumsum(bound))
    return Search(n_items, n_terms, item, term, w, first, total[first[1:]][item] - total[:-1], seed)


class Ranking:
    """A task's best documents of each item so far, and the thresholds that they set."""

    def __init__(self, s: Search, k: int) -> None:
        self.s, self.k = s, k
        self.threshold = s.seed.copy()
        self.item, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        self._generators()

    def _generators(self) -> None:
        """Entries that generate candidates, by term, and what an item's others can add at most. Made anew for a batch if thresholds have risen."""
        s, self.risen = self.s, False
        on = s.later >= np.maximum(1, self.threshold[s.item])
        order = np.flatnonzero(on)[np.argsort(s.term[on], kind="stable")]
        self.by_term = s.item[order], s.weight[order]
        self.term_at = np.searchsorted(s.term[order], np.arange(s.n_terms + 1))
        n_on = np.bincount(s.item[on], minlength=s.n_items)
        place, some = s.first[:-1] + n_on, n_on < np.diff(s.first)
        self.others = np.zeros(s.n_items, dtype=np.int64)
        self.others[some] = s.later[place[some]]

    def add(self, b: pa.RecordBatch) -> None:
        if self.risen:
            self._generators()
        row, term, impact = _flat(b)
        at = np.searchsorted(row, np.arange(b.num_rows + 1))
        step = max(1, CELLS // max(1, self.s.n_items))
        for lo in range(0, b.num_rows, step):
            hi = min(b.num_rows, lo + step)
            self._some(b.column("id"), lo, hi, row[at[lo] : at[hi]], term[at[lo] : at[hi]], impact[at[lo] : at[hi]])

    def _some(self, ids: pa.Array, lo: int, hi: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        s = self.s
        n = self.term_at[term + 1] - self.term_at[term]
        entry = np.repeat(self.term_at[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        items, weights = self.by_term
        # Sums stay far below 2^53, so doubles hold them exactly.
        part = np.bincount(np.repeat(row - lo, n) * s.n_items + items[entry], np.repeat(impact, n) * weights[entry], minlength=(hi - lo) * s.n_items).reshape(hi - lo, s.n_items)
        doc, item = np.nonzero((part > 0) & (part + self.others >= self.threshold))
        if not len(doc):
            return
        score = self._scores(doc + lo, item, row, term, impact)
        ok = score >= np.maximum(1, self.threshold[item])
        self._keep(item[ok], score[ok], ids.take(pa.array(doc[ok] + lo)))

    def _scores(self, doc: np.ndarray, item: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Exact scores of pairs, over all terms of their items."""
        s = self.s
        n = s.first[item + 1] - s.first[item]
        entry = np.repeat(s.first[item] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key, wanted = row * s.n_terms + term, np.repeat(doc, n) * s.n_terms + s.term[entry]
        place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        found = np.where(key[place] == wanted, impact[place] * s.weight[entry], 0)
        return np.add.reduceat(found, np.cumsum(n) - n)

    def _keep(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        ids = pa.concat_arrays([self.ids, ids]) if self.ids is not None else ids
        item, score = np.append(self.item, item), np.append(self.score, score)
        place = np.empty(len(ids), dtype=np.int64)
        place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, -score, item))
        order = order[_first_of_each(item[order], self.k)]
        self.item, self.score, self.ids = item[order], score[order], ids.take(pa.array(order))
        count = np.bincount(self.item, minlength=self.s.n_items)
        full = np.flatnonzero(count >= self.k)
        kth = self.score[np.cumsum(count)[full] - 1]
        self.risen |= bool((kth > self.threshold[full]).any())
        self.threshold[full] = np.maximum(self.threshold[full], kth)


def _rank(shared, k: int):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        best = Ranking(shared.value, k)
        for b in batches:
            best.add(b)
        if best.ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), best.ids, pa.array(best.score)], ["item", "id", "score"])

    return run


def _block(texts: DataFrame, items: list, k: int) -> DataFrame | None:
    """(item, rank, id, score) of a block of items, by their places in the list; nothing without a term on either side."""
    spark = texts.sparkSession
    known, item, term, times = vocabulary([r[0] for r in items])
    if not len(known.hash):
        return None
    kind = texts.schema["id"].dataType.simpleString()
    made = written(texts.mapInArrow(_postings(spark.sparkContext.broadcast(known)), f"id {kind}, n long, terms array<int>, times array<int>"), "postings")
    with_terms, total = made.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        delete(made)
        return None
    m = F.expr(f"75 + (cast(25 * n as decimal(20, 0)) * {with_terms}) div {total}").cast("long")
    postings = made.where(F.size("terms") > 0).select("id", m.alias("m"), "terms", "times")
    own = Window.partitionBy("term")
    best = postings.select("m", "terms", "times").mapInArrow(_best_impacts(k), "term int, impact long, docs long")
    ranked = best.select("term", "impact", F.row_number().over(own.orderBy(F.desc("impact"))).alias("r"), F.sum("docs").over(own).alias("docs"))
    # One row a term of the block.
    stats = ranked.where(F.col("r") <= k).groupBy("term").agg(F.max("impact").alias("top"), F.max(F.when(F.col("r") == k, F.col("impact"))).alias("kth"), F.max("docs").alias("docs")).fillna(0).toPandas()
    weight, top, kth = (np.zeros(len(known.hash), dtype=np.int64) for _ in range(3))
    at = stats["term"].to_numpy()
    weight[at] = [math.floor(1000 * math.log((2 * with_terms + 2) / (2 * d + 1))) for d in stats["docs"].tolist()]
    top[at], kth[at] = stats["top"], stats["kth"]
    search = search_of(item, term, times, len(items), len(known.hash), weight, top, kth)
    found = postings.mapInArrow(_rank(spark.sparkContext.broadcast(search), k), f"item int, id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    out = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
    delete(made)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each row of ``items`` with a score above 0: item id, rank (int, from 1), document id and score (long).

    Terms are runs of ASCII letters, digits and all other than ASCII characters, A-Z lower-cased. N documents have a term, all of them L terms, one
    has n of them, ``df`` documents hold a term, one holds it ``tf`` times. A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document's
    score is the sum of w (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included, with m = 75 + 25 n N div L. Equal scores go
    by ascending document id, a null id first; rows that repeat are documents of their own. A null or empty text has no terms: it is found by
    no item and, as an item, finds nothing. Items that repeat an id are ranked each for itself. Without documents or items there are no rows.
    Other columns play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    listed = items.select(F.col(item_text_col).cast("string").alias("text"), F.col(item_col).alias("item_id")).where("text is not null")
    size = listed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, kind, out = max(1, -(-int(size) // BLOCK_BYTES)), listed.schema["item_id"].dataType, None
    for i in range(blocks):
        block = [tuple(r) for r in listed.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == i).collect()]  # bounded by BLOCK_BYTES
        with bounded_batches(spark):
            found = _block(texts, block, k) if block else None
        if found is not None:
            names = spark.createDataFrame([(j, r[1]) for j, r in enumerate(block)], f"item int, item_id {kind.simpleString()}")
            named = found.join(names, "item").select(F.col("item_id").alias(item_col), F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
            out = named if out is None else out.unionByName(named)
    if out is None:
        out = spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, `{id_col}` {texts.schema['id'].dataType.simpleString()}, score long")
    return out
