"""Source divergence audit: how far the term shares of a language's sources lie apart, by joint histograms of counts.

A term's share in a source depends on its count alone, so a pair of sources needs no sum over terms: it needs how many terms have which pair of
counts. Those joint histograms are tallied from terms that both sources have; the cells with a zero follow from each source's own histogram of
counts, the cell of two zeros from the number of terms. The measure is evaluated once for each combination of counts and multiplied by
how many terms have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import kernel
from strandlake.llm.store import bounded_batches, delete, let_go, written

LEAST_DOCS, TOP_TERMS = 10, 10
#: ASCII letters and all other than ASCII characters.
LETTERS = kernel.ALNUM.copy()
LETTERS[0x30:0x3A] = False
#: Rows that a task gathers before it adds up and gives out; pairs of counts that are looked at together.
ROWS, PAIRS = 1 << 20, 1 << 20


class _Groups:
    """Numbers of a task's (language, source) pairs."""

    def __init__(self) -> None:
        self.number: dict[tuple[str, str], int] = {}

    def of(self, *columns: pa.Array) -> np.ndarray:
        codes = [c.dictionary_encode() for c in columns]
        size = len(codes[1].dictionary)
        pair, inverse = np.unique(codes[0].indices.to_numpy().astype(np.int64) * size + codes[1].indices.to_numpy(), return_inverse=True)
        names = [(codes[0].dictionary[int(p // size)].as_py(), codes[1].dictionary[int(p % size)].as_py()) for p in pair]
        return np.array([self.number.setdefault(n, len(self.number)) for n in names], dtype=np.int64)[inverse]

    def columns(self, numbers: np.ndarray) -> list[pa.Array]:
        names = list(self.number)
        return [pa.array([n[i] for n in names], pa.string()).take(pa.array(numbers)) for i in (0, 1)]


def _gathered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of some words in a row, and where each begins, with the end."""
    n = end - start
    at = np.append(0, np.cumsum(n))
    return buf[np.repeat(start - at[:-1], n) + np.arange(at[-1])], at


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _strings(buf: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(buf)).cast(pa.string())


class _Counts:
    """Counts of terms by group, gathered from batches; terms are told apart by hash, and by letters should hashes agree."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, w: kernel.Words, group: np.ndarray) -> None:
        """``group`` of each text, in ascending order."""
        order = np.argsort(w.hash, kind="stable")
        hashed = w.hash[order]
        text = (np.searchsorted(w.first, np.arange(len(w.hash)), "right") - 1)[order]
        own = group[text]
        begin = _runs(hashed, own)
        size = np.diff(np.append(begin, len(order)))
        first = order[begin]
        alike = kernel.spelled_alike(w.buf, w.start[order], w.end[order], w.buf, np.repeat(w.start[first], size)) if len(order) else np.zeros(0, bool)
        alike &= (w.end - w.start)[order] == np.repeat((w.end - w.start)[first], size)
        if not alike.all():
            raise ArithmeticError("two terms of a batch have one hash")
        seen = np.zeros(len(order), dtype=np.int64)
        seen[_runs(hashed, text)] = 1
        docs = np.add.reduceat(seen, begin) if len(begin) else seen
        buf, at = _gathered(w.buf, w.start[first], w.end[first])
        self._put((hashed[begin], own[begin], size, docs, buf, at))

    def _put(self, part: tuple) -> None:
        self.parts.append(part)
        self.rows += len(part[0])

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Group, count, documents and term."""
        hashed, group, count, docs = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        buf = np.concatenate([p[4] for p in self.parts])
        ends = np.cumsum([0, *(len(p[4]) for p in self.parts)])
        at = np.concatenate([p[5][:-1] + e for p, e in zip(self.parts, ends, strict=False)] + [ends[-1:]])
        order = np.lexsort((group, hashed))
        begin = _runs(hashed[order], group[order])
        size = np.diff(np.append(begin, len(order)))
        first, rest = order[begin], np.repeat(order[begin], size)
        alike = (np.diff(at)[order] == np.diff(at)[rest]).all() and kernel.spelled_alike(buf, at[:-1][order], at[1:][order], buf, at[:-1][rest]).all()
        if not alike:
            raise ArithmeticError("two terms of a task have one hash")
        own_buf, own_at = _gathered(buf, at[:-1][first], at[1:][first])
        self.parts, self.rows = [], 0
        return group[first], np.add.reduceat(count[order], begin), np.add.reduceat(docs[order], begin), _strings(own_buf, own_at)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    groups, counts = _Groups(), _Counts()

    def out() -> Iterator[pa.RecordBatch]:
        if counts.rows:
            group, count, docs, term = counts.merged()
            yield pa.RecordBatch.from_arrays([*groups.columns(group), term, pa.array(count), pa.array(docs)], ["lang", "source", "term", "count", "docs"])

    for b in batches:
        if b.num_rows:
            own = groups.of(b.column("lang"), b.column("source"))
            order = np.argsort(own, kind="stable")
            w = kernel.words(b.column("text").take(pa.array(order)), LETTERS)
            if len(w.hash):
                counts.add(w, own[order])
        if counts.rows >= ROWS:
            yield from out()
    yield from out()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, by_source) of terms, sources in order: (lang, a, b, count_a, count_b, n) for pairs of sources that both have the term."""
    let_go()
    held: list[np.ndarray] = []
    langs, sources = {}, {}

    def numbers(column: pa.Array, known: dict) -> np.ndarray:
        code = column.dictionary_encode()
        return np.array([known.setdefault(x, len(known)) for x in code.dictionary.to_pylist()], dtype=np.int64)[code.indices.to_numpy()]

    def added(rows: np.ndarray) -> np.ndarray:
        """Rows of (lang, a, b, count_a, count_b, n), equal ones added up."""
        rows = rows[:, np.lexsort(rows[:5][::-1])]
        begin = _runs(*rows[:5])
        return np.vstack([rows[:5, begin], np.add.reduceat(rows[5], begin)])

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            rows = added(np.hstack(held))
            held.clear()
            name = lambda known, code: pa.array(list(known), pa.string()).take(pa.array(code))
            yield pa.RecordBatch.from_arrays([name(langs, rows[0]), name(sources, rows[1]), name(sources, rows[2]), *map(pa.array, rows[3:])], ["lang", "a", "b", "count_a", "count_b", "n"])

    for b in batches:
        lists = b.column("by_source")
        size = lists.value_lengths().to_numpy().astype(np.int64)
        row, flat = np.repeat(np.arange(b.num_rows), size), lists.flatten()
        count, source, lang = flat.field("count").to_numpy(), numbers(flat.field("source"), sources), numbers(b.column("lang"), langs)
        # A pair's languages, sources and counts as one number, where that fits.
        values, code = np.unique(count, return_inverse=True)
        fits = len(langs) * len(sources) ** 2 * len(values) ** 2 < 1 << 62
        # Each entry meets those after it in its term's list; some entries at a time.
        after = np.repeat(np.cumsum(size), size) - np.arange(len(row)) - 1
        upto, lo = np.cumsum(after), 0
        while lo < len(after):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            n = after[lo:hi]
            left = np.repeat(np.arange(lo, hi), n)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            if len(left) and fits:
                key, times = np.unique((((lang[row] * len(sources) + source)[left] * len(sources) + source[right]) * len(values) + code[left]) * len(values) + code[right], return_counts=True)
                key, y = np.divmod(key, len(values))
                key, x = np.divmod(key, len(values))
                key, other = np.divmod(key, len(sources))
                held.append(np.vstack([*np.divmod(key, len(sources)), other, values[x], values[y], times]))
            elif len(left):
                held.append(added(np.vstack([lang[row[left]], source[left], source[right], count[left], count[right], np.ones(len(left), np.int64)])))
            lo = hi
            if sum(x.shape[1] for x in held) >= ROWS:
                yield from out()
    yield from out()


#: Counts up to this, times a thousand million, stay within 64 bits.
_FITS = 9_000_000_000


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact; null where there is no term."""
    more, whole = count + 2, total + 2 * terms
    small = F.call_function("div", 1_000_000_000 * more, whole)
    large = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * more.cast("decimal(20,0)"), whole.cast("decimal(20,0)"))
    return F.when(terms > 0, 1 + F.when(count <= _FITS, small).otherwise(large))


def _measure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """The tables of one audit: terms kept, groups, joint histograms, and the two parts of the report."""

    def __init__(self, docs: DataFrame, lang_col: str, source_col: str, text_col: str, least_docs: int) -> None:
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
        counted = rows.mapInArrow(_count_terms, "lang string, source string, term string, count long, docs long").repartition("lang", "term")
        by_source = counted.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
        # A list holds a term's sources, one entry each.
        terms = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("source", "count"))).alias("by_source"))
        self.terms = written(terms.where(F.col("docs") >= least_docs), "terms")
        self.each = self.terms.select("lang", "term", "total", F.explode("by_source").alias("s")).select("lang", "term", "total", "s.source", "s.count")
        langs = self.terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("lang_count"))
        own = self.each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        found = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
        self.groups = written(found.fillna(0, ["n", "n_terms", "lang_count"]), "groups")

    def joint_counts(self) -> DataFrame:
        """(lang, a, b, count_a, count_b, n): of each pair of sources, how many terms have which two counts, neither 0."""
        parts = self.terms.select("lang", "by_source").where(F.size("by_source") > 1).repartition("lang", F.hash("by_source"))
        made = parts.mapInArrow(_tally, "lang string, a string, b string, count_a long, count_b long, n long")
        return made.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("n").alias("n"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) of each source and each other one of its language.

        With f of two counts and n terms of both: the sum over all terms is n_terms f(0, 0), and for each cell of a source's own histogram its
        terms times f(x, 0) - f(0, 0), and for each joint cell its terms times f(x, y) - f(x, 0) - f(0, y) + f(0, 0), as each of those terms
        has been counted once with either count alone and once with none.
        """
        side = lambda s: self.groups.select("lang", F.col("source").alias(s), F.col("n").alias(f"n_{s}"), "n_terms" if s == "a" else F.lit(0).alias("_"))
        pairs = side("a").join(side("b").drop("_"), "lang").where("a < b")
        p = lambda count, s: _share(count, F.col(f"n_{s}"), F.col("n_terms"))
        zero = F.lit(0).cast("long")
        f = lambda x, y: _measure(p(x, "a"), p(y, "b"))
        none = pairs.select("lang", "a", "b", (F.col("n_terms") * f(zero, zero)).alias("value"))
        own = self.each.groupBy("lang", "source", "count").agg(F.count("*").alias("terms"))
        cells = own.withColumnsRenamed({"source": "a", "count": "x"}).join(self.groups.select("lang", F.col("source").alias("a"), F.col("n").alias("n_a"), "n_terms"), ["lang", "a"])
        cells = cells.join(side("b").drop("_"), "lang").where("a <> b")
        one = cells.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("terms") * (f(F.col("x"), zero) - f(zero, zero))).alias("value"))
        joint = self.joint_counts().join(side("a"), ["lang", "a"]).join(side("b").drop("_"), ["lang", "b"])
        x, y = F.col("count_a"), F.col("count_b")
        both = joint.select("lang", "a", "b", (F.col("n") * (f(x, y) - f(x, zero) - f(zero, y) + f(zero, zero))).alias("value"))
        summed = none.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.coalesce(F.sum("value"), zero).alias("value"))
        ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
        return summed.select("lang", ways, "value").select("lang", "w.source", "w.item", "value")

    def excess(self) -> DataFrame:
        """(lang, source, item, value) of each source's terms whose share is above the language's."""
        known = self.each.join(self.groups, ["lang", "source"])
        p, q = _share(F.col("count"), F.col("n"), F.col("n_terms")), _share(F.col("total"), F.col("lang_count"), F.col("n_terms"))
        shares = known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        return shares.select("lang", "source", "item", _measure(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source of a language lies from each other one, and its terms that stand out most.

    Terms are runs of ASCII letters and all other than ASCII characters, A-Z lower-cased; a language keeps the V terms in at least
    ``least_docs`` of its documents. A kept term that occurs ``count`` times has the share 1 + floor(10^9 (count + 2) / (N + 2 V)) in a source
    or language, N the sum of its counts. Shares p and q differ by floor((p - q)^2 / (p + q)). Part ``pair``: for each other source of the
    language, the sum over all kept terms, 0 without any. Part ``term``: for kept terms of the source with p above the language's q,
    the ``top_terms`` largest. Ranks go by value, largest first, then by the item's UTF-8 bytes.

    Every row of ``docs`` is a document, repeated or not; null text, language and source read as ''. A source without terms has its pairs all
    the same; one alone in its language has none. An empty table gives no rows. Other columns play no part.
    """
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    with bounded_batches(docs.sparkSession):
        audit = Audit(docs, lang_col, source_col, text_col, least_docs)
        out = written(part(audit.pairs(), "pair").unionByName(part(audit.excess(), "term").where(F.col("rank") <= top_terms)), "divergence")
    delete(audit.terms, audit.groups)
    return out
