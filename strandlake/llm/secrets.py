"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern knows.

A candidate is a run of at least ``LEAST`` token characters. Its encoding is the smallest alphabet that holds all of them. Three tests ask whether
it may be drawn evenly from that alphabet: chi-squared of its letter counts, runs above and below the alphabet's middle, and serial correlation
of neighbours. A candidate that fails them is none. The same three statistics are then held against ordinary text: what the letters and letter
pairs of the whole corpus, within the encoding, let expect of a token as long. The chances that ordinary text looks as even as that are
combined (Cauchy), and Benjamini and Hochberg's rule over all candidates of all documents, each weighted by its length in bits, bounds the share of
ordinary tokens among those reported. A short token can't be told from ordinary text and isn't reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import kernel
from strandlake.llm.store import bounded_batches, let_go, written

#: Kinds of spans, in the order of ties.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Characters of candidates; candidates that are shorter than this have no power in any test.
TOKEN = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"
LEAST = 16
#: A candidate is even if none of three tests rejects that at this level together; the share of ordinary tokens among reported ones.
EVEN, FALSE_DISCOVERIES = 0.001, 0.01
#: Alphabets, smallest first; one that holds all characters of a candidate is its encoding.
ALPHABETS = [
    b"0123456789",
    b"0123456789abcdef",
    b"0123456789ABCDEF",
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    b"0123456789abcdefghijklmnopqrstuvwxyz",
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    TOKEN,
]
_SIZE = len(TOKEN)
_CODE = np.full(256, -1, dtype=np.int8)
_CODE[list(TOKEN)] = np.arange(_SIZE)
#: Of each alphabet, the place of each token character, or -1; and which alphabets hold a character, as bits.
_PLACE = np.array([[a.find(bytes([c])) for c in TOKEN] for a in ALPHABETS])
_HOLDS = ((_PLACE >= 0) * (1 << np.arange(len(ALPHABETS)))[:, None]).sum(axis=0)
#: Digits, capitals, small letters and signs.
_CLASS = np.array([0] * 10 + [1] * 26 + [2] * 26 + [3] * 4)
#: Tokens of so many characters are tested at once.
TOGETHER = 1 << 18
#: Steps of evidence for each factor of ten.
STEPS = 100

_tail = np.vectorize(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), otypes=[float])


def pair_counts(col: pa.Array) -> np.ndarray:
    """How often each token character follows each other one in some texts."""
    buf, at = kernel.text_bytes(col)
    out = np.zeros(_SIZE * _SIZE, dtype=np.int64)
    for lo in range(0, len(buf) - 1, kernel.CHUNK):
        code = _CODE[buf[lo : lo + kernel.CHUNK + 1]].astype(np.int64)
        both = (code[:-1] >= 0) & (code[1:] >= 0)
        ends = at[(at > lo) & (at < lo + len(code))] - 1 - lo
        both[ends[ends < len(both)]] = False  # from one text to the next
        out += np.bincount((code[:-1] * _SIZE + code[1:])[both], minlength=_SIZE * _SIZE)
    return out.reshape(_SIZE, _SIZE)


class Ordinary:
    """What ordinary text lets expect within each alphabet, learnt from counts of character pairs (one is added to each).

    An alphabet of letters of one case learns from text of both, as little ordinary text is of capitals.
    """

    def __init__(self, pairs: np.ndarray) -> None:
        self.of = []
        for place, letters in zip(_PLACE, ALPHABETS, strict=True):
            own = np.flatnonzero(place >= 0)
            p = pairs.astype(np.float64)
            if letters.upper() == letters or letters.lower() == letters:
                to = np.array([TOKEN.index(bytes([c])) for c in (TOKEN.upper() if letters.upper() == letters else TOKEN.lower())])
                p = np.zeros_like(p)
                np.add.at(p, (to[:, None], to[None]), pairs)
            p = (p + 1.0)[np.ix_(own, own)]
            p /= p.sum()
            single, v = (p.sum(axis=0) + p.sum(axis=1)) / 2, place[own].astype(np.float64)
            change = float(p[_CLASS[own][:, None] != _CLASS[own][None]].sum())
            a, b = p.sum(axis=1), p.sum(axis=0)
            spread = math.sqrt(max(1e-12, (a @ v**2 - (a @ v) ** 2) * (b @ v**2 - (b @ v) ** 2)))
            self.of.append((float((single**2).sum()), float((single**3).sum()), min(max(change, 1e-3), 1 - 1e-3), float(v @ p @ v - (a @ v) * (b @ v)) / spread))
        self.of = np.array(self.of)


def battery(buf: np.ndarray, start: np.ndarray, end: np.ndarray, ordinary: Ordinary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some tokens: bits, the chance of a token drawn evenly to look as uneven, and of an ordinary one to look as even."""
    n = (end - start).astype(np.float64)
    token = np.repeat(np.arange(len(start)), end - start)
    at = np.cumsum(end - start) - (end - start)
    code = _CODE[buf[np.repeat(start - at, end - start) + np.arange(len(token))]].astype(np.int64)
    held = np.bitwise_and.reduceat(_HOLDS[code], at)
    kind = np.argmax((held[:, None] >> np.arange(len(ALPHABETS))) & 1, axis=1)
    k = np.array([len(a) for a in ALPHABETS], dtype=np.float64)[kind]
    v = _PLACE[kind[token], code].astype(np.float64)
    s2, s3, change, follow = ordinary.of[kind].T

    # Letter counts: chi-squared by Wilson and Hilferty; pairs of equal letters, whose mean and variance text of independent letters fixes.
    cell, count = np.unique(token * _SIZE + code, return_counts=True)
    squares = np.bincount(cell // _SIZE, count.astype(np.float64) ** 2, minlength=len(start))
    free = k - 1
    chi = np.maximum(0, squares * k / n - n)
    even_count = _tail((np.cbrt(chi / free) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)))
    equal, pairs = (squares - n) / 2, n * (n - 1) / 2
    spread = np.sqrt(np.maximum(1e-9, pairs * s2 * (1 - s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2)))
    plain_count = _tail((pairs * s2 - equal) / spread)

    # Runs above and below the middle; against ordinary text, runs of characters of one class.
    upper = v >= k[token] / 2
    inner = np.append(token[1:] == token[:-1], False)
    moves = np.bincount(token, (np.append(upper[1:] != upper[:-1], False) & inner).astype(float), minlength=len(start))
    ups = np.bincount(token, upper.astype(float), minlength=len(start))
    product = 2 * ups * (n - ups)
    wanted, wide = product / n, np.sqrt(np.maximum(1e-9, product * (product - n) / (n * n * np.maximum(1, n - 1))))
    even_runs = np.where(product > 0, np.minimum(1, 2 * _tail(np.abs(moves - wanted) / wide)), np.minimum(1, 2.0 ** (1 - n)))
    turns = np.bincount(token, (np.append(_CLASS[code[1:]] != _CLASS[code[:-1]], False) & inner).astype(float), minlength=len(start))
    plain_runs = _tail((turns - (n - 1) * change) / np.sqrt((n - 1) * change * (1 - change)))

    # Serial correlation, the last one followed by the first.
    total, power = np.bincount(token, v, minlength=len(start)), np.bincount(token, v * v, minlength=len(start))
    nxt = np.append(v[1:], 0.0)
    nxt[at + (end - start) - 1] = v[at]
    product = np.bincount(token, v * nxt, minlength=len(start))
    below = n * power - total * total
    r = np.where(below > 0, (n * product - total * total) / np.where(below > 0, below, 1), 1.0)
    even_follow = np.minimum(1, 2 * _tail(np.abs(r + 1 / (n - 1)) * np.sqrt(n)))
    plain_follow = _tail(np.where(follow > 0, 1.0, -1.0) * (follow - r) * np.sqrt(n))

    even = np.minimum(1, 3 * np.minimum(np.minimum(even_count, even_runs), even_follow))
    plain = np.clip(np.stack([plain_count, plain_runs, plain_follow]), 1e-300, 1 - 1e-9)
    # Cauchy's combination holds whatever the dependence of the tests; far out, tan((1/2 - p) pi) is 1 / (p pi).
    far = np.where(plain < 1e-6, 1 / (np.pi * plain), np.tan((0.5 - np.maximum(plain, 1e-6)) * np.pi)).mean(axis=0)
    chance = np.where(far > 1e6, 1 / (np.pi * np.maximum(far, 1)), 0.5 - np.arctan(far) / np.pi)
    return n * np.log2(k), even, chance


def candidates(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of LEAST token characters or more; none reaches from one text into the next."""
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = _CODE[buf] >= 0
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[at] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    long = end - start >= LEAST
    return start[long], end[long]


def base_spans(buf: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in bytes in which texts are kept apart by a zero byte."""
    for m in ASSIGN.finditer(buf):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            yield m.start(), 0, m.end()
    for m in ACCESS.finditer(buf):
        if m.end() - m.start() >= LEAST_ACCESS:
            yield m.start(), 1, m.end()
    for m in HEX.finditer(buf):
        yield m.start(), 2, m.end()


_SPANS = "base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,evidence:double,bits:double>>"


def _apart(col: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts, each followed by a zero byte, and where each begins."""
    buf, at = kernel.text_bytes(col)
    data = memoryview(np.ascontiguousarray(buf))
    n = len(at) - 1
    return b"".join(x for i in range(n) for x in (data[at[i] : at[i + 1]], b"\0")), at + np.arange(n + 1)


def _grouped(text: np.ndarray, n: int, columns: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each of ``n`` texts; rows are sorted by text."""
    at = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _scan(shared):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        ordinary = Ordinary(shared.value)
        for b in batches:
            raw, at = _apart(b.column("text"))
            buf = np.frombuffer(raw, dtype=np.uint8)
            spans = np.array(sorted(base_spans(raw)), dtype=np.int64).reshape(-1, 3)
            start, end = candidates(buf, at)
            # Those that meet no base span: the spans that begin before a candidate's end have all ended by its start.
            reach = np.append(0, np.maximum.accumulate(spans[:, 2])) if len(spans) else np.zeros(1, np.int64)
            free = reach[np.searchsorted(spans[:, 0], end, "left")] <= start
            start, end = start[free], end[free]
            parts, lo = [], 0
            upto = np.cumsum(end - start)
            while lo < len(start):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + TOGETHER, "right")))
                parts.append(np.stack(battery(buf, start[lo:hi], end[lo:hi], ordinary)))
                lo = hi
            bits, even, chance = np.hstack(parts) if parts else np.zeros((3, 0))
            inner = np.flatnonzero((buf & 0xC0) == 0x80)  # bytes that begin no code point
            point = lambda x: x - np.searchsorted(inner, x)
            text_of = lambda x: np.searchsorted(at, x, "right") - 1
            place = lambda x, t: pa.array(point(x) - point(at[t]))
            t = text_of(spans[:, 0])
            base = _grouped(t, b.num_rows, {"start": place(spans[:, 0], t), "kind": pa.array(spans[:, 1].astype(np.int32)), "end": place(spans[:, 2], t)})
            t = text_of(start)
            evidence = np.where(even >= EVEN, -np.log10(chance), 0.0)
            found = _grouped(t, b.num_rows, {"start": place(start, t), "end": place(end, t), "evidence": pa.array(evidence), "bits": pa.array(bits)})
            yield pa.RecordBatch.from_arrays([b.column("id"), base, found], ["id", "base", "found"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    total = np.zeros((_SIZE, _SIZE), dtype=np.int64)
    for b in batches:
        total += pair_counts(b.column(0))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], ["pair", "n"])


def least_level(levels: list[tuple[int, int]], mean_bits: float, share: float) -> int | None:
    """Of (level, candidates) pairs, the lowest level that Benjamini and Hochberg's rule still takes; none if it takes none.

    A level's chance is the largest that falls to it, so rounding adds nothing.
    """
    m, rank, taken = sum(n for _, n in levels), 0, None
    for level, n in sorted(levels, reverse=True):
        rank += n
        if level > 0 and mean_bits * 10.0 ** (-level / STEPS) <= share * rank / m:
            taken = level
    return taken


def secrets(docs: DataFrame, share: float = FALSE_DISCOVERIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and spans, arrays of (kind, start, end) in code points, by start, then kind as in ``KINDS``.

    ``base`` are spans of the fixed patterns; ``spans`` adds candidates (kind ``random``) that meet none of them, pass the battery and belong to
    the discoveries of which some ``share`` at most are ordinary tokens. The family is every candidate of every document, so a text's added
    spans depend on the corpus; where most tokens of a corpus are random, random is ordinary and nothing is added.

    A null text is empty and has no spans; ids may be null or repeat; a text of any length is looked at whole; an empty table gives no rows;
    other columns play no part.
    """
    with bounded_batches(docs.sparkSession):
        made, least = _tested(docs, share, id_col, text_col)
    names = F.array(*map(F.lit, KINDS))
    base = F.transform("base", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = made.select("id", base.alias("base"), "found")
    more = F.filter("found", lambda f: F.lit(False) if least is None else (_level(f) >= least))
    added = F.transform(more, lambda f: F.struct(F.lit(KINDS[3]).alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    # No added span begins where a base one does, so its kind's name plays no part in the order.
    both = F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]).alias("order"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return out.select(F.col("id").alias(id_col), "base", F.transform(both, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def _level(f) -> Column:  # noqa: ANN001
    """Steps of evidence of a candidate. Its weighted chance is chance * mean bits / bits; the level leaves the mean out."""
    return F.when(f["evidence"] > 0, F.floor((f["evidence"] + F.log10(f["bits"])) * STEPS)).otherwise(F.lit(0)).cast("int")


def _tested(docs: DataFrame, share: float, id_col: str, text_col: str) -> tuple[DataFrame, int | None]:
    """Spans and candidates of all documents, written, and the level that the false discovery rule takes candidates from."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.select("text").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # some 4,400 rows at most
    pairs = np.zeros(_SIZE * _SIZE)
    for r in counted:
        pairs[r.pair] = r.n
    shared = spark.sparkContext.broadcast(pairs.reshape(_SIZE, _SIZE))
    made = written(texts.mapInArrow(_scan(shared), f"id {texts.schema['id'].dataType.simpleString()}, {_SPANS}"), "secrets")
    each = made.select(F.explode("found").alias("f")).select("f.evidence", "f.bits")
    tally = each.select(_level({"evidence": F.col("evidence"), "bits": F.col("bits")}).alias("level"), "bits").groupBy("level").agg(F.count("*").alias("n"), F.sum("bits").alias("bits")).collect()  # some 32,000 rows at most
    m = sum(r.n for r in tally)
    least = least_level([(r.level, r.n) for r in tally], sum(r.bits for r in tally) / m, share) if m else None
    return made, least
