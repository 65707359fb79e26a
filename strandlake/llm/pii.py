"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The field looks at zones, runs of chunks with digits or an at sign, and the chunks that such a sign or a spaced full stop joins
to them. A zone is cut into atoms (runs of letters, of digits, of white space, single other characters), and a segmentation of the atoms into entities of at most ``MOST_ATOMS`` atoms and plain single
atoms is scored by features of each whole span (its shape, digits, check digit, what stands beside it) and by which type
follows which. Forward-backward sums over all segmentations fit the weights on generated examples, and the best
segmentation, boundaries and types together, is found by the same dynamic programme with maxima.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.store import held, small_batches

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Looked for at the beginning of a run of digits only, and without going back: a match that fails there fails everywhere in the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """As the pattern's leftmost matches, looked for from the at signs: a match begins with the run of local characters before one."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and (c := text[lo - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            lo -= 1
        if lo < at and (m := _EMAIL.match(text, lo)):
            out.append(m.span())
            last = m.end()
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost matches of each kind's pattern that pass its check."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- the field ---------------------------------------------------------------------------------------------------

MOST_ATOMS, MOST_DIGITS = 16, 25
#: Longest zone, and longest span, whose outcome is kept for when it comes again.
KEPT_ZONE, KEPT_SPAN = 400, 64
#: Atoms of a zone after which the pass looks for what is settled.
SETTLE = 256
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_SPACE = re.compile(r"\s+")
_SIGN = re.compile(r"@|\(at\)|\[at\]")
#: A chunk with a digit or an at sign. From a chunk's beginning only, and possessive: no text makes it look twice.
_HOT = re.compile(r"(?<!\S)(?:[^\s0-9@(\[]++|\((?!at\))|\[(?!at\]))*+(?:[0-9@]|\(at\)|\[at\])\S*+")
_CHUNK = re.compile(r"\s*+\S++")
#: What goes on with a spaced domain: a lone full stop and the chunk after it, or a chunk that begins with one.
_DOTTED = re.compile(r"\s++\.(?:\s++\S++|[\w-]\S*+)")
_GAP = re.compile(r"\s++(?:\.\s++)?")
_SHAPES = {
    "email": re.compile(r"[\w.%+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?\. ?[\w-]+)+", re.A),
    "ip": re.compile(r"\d{1,3}(?: ?\. ?\d{1,3}){3}", re.A),
    "card": re.compile(r"\d{4}(?:[ .\-/]?\d{4}){2}[ .\-/]?\d{1,7}|\d{13,19}", re.A),
    "phone": re.compile(r"(?:\+|00)?\d{0,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}", re.A),
}
_STRANGE = re.compile(r"[^\w.@ ()+\[\]-]", re.A)
_FAR = re.compile(r"[.,:;] \d")
_PLUS = re.compile(r"\+|00|\(")


def _features(zone: str, lo: int, hi: int) -> list[float]:
    """Of the whole span zone[lo:hi], whatever its type."""
    s = _SPACE.sub(" ", zone[lo:hi])
    digits = _NOT_DIGIT.sub("", s)
    n, before, after = len(digits), zone[lo - 1 : lo], zone[hi : hi + 1]
    parts = s.split(".")
    small = len(parts) == 4 and all(p.isascii() and p.strip().isdigit() and len(p.strip()) <= 3 and int(p) <= 255 for p in parts)
    return [
        1.0,
        *[float(bool(p.fullmatch(s))) for p in _SHAPES.values()],
        float(small),
        float(13 <= n <= 19 and luhn(digits)),
        float(13 <= n <= 19),
        float(9 <= n <= 12),
        float(n < 7),
        float(n > 19),
        float(bool(_PLUS.match(s))),
        float("(" in s and ")" in s),
        float(s.count("(") != s.count(")")),
        float(bool(_STRANGE.search(s))),
        float(" " in s),
        float("  " in s or bool(_FAR.search(s))),
        float("@" in s),
        float(any(c.isalpha() for c in s)),
        float(len(re.findall(r"[ .-]", s)) >= 2),
        float(n == len(s)),
        float(before.isalnum()),
        float(after.isalnum()),
        float(bool(before) and before in "+.-/=$" or after in ("%", "/", "=")),
        float(bool(re.match(r"[.-]\d", zone[hi : hi + 2]))),
        len(s) / 20,
    ]


N_FEATURES = len(_features("1", 0, 1))


class Lattice:
    """Candidate segments of a zone: bounds in atoms and in characters, and their features."""

    def __init__(self, zone: str) -> None:
        spans = [m.span() for m in _ATOM.finditer(zone)]
        self.zone, self.n = zone, len(spans)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(self.n + 1)]  # by last atom: (first atom, row)
        self.bounds: list[Span] = []
        rows = []
        for i, (lo, _) in enumerate(spans):
            if not (zone[lo].isalnum() or zone[lo] in "+("):
                continue
            digits, at = 0, False
            for j in range(i, min(self.n, i + MOST_ATOMS)):
                a, b = spans[j]
                digits += (b - a) * zone[a].isdigit()
                at = at or zone[a] == "@" or zone[a:b] == "at"
                if digits > MOST_DIGITS:
                    break
                if zone[b - 1].isalnum() and (digits >= 4 or at):
                    self.ends[j + 1].append((i, len(rows)))
                    self.bounds.append((lo, b))
                    rows.append(_features(zone, lo, b))
        self.x = np.array(rows).reshape(-1, N_FEATURES)


class Batch:
    """Lattices side by side, those of fewer atoms filled up with segments of no weight, so that one pass of sums serves them all."""

    def __init__(self, cases: list[tuple[Lattice, list[tuple[int, int]]]]) -> None:
        self.n = np.array([t.n for t, _ in cases])
        first = np.cumsum([0, *(len(t.bounds) for t, _ in cases)])
        self.x = np.vstack([*(t.x for t, _ in cases), np.zeros((1, N_FEATURES))])  # the last row stands for no segment
        self.row = np.full((len(cases), self.n.max() + 1, MOST_ATOMS), len(self.x) - 1)  # by lattice, last atom and number of atoms
        self.true_rows, self.true_types, moves = [], [], []
        for b, (t, truth) in enumerate(cases):
            begin = {}
            for j, own in enumerate(t.ends):
                for i, r in own:
                    self.row[b, j, j - i - 1] = first[b] + r
                    begin[r] = i, j
            self.true_rows += [first[b] + r for r, _ in truth]
            self.true_types += [y for _, y in truth]
            at, last = 0, 0
            for (i, j), y in sorted((begin[r], y + 1) for r, y in truth):
                moves += [(last, 0)] * (at < i) + [(0, 0)] * (i - at - 1) + [(0 if at < i else last, y)]
                at, last = j, y
            moves += [(last, 0)] * (at < t.n) + [(0, 0)] * (t.n - at - 1)
        self.true_moves = np.zeros((len(KINDS) + 1,) * 2)
        np.add.at(self.true_moves, tuple(np.array(moves, dtype=int).reshape(-1, 2).T), 1)

    def loss(self, w: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log likelihood of the true segmentations, and its gradients: forward and backward sums over all segmentations."""
        score, step = self.x @ w.T, np.exp(move)
        weight = np.exp(score)
        weight[-1] = 0
        weights = weight[self.row]  # lattice, last atom, atoms, type
        size, end = len(self.n), int(self.n.max())
        into = np.zeros((size, end + 1 + MOST_ATOMS, len(KINDS) + 1))  # sums up to each atom times the move on; MOST_ATOMS places in front
        alpha = np.zeros((size, end + 1, len(KINDS) + 1))
        alpha[:, 0, 0] = 1
        into[:, MOST_ATOMS] = step[0]
        for j in range(1, end + 1):
            alpha[:, j, 0] = into[:, MOST_ATOMS + j - 1, 0]
            alpha[:, j, 1:] = (into[:, j : j + MOST_ATOMS, 1:][:, ::-1] * weights[:, j]).sum(axis=1)
            into[:, MOST_ATOMS + j] = alpha[:, j] @ step
        total = alpha[np.arange(size), self.n].sum(axis=1)
        beta = np.zeros((size, end + 1 + MOST_ATOMS, len(KINDS) + 1))
        beta[np.arange(size), self.n] = 1 / total[:, None]
        onward = np.zeros_like(weights)  # of each segment by its first atom: its weight times what follows
        wide = np.zeros((size, end + 1 + MOST_ATOMS, MOST_ATOMS, len(KINDS)))
        wide[:, : end + 1] = weights
        atoms = np.arange(MOST_ATOMS)
        moved = np.zeros((size, len(KINDS) + 1, len(KINDS) + 1))
        for i in range(end - 1, -1, -1):
            onward[:, i] = wide[:, i + 1 + atoms, atoms] * beta[:, i + 1 : i + 1 + MOST_ATOMS, 1:]
            out = np.concatenate([beta[:, i + 1, :1], onward[:, i].sum(axis=1)], axis=1)
            moved += alpha[:, i, :, None] * out[:, None, :]
            beta[:, i] += out @ step.T
        expected = np.zeros_like(score)
        for d in range(MOST_ATOMS):
            ends = np.arange(d + 1, end + 1)
            expected[self.row[:, ends, d]] = into[:, MOST_ATOMS + ends - d - 1, 1:] * onward[:, ends - d - 1, d]  # no row but the last comes twice
        expected[self.true_rows, self.true_types] -= 1
        gold = score[self.true_rows, self.true_types].sum() + (self.true_moves * move).sum()
        return float(np.log(total).sum() - gold), expected.T @ self.x, moved.sum(axis=0) * step - self.true_moves


def example(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A zone as it may stand in a text, and its entities."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def card() -> str:
        n = r.choice([13, 15, 16, 16, 16, 19])
        head = r.choice("3456") + d(n - 2)
        full = next(head + c for c in "0123456789" if luhn(head + c))
        return full if r.random() < 0.6 else r.choice([" ", "-", ".", "/"]).join(full[i : i + 4] for i in range(0, n, 4))

    def phone() -> str:
        sep = r.choice([" ", "-", "."])
        return r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)}{sep}{d(3)}{sep}{d(3)}{sep}{d(3)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(11)}"])

    make = {
        "email": lambda: r.choice(["{a}.{n}@{b}.{c}", "{a}@{b}.{c}", "{a} @ {b}.{c}", "{a}{n}@{b}.example.{c}"]).format(a=word(), b=word() + r.choice(["", d(1)]), c=r.choice(["com", "org", "de"]), n=d(2)),
        "ip": lambda: r.choice([".", ".", " . "]).join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
    }
    noise = [
        lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: d(r.randint(1, 9)), lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{word()}{d(3)}", lambda: f'"{"".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 32, 40])))}"', lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(3)},{d(3)}.{d(2)}",
        lambda: d(r.choice([13, 14, 16, 16, 20, 24])), lambda: f"${d(3)}.{d(2)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}.{r.randint(256, 999)}", lambda: f"@{word()}", lambda: f"{d(4)}/{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: " ".join(d(2) for _ in range(r.randint(3, 9))),
    ]
    text, spans = "", []
    for k in range(r.choice([1, 1, 2])):
        text += " " if k else r.choice(["", "", "(", '"'])
        if r.random() < 0.6:
            kind = r.choice(KINDS)
            value = make[kind]()
            spans.append((len(text), len(text) + len(value), kind))
            text += value
        else:
            value = r.choice(noise)()
            if luhn(_NOT_DIGIT.sub("", value) or "1") and len(_NOT_DIGIT.sub("", value)) >= 13:
                value = word()
            text += value
        text += r.choice(["", "", "", ".", ",", "!!", "###", ")", "&&&", "%%%"])
    return text, spans


@lru_cache(maxsize=1)
def train(examples: int = 500, rounds: int = 16, seed: int = 17, together: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Weights by type and moves between types, by AdaGrad on generated zones, ``together`` of like length a step. The same on every machine."""
    r = random.Random(seed)
    cases = []
    while len(cases) < examples:
        zone, spans = example(r)
        t = Lattice(zone)
        row = {b: i for i, b in enumerate(t.bounds)}
        if all((lo, hi) in row for lo, hi, _ in spans):
            cases.append((t, [(row[lo, hi], KINDS.index(k)) for lo, hi, k in spans]))
    cases.sort(key=lambda c: c[0].n)
    batches = [Batch(cases[i : i + together]) for i in range(0, examples, together)]
    w, move = np.zeros((len(KINDS), N_FEATURES)), np.zeros((len(KINDS) + 1,) * 2)
    sw, sm = np.full_like(w, 1e-6), np.full_like(move, 1e-6)
    for _ in range(rounds):
        r.shuffle(batches)
        for batch in batches:
            _, gw, gm = batch.loss(w, move)
            gw, gm = gw / len(batch.n) + 1e-3 * w, gm / len(batch.n) + 1e-3 * move
            sw += gw**2
            sm += gm**2
            w -= 0.5 * gw / np.sqrt(sw)
            move -= 0.5 * gm / np.sqrt(sm)
    return w, move


Score = Callable[[str, int, int], list[float]]


def scorer(w: np.ndarray) -> Score:
    """Scores by type of a span, from the span and the characters beside it; those of short spans are kept."""
    score = lambda s, lo, hi: (w @ np.array(_features(s, lo, hi))).tolist()
    kept = lru_cache(maxsize=1 << 12)(score)
    return lambda s, lo, hi: (kept if hi - lo <= KEPT_SPAN else score)(s, lo, hi)


def decode(zone: str, w: np.ndarray, move: np.ndarray, score: Score | None = None) -> list[tuple[int, int, str]]:
    """The entities of the best segmentation of the whole zone, however long, in one pass. States that no open way leads through are let go:
    what all open ways share is settled.
    """
    score, step, types = score or scorer(w), move.T.tolist(), range(len(KINDS) + 1)
    best = [0.0] + [-1e18] * len(KINDS)
    back: dict[int, list[tuple[int, int, int, int] | None]] = {}  # by last atom and type: first atom, type before, characters
    starts: deque[tuple[int, int, int, list[tuple[float, int]]]] = deque()  # first atom, its character, digits before, best ways in by type
    root, out = (0, 0), []
    digits, sign, n, look = 0, -1, 0, SETTLE

    def path(at: int, kind: int) -> list[tuple[int, int, str]]:
        spans = []
        while at > root[0]:
            before, from_kind, lo, hi = back[at][kind]
            if kind:
                spans.append((lo, hi, KINDS[kind - 1]))
            at, kind = before, from_kind
        return spans[::-1]

    for m in _ATOM.finditer(zone):
        a, b = m.span()
        first, into = zone[a], lambda y: max((best[t] + step[y][t], -t) for t in types)  # noqa: B023
        value, came = into(0)
        if first.isalnum() or first in "+(":
            starts.append((n, a, digits, [into(y) for y in types[1:]]))
        if first.isdigit():
            digits += b - a
        if first == "@" or zone[a:b] == "at":
            sign = n
        n += 1
        while starts and (starts[0][0] < n - MOST_ATOMS or digits - starts[0][2] > MOST_DIGITS):
            starts.popleft()
        best, back[n] = [value] + [-1e18] * len(KINDS), [(n - 1, -came, a, b)] + [None] * len(KINDS)
        if zone[b - 1].isalnum():
            for i, lo, d, ways in starts:
                if digits - d >= 4 or sign >= i:
                    beside = min(lo, 1)
                    each = score(zone[lo - beside : b + 2], beside, beside + b - lo)
                    for y, (way, came) in enumerate(ways):
                        if way + each[y] > best[y + 1]:
                            best[y + 1], back[n][y + 1] = way + each[y], (i, -came, lo, b)
        if n - root[0] >= look:
            opened: dict[int, set[int]] = defaultdict(set)
            for p in range(n - MOST_ATOMS, n + 1):
                opened[p] |= {t for t in types if back[p][t]}
            at = n
            while len(opened) > 1 or len(opened[at]) > 1:
                for t in opened.pop(at):
                    i, came, *_ = back[at][t]
                    opened[i].add(came)
                at = max(opened)
            (kind,) = opened[at]
            out += path(at, kind)
            for p in range(root[0] + 1, at + 1):
                del back[p]
            root = at, kind
            look = max(SETTLE, 2 * (n - at))
    return out + path(n, best.index(max(best)))


def zones(text: str) -> Iterator[Span]:
    """Runs of chunks with a digit or an at sign, divided by white space or a lone full stop only. An at sign at a chunk's edge takes in the chunk
    beside it, and the domain after it the chunks that spaced full stops join to it.
    """
    lo, hi = 0, -1
    for m in _HOT.finditer(text):
        a, b = m.span()
        signs = [s.span() for s in _SIGN.finditer(text, a, b)]
        if signs and signs[0][0] == a:
            while a > max(hi, 0) and text[a - 1].isspace():
                a -= 1
            while a > max(hi, 0) and not text[a - 1].isspace():
                a -= 1
        if a > hi >= 0 and not _GAP.fullmatch(text, hi, a):
            yield lo, hi
            hi = -1
        lo, hi = (lo if hi >= 0 else a), max(hi, b)
        if signs and hi == b:
            if signs[-1][1] == b and (more := _CHUNK.match(text, hi)):
                hi = more.end()
            if text.find(".", signs[-1][1], hi) == hi - 1 and (more := _CHUNK.match(text, hi)):
                hi = more.end()
            while more := _DOTTED.match(text, hi):
                hi = more.end()
    if hi >= 0:
        yield lo, hi


class Finder:
    """Finds spans with fixed weights; short zones that come again are decoded once."""

    def __init__(self, w: np.ndarray, move: np.ndarray) -> None:
        score = scorer(w)
        self.decode = lambda zone: decode(zone, w, move, score)
        self.kept = lru_cache(maxsize=1 << 14)(self.decode)

    def added(self, text: str, base: dict[str, list[Span]]) -> list[tuple[int, int, str]]:
        """Entities of the field that meet no base span."""
        taken: list[list[int]] = []  # what base spans cover
        for a, b in sorted(s for spans in base.values() for s in spans):
            if taken and a < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], b)
            else:
                taken.append([a, b])
        out, k = [], 0
        for lo, hi in zones(text):
            for a, b, kind in (self.kept if hi - lo <= KEPT_ZONE else self.decode)(text[lo:hi]):
                while k < len(taken) and taken[k][1] <= lo + a:
                    k += 1
                if k == len(taken) or taken[k][0] >= lo + b:
                    out.append((lo + a, lo + b, kind))
        return out

    def find(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans, by kind as listed and start."""
        if not _DIGIT.search(text) and not any(sign in text for sign in ("@", "(at)", "[at]")):
            return [], []
        base = base_spans(text)
        first = [(k, *s) for k in KINDS for s in base[k]]
        every = first + [(k, a, b) for a, b, k in self.added(text, base)]
        return first, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPAN = "array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _finder(weights) -> Finder:  # noqa: ANN001
    """The worker's finder with these weights."""
    return held(f"finder {hash(tuple(w.tobytes() for w in weights))}", lambda: Finder(*weights))


def _spans(weights):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(weights).find
        as_struct = lambda x: [{"kind": k, "start": a, "end": b} for k, a, b in x]
        for b in batches:
            found = [find(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_struct(f) for f, _ in found], _ARROW), pa.array([as_struct(e) for _, e in found], _ARROW)], ["id", "base", "spans"])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, base (spans of the fixed patterns) and spans (those and the field's), as arrays of kind, start and end
    in code points, by kind as in ``KINDS`` and then start. A null text has none; ids may be null or repeat; an empty table gives no rows;
    other columns play no part.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(_spans(train()), f"id {texts.schema['id'].dataType.simpleString()}, base {_SPAN}, spans {_SPAN}")
    return out.withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span as its kind in brackets; of spans that overlap, all they cover as the kind of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redact(weights, place: int):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(weights).find
        for b in batches:
            texts = [t if t is None or not (spans := find(t)[1]) else redacted(t, spans) for t in b.column(place).to_pylist()]
            yield b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))

    return run


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind in brackets; all other columns as they are, whatever their names.

    A null text stays null and an empty one empty; spans that overlap go as one; rows may repeat, ids play no part, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redact(train(), docs.columns.index(text_col)), T.StructType(docs.schema.fields))
