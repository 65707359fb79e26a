"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

Every distinct shingle set walks a few independent random trees. A node names two of a set's minwise tokens, by a hash of the path
so far, and the set goes down the branch of each token's value, so two sets of Jaccard similarity s stay together in each branch
with probability s. Nodes of at most ``SMALL`` sets branch no further: all their pairs are compared, first by their minwise
signatures, then by their full sets. Larger ones branch on, but for those that kept more than half of their parent's sets:
these are near copies, which branching would not divide.

With two branches at each node, whatever the depth, a pair at s = 0.8 shares a last node of one tree with probability
0.9375 or more, and of at least one of ``TREES`` = 4 trees with probability 0.99998 or more (nearer pairs more).

Equal sets are one class from the start, whatever the number of copies. A pair is compared in the first last node that it shares only. In
a node of more than ``TILE`` sets all are first compared with a few of them: sets that these connect need no comparing among themselves,
and only what the others have with all sets is cut into tiles for separate tasks. So a group of near copies costs little more than its size,
and not its square. No task returns pairs: each returns a spanning forest of the links that it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import kernel
from strandlake.llm.graph import components
from strandlake.llm.store import delete, let_go, small_batches, written

TREES, TOKENS = 4, 64
#: Sets up to which a node is compared whole; levels after which every node is.
SMALL, LEVELS = 16, 10
#: Sets on each side of a tile, and shingles of a tile's side.
TILE, TILE_SHINGLES = 1024, 4_000_000
#: Sets of a large node that all of its sets are compared with at first.
STARS = 8
#: Pairs whose signatures agree in fewer tokens than four standard deviations below the threshold are not verified.
SLACK = 4.0

_rng = np.random.Generator(np.random.PCG64(8))
_XOR = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The TOKENS minwise tokens of each set (its smallest values under as many hash functions); empty sets get zeros."""
    out = np.zeros((len(at) - 1, TOKENS), dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    i = 0
    while i < len(full):  # some 32,000 shingles at a time stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(at[full], at[full[i]] + 32768, "right")) - 1)
        lo, hi = at[full[i]], at[full[j - 1] + 1]
        part, starts = sets[lo:hi], at[full[i:j]] - lo
        for t in range(TOKENS):
            out[full[i:j], t] = np.minimum.reduceat((part ^ _XOR[t]) * _MUL[t], starts)
        i = j
    return kernel.mix(out)


def branches(tokens: np.ndarray, path: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two nodes below each set's node, as two rows of path keys, and their slots (a node's number in its binary tree)."""
    rows, keys = np.arange(len(tokens)), []
    for branch in (1, 2):
        chosen = (kernel.mix(path + np.uint64(branch)) % np.uint64(TOKENS)).astype(np.int64)
        keys.append(kernel.mix(path * np.uint64(0x9E3779B97F4A7C15) + tokens[rows, chosen] + np.uint64(branch)))
    return np.stack(keys), np.stack([2 * slot, 2 * slot + 1])


def _binary(rows: np.ndarray) -> pa.Array:
    """Fixed-width rows as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    at = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def _matrix(col: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=dtype).reshape(-1, width)


def _marks(sets: np.ndarray, at: np.ndarray) -> pa.Array:
    """128 bits that equal sets share."""
    marks = np.zeros((len(at) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        marks[full, 0] = np.add.reduceat(kernel.mix(sets), at[full])
        marks[full, 1] = np.add.reduceat(kernel.mix(sets ^ _XOR[0]), at[full])
    return _binary(marks)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            sets, at = kernel.shingle_sets(kernel.words(b.column(1), kernel.NOT_SPACE), k)
            made = [b.column(0), pa.array(np.diff(at)), _marks(sets, at), _binary(signatures(sets, at).astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([*made, *b.columns[2:]], ["id", "n", "sig", "tokens", *b.schema.names[2:]])

    return run


_NODE = "key long, slot int, parent long, sig binary, n long"


def _nodes(first: bool):
    """Rows (key, slot, parent, sig, n) of the nodes below the roots, from (sig, n, tokens, m), or below those of (sig, n, tokens, m, key, slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            if not b.num_rows:
                continue
            tokens = _matrix(b.column("tokens"), np.uint32, TOKENS).astype(np.uint64)
            if first:
                above = [(np.full(b.num_rows, kernel.mix(np.array([t + 1], np.uint64))[0]), np.full(b.num_rows, TREES + t, np.int32)) for t in range(TREES)]
            else:
                above = [(b.column("key").to_numpy().view(np.uint64), b.column("slot").to_numpy())]
            for path, slot in above:
                keys, slots = branches(tokens, path, slot)
                row = pa.array(np.tile(np.arange(b.num_rows), 2))
                cols = [pa.array(keys.ravel().view(np.int64)), pa.array(slots.ravel()), *(b.column(c).take(row) for c in ("m", "sig", "n"))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "slot", "parent", "sig", "n"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            sets, at = kernel.shingle_sets(kernel.words(b.column(1), kernel.NOT_SPACE), k)
            raw = memoryview(np.ascontiguousarray(sets)).cast("B")
            whole = pa.array([bytes(raw[8 * lo : 8 * hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([_marks(sets, at), whole], ["sig", "shingles"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from rows sorted by ``keys`` (integers), with the row at which each group begins, and the end."""
    held: list[pa.RecordBatch] = []

    def cuts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        at = cuts(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at
            t = t.slice(at[-1])
        held, count = t.to_batches(), t.num_rows if len(at) > 1 else 0  # a long group: look again after as many rows
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t, np.append(cuts(t), t.num_rows)


def _pairs_of(at: np.ndarray, side: np.ndarray, label: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (a < b) of different labels within each group; in a tile of two sides (0 and 1), only across. Some ``most`` pairs at a time,
    by the labels as they are when a part is asked for."""
    size = np.diff(at)
    last = np.repeat(at[1:], size)  # of each row, the end of its group
    left = last - np.arange(at[0], at[-1]) - 1
    total = np.concatenate([[0], np.cumsum(left)])
    i, n = 0, len(left)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1))
        c = left[i:j]
        a = np.repeat(np.arange(i, j), c)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - total[i], c)
        ok = ((side[a] != side[b]) | (side[a] == 2)) & (label[a] != label[b])
        if ok.any():
            yield a[ok], b[ok]
        i = j


class _Nodes:
    """Rows of whole nodes or tiles, and which of their pairs are to be verified."""

    def __init__(self, t: pa.Table, at: np.ndarray, percent: int) -> None:
        s = percent / 100
        self.least = max(0.0, s - SLACK * np.sqrt(s * (1 - s) / TOKENS)) * TOKENS
        self.percent, self.at, self.side = percent, at, t["side"].to_numpy()
        self.n, self.slot, self.rows = t["n"].to_numpy(), t["slot"].to_numpy(), t.num_rows
        self.tokens = _matrix(t["tokens"], np.uint32, TOKENS)
        self.same = t["sig"].combine_chunks().dictionary_encode().indices.to_numpy()
        slots, keys = (t[c].combine_chunks() for c in ("slots", "keys"))
        count = np.diff(slots.offsets.to_numpy())
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row, width = np.repeat(np.arange(self.rows), count), int(count.max(initial=0))
        self.slots, self.keys = np.full((self.rows, width), 1 << 30, np.int32), np.zeros((self.rows, width), np.int64)
        self.slots[row, place], self.keys[row, place] = slots.flatten().to_numpy(), keys.flatten().to_numpy()

    def likely(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes and signatures allow the threshold."""
        ok = 100 * np.minimum(self.n[a], self.n[b]) >= self.percent * np.maximum(self.n[a], self.n[b])
        some = np.flatnonzero(ok)
        for lo in range(0, len(some), 50_000):
            i = some[lo : lo + 50_000]
            ok[i] = (self.tokens[a[i]] == self.tokens[b[i]]).sum(axis=1) >= self.least
        return ok

    def first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no last node of a smaller slot holds both sets."""
        ok = self.same[a] != self.same[b]
        for c in range(self.slots.shape[1]):
            i = np.flatnonzero(ok & (self.slots[a, c] < self.slot[a]))
            if len(i):
                ok[i[(self.keys[b[i]] == self.keys[a[i], c][:, None]).any(axis=1)]] = False
        return ok

    def candidates(self, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in _pairs_of(self.at, self.side, label):
            ok = self.likely(a, b)
            a, b = a[ok], b[ok]
            ok = self.first(a, b)
            if ok.any():
                yield a[ok], b[ok]


def _active(percent: int):
    """Rows that have a pair to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for t, at in whole_groups(batches, ["key", "tile"]):
            label = np.arange(1, t.num_rows + 1)  # 0 for those known to have one: pairs of two such say nothing new
            for a, b in _Nodes(t, at, percent).candidates(label):
                label[a] = label[b] = 0
            if not label.all():
                yield from t.filter(pa.array(label == 0)).combine_chunks().to_batches()

    return run


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i], exactly."""
    if len(a) < 8:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, col, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    row, col = row[shared[col]], place[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(used), len(used)), dtype=np.float32)
    step = max(1024, 8_000_000 // len(used))
    for lo in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(col, [lo, lo + step])
        has = np.zeros((len(used), step), dtype=np.float32)
        has[row[i:j], col[i:j] - lo] = 1
        total += has @ has.T
    return total[where[: len(a)], where[len(a) :]].astype(np.int64)


def _overlaps_with(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others that aren't empty."""
    every = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, every), len(one) - 1)
    begin = np.cumsum([0, *map(len, others)])[:-1]
    return np.add.reduceat((one[place] == every).astype(np.int64), begin)


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


#: Sets of a part whose pairs are verified one set after the other, before the rest is at once.
PIVOTS = 8


def verified(sets: list[np.ndarray], n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int, forest: _Forest) -> Iterator[tuple[int, int]]:
    """Pairs of (a, b) that are linked and join something. The set of most pairs goes first, as pairs that it connects need no verifying."""
    for _ in range(PIVOTS):
        if len(a) < 16:
            break
        pivot = int(np.bincount(np.concatenate([a, b])).argmax())
        own = (a == pivot) | (b == pivot)
        others = np.where(a[own] == pivot, b[own], a[own])
        both = _overlaps_with(sets[pivot], [sets[i] for i in others.tolist()])
        for x in others[100 * both >= percent * (n[pivot] + n[others] - both)].tolist():
            if forest.join(pivot, x):
                yield pivot, x
        a, b = a[~own], b[~own]
        apart = np.array([forest.top(x) != forest.top(y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)
        a, b = a[apart], b[apart]
    if len(a):
        both = _overlaps(sets, a, b)
        ok = 100 * both >= percent * (n[a] + n[b] - both)
        yield from (p for p in zip(a[ok].tolist(), b[ok].tolist(), strict=True) if forest.join(*p))


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for t, at in whole_groups(batches, ["key", "tile"], 4000):
            nodes, sets = _Nodes(t, at, percent), [np.frombuffer(r, dtype=np.uint64) for r in t["shingles"].to_pylist()]
            forest, found = _Forest(), []
            group, label = np.searchsorted(at, np.arange(t.num_rows), "right"), np.arange(t.num_rows)
            for a, b in nodes.candidates(label):
                before = len(found)
                for cut in np.split(np.arange(len(a)), np.flatnonzero(np.diff(group[a])) + 1):
                    found += verified(sets, nodes.n, a[cut], b[cut], percent, forest)
                if len(found) > before:
                    label[:] = [forest.top(i) for i in range(t.num_rows)]
            if found:
                yield pa.RecordBatch.from_arrays([t["sig"].take(pa.array([p[i] for p in found])).combine_chunks() for i in (0, 1)], ["a", "b"])

    return run


def _stars(percent: int):
    """Of groups (key, tile) that begin with the sets to compare with (``own`` is false): each link of one of these with another row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for t, at in whole_groups(batches, ["key", "tile"], 4000):
            n, own, sig = t["n"].to_numpy(), t["own"].to_numpy(), t["sig"].combine_chunks()
            sets = [np.frombuffer(r, dtype=np.uint64) for r in t["shingles"].to_pylist()]
            stars, rows = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                mid = lo + int((~own[lo:hi]).sum())
                for i in range(lo, mid if mid < hi else lo):
                    both = _overlaps_with(sets[i], sets[mid:hi])
                    linked = mid + np.flatnonzero(100 * both >= percent * (n[i] + n[mid:hi] - both))
                    stars.append(np.full(len(linked), i))
                    rows.append(linked)
            if rows:
                i, j = pa.array(np.concatenate(stars)), pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([t["key"].combine_chunks().take(j), t["star"].combine_chunks().take(i), sig.take(i), sig.take(j)], ["key", "star", "rep", "sig"])

    return run


def _main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node's sets of stars that rows are linked with, and how many rows: the stars that are connected and have most rows."""
    for b in batches:
        main = []
        for found in b.column("found").to_pylist():
            groups: list[list[int]] = []  # stars that are connected, and their rows
            for x in found:
                own = [x["mask"], x["n"]]
                for g in [g for g in groups if g[0] & own[0]]:
                    groups.remove(g)
                    own = [own[0] | g[0], own[1] + g[1]]
                groups.append(own)
            main.append(max(groups, key=lambda g: (g[1], g[0]))[0])
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(main, pa.int64())], ["key", "main"])


def _last_nodes(classes: DataFrame) -> DataFrame:
    """(key, slot, sig, n, m, shingles) of all sets in nodes that don't branch, but for those alone in theirs: the node's sets and their shingles."""
    held = ["sig", "n", "tokens", "m"]
    rows, first, last = classes.withColumn("m", F.lit(classes.count()).cast("long")).select(*held), True, None
    for level in range(LEVELS):
        own = written(rows.mapInArrow(_nodes(first), _NODE), "nodes")
        crowded = own.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).where("m > 1")
        placed = written(own.join(crowded, "key"), "crowded")
        delete(own)
        on = (F.col("m") > SMALL) & (2 * F.col("m") <= F.col("parent")) & F.lit(level + 1 < LEVELS)
        done = placed.where(~on).drop("parent")
        last = done if last is None else last.unionByName(done)
        big = placed.where(on)
        if big.isEmpty():
            break
        rows, first = big.select("key", "slot", "sig", "m").join(classes.select("sig", "n", "tokens"), "sig").select(*held, "key", "slot"), False
    return last


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80, by_row: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links) and kept.

    Words are runs of non-space bytes, A-Z lower-cased. A set holds the distinct ``k``-word shingles; a text of fewer words
    is one shingle; one without words (or null) has an empty set and no links. Two texts are linked when 100 times the
    intersection is at least ``percent`` times the union. Rows that repeat an id are rows of their own. A row whose id is
    null takes no part in links: its component_id is null and it is kept. An empty table gives no rows; other columns of
    ``docs`` play no part. With ``by_row`` two columns follow: text_hash, which tells rows of one id apart, and group, which rows of equal or linked
    sets share (null for an empty set or a null id), as unlinked rows of one id may have the same component_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = texts.withColumn("text_hash", F.xxhash64("text")) if by_row else texts
    extra = ", text_hash long" if by_row else ""
    base = written(sketched.mapInArrow(_sketch(k), f"id {texts.schema['id'].dataType.simpleString()}, n long, sig binary, tokens binary{extra}"), "sketches")
    one = [F.first(c).alias(c) for c in ("n", "tokens")]
    classes = written(base.where("n > 0 and id is not null").groupBy("sig").agg(*one, F.min("id").alias("id")), "classes")

    def with_sets(rows: DataFrame) -> DataFrame:
        """Column ``shingles`` of rows with a sig."""
        wanted = written(rows.select("sig").distinct().join(classes.select("sig", "id"), "sig").select("id").distinct(), "wanted")  # of a known size
        sets = texts.join(wanted, "id").select("id", "text").mapInArrow(_sets(k), "sig binary, shingles binary").groupBy("sig").agg(F.first("shingles").alias("shingles"))
        return rows.join(sets, "sig").select(*rows.columns, "shingles")

    nodes = written(_last_nodes(classes), "last-nodes")
    slots = nodes.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("slot", "key"))).alias("own"))  # a set's own nodes: some tens at most
    about = classes.select("sig", "tokens").join(slots, "sig").select("sig", "tokens", F.col("own.slot").alias("slots"), F.col("own.key").alias("keys"))
    chunks = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    chunk = lambda of, salt: F.pmod(F.xxhash64("sig", "key", F.lit(salt)), of).cast("int")
    small, large = nodes.where(chunks == 1), nodes.where(chunks > 1).withColumn("chunks", chunks)

    tile = lambda i, j: (F.col(i).cast("long") * F.col("chunks") + F.col(j)).alias("tile")
    whole = small.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(2), "chunks": F.lit(1)})
    tiles, stars = whole.select("key", tile("i", "j"), "slot", "side", "sig", "n"), None
    if not large.isEmpty():
        # Large nodes: who is connected by some of them, and then the others (side 0) with all (side 1).
        star = F.pmod(F.xxhash64("sig"), F.lit(STARS)).cast("int").alias("star")
        some = large.groupBy("key", star).agg(F.min("sig").alias("sig"))
        some = large.join(some, ["key", "sig"]).withColumns({"tile": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "own": F.lit(False)})
        dealt = large.withColumns({"star": F.lit(0), "tile": chunk(F.col("chunks"), 0), "own": F.lit(True)}).unionByName(some).select("key", "tile", "own", "star", "sig", "n")
        against = with_sets(dealt).repartition("key", "tile").sortWithinPartitions("key", "tile", "own", "star")
        stars = written(against.mapInArrow(_stars(percent), "key long, star int, rep binary, sig binary"), "stars")
        masks = stars.groupBy("key", "sig").agg(F.sum(F.expr("shiftleft(1L, star)")).alias("mask"))
        found = masks.groupBy("key", "mask").agg(F.count("*").alias("n")).groupBy("key").agg(F.collect_list(F.struct("mask", "n")).alias("found"))  # 2**STARS a node at most
        main = found.mapInArrow(_main, "key long, main long")
        connected = masks.join(main, "key").where(F.col("mask").bitwiseAND(F.col("main")) != 0)
        others = large.join(connected.select("key", "sig"), ["key", "sig"], "left_anti")
        left = others.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("left"))
        zero = others.join(left, "key").withColumns({"i": chunk(F.col("left"), 1), "j": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "side": F.lit(0)})
        one = large.join(left, "key").withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("left") - 1)), "j": chunk(F.col("chunks"), 0), "side": F.lit(1)})
        for part in (zero, one):
            tiles = tiles.unionByName(part.select("key", tile("i", "j"), "slot", "side", "sig", "n"))
    marked = tiles.join(about, "sig").select("key", "tile", "slot", "side", "sig", "n", "tokens", "slots", "keys")
    active = written(marked.repartition("key", "tile").sortWithinPartitions("key", "tile", "side", "sig").mapInArrow(_active(percent), marked.schema), "active")

    verify = with_sets(active).repartition("key", "tile").sortWithinPartitions("key", "tile", "side", "sig")
    links = verify.mapInArrow(_links(percent), "a binary, b binary")
    roots = components(links.unionByName(stars.select(F.col("rep").alias("a"), F.col("sig").alias("b"))) if stars else links)
    delete(nodes, active, *[stars] * bool(stars))

    named = roots.withColumnRenamed("vertex", "sig").join(classes.select("sig", "id"), "sig")
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = named.join(smallest, "root").select("sig", F.col("component_id").alias("linked_id"), *["root"] * by_row)
    alone = classes.select("sig", F.col("id").alias("own_id"))
    out = base.select("id", "n", "sig", *["text_hash"] * by_row).join(alone, "sig", "left").join(linked, "sig", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("linked_id", "own_id", "id"))
    rows = ["text_hash", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("root", "sig")).alias("group")] if by_row else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), *rows)
