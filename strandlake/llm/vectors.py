"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more are at squared distance 2 - 2c or less. A fixed rotation spreads that evenly over the dimensions, which
are then split into blocks; two such vectors are within their share of the squared distance in one block at least. Each block is a range
join: vectors are halved along the block's widest dimension again and again, and each part meets only those whose distance from
its bounding box, over all dimensions of the block, is within the budget. Pairs within a block's budget are verified by their cosine in
double precision, and count in the first block that they are within the budget of.

Equal vectors are one class with a weight. Classes are packed into tiles of bounded size, by their signatures, one row a tile. A task takes
pairs of tiles, of which it reads the written table again: vectors are shuffled twice and written once, however many tiles there are, and only
the work grows with the square of the number of classes. Tasks return link counts and spanning forests, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.graph import components
from strandlake.llm.minhash import whole_groups
from strandlake.llm.store import delete, small_batches, written

COSINE = 0.95
BLOCK_DIMS = 8
#: Vectors of a tile, some more or fewer.
TILE = 1 << 13
#: Tiles of a table that has fewer vectors than so many full ones, unless they get very small.
LEAST_TILES = 12
#: Vectors of a part that is halved no further.
PART = 128
#: Bytes of a vector's signature.
SIGNATURE = 16


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix, by reflections."""
    rng = np.random.Generator(np.random.PCG64(dims))
    out = np.eye(dims)
    for _ in range(dims):
        v = rng.standard_normal(dims)
        v /= np.sqrt((v * v).sum())
        out -= 2 * np.outer(v, (v[:, None] * out).sum(axis=0))
    return out


def blocks(dims: int) -> list[slice]:
    n = max(1, dims // BLOCK_DIMS)
    at = [dims * i // n for i in range(n + 1)]
    return [slice(lo, hi) for lo, hi in zip(at[:-1], at[1:], strict=True)]


def budgets(dims: int, cosine: float) -> np.ndarray:
    """Of each block, its part of the squared distance by its dimensions; a millionth more for rounding."""
    return np.array([(2 - 2 * cosine) * (b.stop - b.start) / dims for b in blocks(dims)]) + 1e-6


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, in single precision where that is exact, with a signature; null where they link with nothing."""
    for b in batches:
        col = b.column(1)
        at = col.offsets.to_numpy().astype(np.int64)
        values = col.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls are not a number
        size = np.diff(at)
        ok = (size > 0) & col.is_valid().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            sums = np.add.reduceat(np.append(values * values, 0.0), at[:-1]) if len(size) else np.zeros(0)
            finite = np.minimum.reduceat(np.append(np.isfinite(values), True), at[:-1]) if len(size) else ok
            some = np.maximum.reduceat(np.append(values != 0, False), at[:-1]) if len(size) else ok
        ok &= finite & some
        sig, raw = [None] * len(size), [None] * len(size)
        for i in np.flatnonzero(ok).tolist():
            x = values[at[i] : at[i + 1]]
            if not 1e-280 <= sums[i] < np.inf:
                x = x / np.abs(x).max()  # out of reach of squares: the direction is what counts
            with np.errstate(over="ignore"):
                single = x.astype(np.float32)
            raw[i] = (single if (single == x).all() else x).tobytes()
            sig[i] = blake2b(x.tobytes(), digest_size=SIGNATURE).digest()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.binary()), pa.array(size.astype(np.int32)), pa.array(raw, pa.binary())], ["id", "sig", "dims", "vector"])


def tiles(n: int) -> int:
    """Into how many tiles ``n`` vectors are cut."""
    return max(1, -(-n // TILE), min(LEAST_TILES, -(-n // (TILE >> 3))))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tile, with its signatures, weights and vectors side by side; single precision where that is exact for all."""
    for t, at in whole_groups(batches, ["dims", "tile"], 2000):
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            g = t.slice(lo, hi - lo)
            dims, raw = g["dims"][0].as_py(), g["vector"].to_pylist()
            if len({len(r) for r in raw}) > 1:
                raw = [np.frombuffer(r, np.float32 if len(r) == 4 * dims else np.float64).astype(np.float64).tobytes() for r in raw]
            cols = [pa.array([v]) for v in (g["tile"][0].as_py(), dims, b"".join(g["sig"].to_pylist()), g["weight"].to_numpy().tobytes(), b"".join(raw))]
            yield pa.RecordBatch.from_arrays(cols, ["tile", "dims", "sigs", "weights", "vectors"])


def _side(b: pa.RecordBatch, i: int, side: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Signatures, weights and unit vectors of a tile."""
    sigs, weights, raw = (b.column(f"{c}_{side}")[i].as_py() for c in ("sigs", "weights", "vectors"))
    n = len(sigs) // SIGNATURE
    kind = np.float32 if len(raw) == 4 * n * b.column("dims_a")[i].as_py() else np.float64
    x = np.frombuffer(raw, kind).astype(np.float64).reshape(n, -1)
    return [sigs[j : j + SIGNATURE] for j in range(0, len(sigs), SIGNATURE)], np.frombuffer(weights, np.int64), x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Joins the labels of a[i] and b[i]; returns pairs that joined something."""
    out = []
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            break
        _, first = np.unique(np.maximum(la, lb), return_index=True)  # each label goes under one other, a smaller one
        out += zip(a[first].tolist(), b[first].tolist(), strict=True)
        under = np.arange(len(label))
        under[np.maximum(la, lb)[first]] = np.minimum(la, lb)[first]
        while (under[under] != under).any():
            under = under[under]
        label[:] = under[label]
    return out


def _parts(z: np.ndarray, own: np.ndarray, other: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of ``own`` and those of ``other`` that may be within the squared distance ``most`` of one of them."""
    open_parts = [(own, other)]
    while open_parts:
        own, other = open_parts.pop()
        mine = z[own]
        lo, hi = mine.min(axis=0), mine.max(axis=0)
        beyond = np.maximum(0, np.maximum(lo - z[other], z[other] - hi))
        other = other[np.einsum("ij,ij->i", beyond, beyond) <= most]
        if not len(other):
            continue
        if len(own) <= PART or len(own) * len(other) <= PART * PART or not (hi > lo).any():
            yield own, other
            continue
        wide = mine[:, (hi - lo).argmax()]
        half = np.argpartition(wide, len(wide) // 2)
        open_parts += [(own[half[: len(wide) // 2]], other), (own[half[len(wide) // 2 :]], other)]


def tile_links(x: np.ndarray, own: np.ndarray, other: np.ndarray, cosine: float, weight: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weights of those linked to each unit vector, over pairs of one of ``own`` and one of ``other`` (the same, or none in common), and a spanning forest."""
    dims = x.shape[1]
    y, parts, budget = x @ rotation(dims), blocks(dims), budgets(dims, cosine)
    total, forest, label = np.zeros(len(x), dtype=np.int64), [], np.arange(len(x))
    same = own is other
    for block, most in enumerate(budget.tolist()):
        z = np.ascontiguousarray(y[:, parts[block]], dtype=np.float32)
        norm, one = (z * z).sum(axis=1, keepdims=True), np.ones((len(z), 1), dtype=np.float32)
        near_to, nearby = np.hstack([-2 * z, norm, one]), np.hstack([z, one, norm])  # their products are the squared distances
        loose = np.float32(most + 1e-5)
        for some, around in _parts(z, own, other, float(loose)):
            across = nearby[around].T
            step = max(1, 1_000_000 // len(around))
            for lo in range(0, len(some), step):
                mine = some[lo : lo + step]
                near = np.flatnonzero((near_to[mine] @ across).ravel() <= loose)
                for i in range(0, len(near), 50_000):
                    h, a = np.divmod(near[i : i + 50_000], len(around))
                    h, a = mine[h], around[a]
                    if same:
                        h, a = h[h < a], a[h < a]
                    apart = (y[h] - y[a]) ** 2
                    within = np.stack([apart[:, p].sum(axis=1) for p in parts[: block + 1]], axis=1) <= budget[: block + 1]
                    first = within[:, block] & ~within[:, :block].any(axis=1)
                    h, a = h[first], a[first]
                    linked = np.einsum("ij,ij->i", x[h], x[a]) >= cosine
                    h, a = h[linked], a[linked]
                    for u, v in ((h, a), (a, h)):
                        np.add.at(total, u, weight[v])
                    forest += _union(label, h, a)
    return total, forest


def _join(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sig, weight, x = _side(b, i, "a")
                own = other = np.arange(len(x))
                if b.column("tile_a")[i] != b.column("tile_b")[i]:
                    more = _side(b, i, "b")
                    other = len(x) + np.arange(len(more[0]))
                    sig, weight, x = sig + more[0], np.concatenate([weight, more[1]]), np.concatenate([x, more[2]])
                total, forest = tile_links(x, own, other, cosine, weight)
                some = np.flatnonzero(total).tolist()
                if some:
                    ends = [sig[j] for j in some] + [sig[j] for j, _ in forest], [None] * len(some) + [sig[j] for _, j in forest]
                    n = np.concatenate([total[some], np.zeros(len(forest), np.int64)])
                    yield pa.RecordBatch.from_arrays([*(pa.array(e, pa.binary()) for e in ends), pa.array(n)], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: id, n_links (other rows with a cosine of ``cosine`` or more), component_id (smallest id reachable by links) and kept.

    Vectors that are null, empty or zero or hold null or non-finite components have no links; vectors of different lengths never link. Rows that
    repeat an id are rows of their own. A row whose id is null takes no part: no links, a null component_id, kept. An empty table gives no
    rows; other columns play no part.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    valid = rows.mapInArrow(_valid, f"id {kind}, sig binary, dims int, vector binary")
    base = written(valid.select("id", "sig"), "vectors")
    taking_part = "sig is not null and id is not null"
    classes = written(base.where(taking_part).groupBy("sig").agg(F.count("*").alias("weight"), F.min("id").alias("id")), "vector-classes")
    known_vectors = valid.where(taking_part).groupBy("sig").agg(F.count("*").alias("weight"), F.first("dims").alias("dims"), F.first("vector").alias("vector"))
    dealt = known_vectors.withColumn("tile", F.pmod(F.xxhash64("sig"), F.lit(tiles(classes.count()))).cast("int"))
    packed = dealt.repartition("tile").sortWithinPartitions("dims", "tile").mapInArrow(_packed, "tile long, dims long, sigs binary, weights binary, vectors binary")
    packed = written(packed, "vector-tiles")
    # Tiles meet without a shuffle: each task reads its two parts of the written table again. Each pair of tiles meets once, in either order in turn.
    a, b = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in packed.columns]) for side in "ab")
    even = (F.col("tile_a") + F.col("tile_b")) % 2 == 0
    once = F.when(even, F.col("tile_a") <= F.col("tile_b")).otherwise(F.col("tile_a") > F.col("tile_b"))
    pairs = a.join(b.hint("shuffle_replicate_nl"), (F.col("dims_a") == F.col("dims_b")) & once)
    found = written(pairs.mapInArrow(_join(cosine), "a binary, b binary, n long"), "vector-links")
    delete(packed)
    counts = found.where("b is null").groupBy(F.col("a").alias("sig")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("vertex", "sig").join(classes.select("sig", "id"), "sig")
    linked = roots.join(roots.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("sig", F.col("component_id").alias("linked_id"))
    known = classes.select("sig", "weight", F.col("id").alias("own_id")).join(counts, "sig", "left").join(linked, "sig", "left")
    out = base.select("id", "sig").join(known, "sig", "left")
    part = F.col("id").isNotNull()
    links = F.when(part, F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).otherwise(F.lit(0)).cast("long")
    component = F.when(part, F.coalesce("linked_id", "own_id", "id"))
    return out.select(F.col("id").alias(id_col), links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
