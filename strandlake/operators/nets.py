"""Fully connected networks: trained over partitions or side by side in tasks, and explained row by row.

A hidden layer is linear, normalised by batch, rectified, and partly dropped out while it learns; the output is the chance of the positive class. Steps
are Adam's; the rate is halved where the loss stands still, and training ends where it goes on standing still.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.ml import bounded_sample
from strandlake.operators.rows import flat, held
from strandlake.operators.sources_lr import stratified_split
from strandlake.operators.stats import mann_whitney
from strandlake.registry import query, table

WIDTH, DROPOUT, RATE, BATCH, EPOCHS = 128, 0.2, 1e-3, 256, 50
#: Epochs without a gain after which the rate is halved, and after which training ends; what counts as a gain.
SLOWER_AFTER, STOP_AFTER, LEAST_GAIN = 3, 8, 1e-4
#: Weight of a batch in the running mean and variance, and what is added to a variance.
MOMENTUM, TINY = 0.1, 1e-5
#: Numbers of a model that are added up as one row.
CHUNK = 4096


class Layer(NamedTuple):
    w: np.ndarray
    b: np.ndarray
    gain: np.ndarray
    offset: np.ndarray
    mean: np.ndarray  # running ones, which no gradient moves
    var: np.ndarray


class Network:
    """Weights, and the mean and deviation of the inputs, by which they are scaled first."""

    def __init__(self, layers: list[Layer], w: np.ndarray, b: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> None:
        self.layers, self.w, self.b, self.shift, self.scale = layers, w, b, shift, scale

    @staticmethod
    def made(dims: int, depth: int, width: int, seed: int, shift: np.ndarray | None = None, scale: np.ndarray | None = None) -> Network:
        rng, layers, n = np.random.default_rng(seed), [], dims
        for _ in range(depth):
            layers.append(Layer(rng.uniform(-1, 1, (n, width)) / np.sqrt(n), np.zeros(width), np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)))
            n = width
        return Network(layers, rng.uniform(-1, 1, n) / np.sqrt(n), np.zeros(1), np.zeros(dims) if shift is None else shift, np.ones(dims) if scale is None else scale)

    def arrays(self) -> list[np.ndarray]:
        """All numbers that training changes, as views."""
        return [a for layer in self.layers for a in layer] + [self.w, self.b]

    def learnt(self) -> list[bool]:
        return [moved for _ in self.layers for moved in (True, True, True, True, False, False)] + [True, True]

    def numbers(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def put(self, numbers: np.ndarray) -> None:
        at = 0
        for a in self.arrays():
            a[...] = numbers[at : at + a.size].reshape(a.shape)
            at += a.size

    def to_bytes(self) -> bytes:
        head = struct.pack("<III", len(self.shift), len(self.layers), len(self.w))
        return head + np.concatenate([self.shift, self.scale, self.numbers()]).astype("<f8").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Network:
        dims, depth, width = struct.unpack_from("<III", data)
        v = np.frombuffer(data, dtype="<f8", offset=12).copy()
        out = Network.made(dims, depth, width, 0, v[:dims], v[dims : 2 * dims])
        out.put(v[2 * dims :])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        h = (x - self.shift) / self.scale
        for layer in self.layers:
            h = np.maximum(0, (h @ layer.w + layer.b - layer.mean) / np.sqrt(layer.var + TINY) * layer.gain + layer.offset)
        return 1 / (1 + np.exp(-np.clip(h @ self.w + self.b[0], -500, 500)))

    def slopes(self, x: np.ndarray) -> np.ndarray:
        """The output's derivative by each input, row by row."""
        h, on = (x - self.shift) / self.scale, []
        for layer in self.layers:
            z = (h @ layer.w + layer.b - layer.mean) / np.sqrt(layer.var + TINY) * layer.gain + layer.offset
            on.append(z > 0)
            h = np.maximum(0, z)
        p = 1 / (1 + np.exp(-np.clip(h @ self.w + self.b[0], -500, 500)))
        back = (p * (1 - p))[:, None] * self.w
        for layer, open_ in zip(self.layers[::-1], on[::-1], strict=True):
            back = (back * open_ * (layer.gain / np.sqrt(layer.var + TINY))) @ layer.w.T
        return back / self.scale

    def gradients(self, x: np.ndarray, y: np.ndarray, dropout: float, rng: np.random.Generator) -> tuple[float, list[np.ndarray]]:
        """Mean loss of a batch, and its derivatives in the order of ``arrays``; running means and variances move along."""
        h, kept, n = (x - self.shift) / self.scale, [], len(x)
        for layer in self.layers:
            z = h @ layer.w + layer.b
            mean, var = z.mean(axis=0), z.var(axis=0)
            layer.mean[...] += MOMENTUM * (mean - layer.mean)
            layer.var[...] += MOMENTUM * (var * n / max(1, n - 1) - layer.var)
            even = (z - mean) / np.sqrt(var + TINY)
            out = even * layer.gain + layer.offset
            mask = (out > 0) * (rng.random(out.shape) >= dropout) / (1 - dropout)
            kept.append((h, even, np.sqrt(var + TINY), mask))
            h = out * mask
        s = np.clip(h @ self.w + self.b[0], -500, 500)
        loss = float((np.logaddexp(0, s) - y * s).mean())
        top = (1 / (1 + np.exp(-s)) - y) / n
        found = [h.T @ top, np.array([top.sum()])]
        back = top[:, None] * self.w
        for layer, (before, even, spread, mask) in zip(self.layers[::-1], kept[::-1], strict=True):
            back = back * mask
            own = [(back * even).sum(axis=0), back.sum(axis=0)]
            z = back * layer.gain
            z = (z - z.mean(axis=0) - even * (z * even).mean(axis=0)) / spread
            found = [before.T @ z, z.sum(axis=0), *own, np.zeros_like(layer.mean), np.zeros_like(layer.var), *found]
            back = z @ layer.w.T
        return loss, found


class Adam:
    """First and second moments of a network's gradients, as two rows of numbers, and the steps taken."""

    def __init__(self, net: Network, moments: np.ndarray | None = None, steps: int = 0) -> None:
        self.net, self.steps = net, steps
        self.moments = np.zeros((2, len(net.numbers()))) if moments is None else moments

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, dropout: float, rng: np.random.Generator) -> float:
        loss, found = self.net.gradients(x, y, dropout, rng)
        self.steps += 1
        g = np.concatenate([v.ravel() for v in found])
        self.moments[0] += 0.1 * (g - self.moments[0])
        self.moments[1] += 0.001 * (g * g - self.moments[1])
        move = rate * (self.moments[0] / (1 - 0.9**self.steps)) / (np.sqrt(self.moments[1] / (1 - 0.999**self.steps)) + 1e-8)
        at = 0
        for a, moves in zip(self.net.arrays(), self.net.learnt(), strict=True):
            if moves:
                a -= move[at : at + a.size].reshape(a.shape)
            at += a.size
        return loss


class Patience:
    """The rate of the next epoch, and whether there is one."""

    def __init__(self, rate: float) -> None:
        self.rate, self.best, self.since = rate, np.inf, 0

    def goes_on(self, loss: float) -> bool:
        self.since = 0 if loss < self.best - LEAST_GAIN else self.since + 1
        self.best = min(self.best, loss)
        if self.since and self.since % (SLOWER_AFTER + 1) == 0:
            self.rate /= 2
        return self.since < STOP_AFTER


def batches_of(n: int, batch: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Rows in batches of a random order; a last one of a single row goes with the one before."""
    order = rng.permutation(n)
    ends = list(range(batch, n, batch)) + [n]
    if len(ends) > 1 and ends[-1] - ends[-2] == 1:
        del ends[-2]
    lo = 0
    for hi in ends:
        if hi - lo > 1:
            yield order[lo:hi]
        lo = hi


def fit_here(x: np.ndarray, y: np.ndarray, depth: int, width: int = WIDTH, seed: int = 1, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, dropout: float = DROPOUT) -> Network:
    """A network fitted on a task's rows; the loss that counts is that of learning."""
    spread = x.std(axis=0)
    net, rng, patience = Network.made(x.shape[1], depth, width, seed, x.mean(axis=0), np.where(spread > 0, spread, 1.0)), np.random.default_rng(seed), Patience(rate)
    adam = Adam(net)
    for _ in range(epochs):
        losses = [(adam.step(x[b], y[b], patience.rate, dropout, rng), len(b)) for b in batches_of(len(x), batch, rng)]
        if not losses or not patience.goes_on(sum(v * n for v, n in losses) / sum(n for _, n in losses)):
            break
    return net


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return flat(b.column("x"))[0].reshape(b.num_rows, -1), b.column("y").to_numpy()


def _epoch(shared, rate: float, dropout: float, batch: int, seed: tuple[int, ...]):  # noqa: ANN001
    """A task's steps over its rows from the shared state on: its numbers times its rows, and the loss of the shared state on held-out rows (chunk -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, moments, steps = shared.value
        old, net = Network.from_bytes(data), Network.from_bytes(data)
        adam, rng = Adam(net, moments.copy(), steps), np.random.default_rng((*seed, TaskContext.get().partitionId()))
        rows, lost, checked = 0, 0.0, 0
        for b in batches:
            x, y = _rows(b)
            out = b.column("held_out").to_numpy(zero_copy_only=False)
            if out.any():
                p = np.clip(old.predict(x[out]), 1e-12, 1 - 1e-12)
                lost -= float(np.where(y[out] > 0.5, np.log(p), np.log(1 - p)).sum())
                checked += int(out.sum())
            x, y = x[~out], y[~out]
            for some in batches_of(len(x), batch, rng):
                adam.step(x[some], y[some], rate, dropout, rng)
                rows += len(some)
        numbers = np.concatenate([net.numbers(), adam.moments.ravel(), [adam.steps]]) * rows
        parts = [numbers[i : i + CHUNK] for i in range(0, len(numbers), CHUNK)] if rows else []
        values = [np.array([lost, checked, rows]), *parts]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32) - 1), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], ["chunk", "v"])

    return run


def _added(t: pa.Table) -> pa.Table:
    total = flat(t.column("v").combine_chunks())[0].reshape(t.num_rows, -1).sum(axis=0)
    return pa.table({"chunk": t.column("chunk").slice(0, 1), "v": pa.array([total.tolist()], pa.list_(pa.float64()))})


def fit_network(rows: DataFrame, depth: int = 2, width: int = WIDTH, vector: str = "features", label: str = "label", id_col: str = "vec_id", epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, dropout: float = DROPOUT, seed: int = 1) -> tuple[Network, int]:
    """A network fitted on all rows, and the epochs that it took.

    An epoch is a job: each task takes the shared state, makes Adam's steps over its rows a batch at a time, and the tasks' states, weighted by
    their rows, are added up piece by piece in tasks; only the mean, as large as the model, comes back. A tenth of the rows, by a hash of the
    id, is held out, and the state of least loss on it is the result. Rows without a label or a vector are left out.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows lie in tasks in the order of a hash, so that each task's are a sample of all.
    dealt = known.select(F.col(vector).cast("array<double>").alias("x"), (F.col(label) > 0).cast("double").alias("y"), (place == 0).alias("held_out"), F.xxhash64(F.col(id_col), F.lit(seed + 1)).alias("_h"))
    dealt = held(dealt.repartition(n, "_h").sortWithinPartitions("_h").drop("_h"), "network-rows")
    if dealt.isEmpty():
        raise ValueError("no rows to learn from")
    found = dealt.select(array_to_vector("x").alias("v")).agg(Summarizer.metrics("mean", "std").summary(F.col("v")).alias("s")).select("s.mean", "s.std").first()
    spread = found[1].toArray()
    net = Network.made(len(spread), depth, width, seed, found[0].toArray(), np.where(spread > 0, spread, 1.0))
    moments, steps, patience, best = np.zeros((2, len(net.numbers()))), 0, Patience(rate), None
    for epoch in range(epochs + 1):
        shared = spark.sparkContext.broadcast((net.to_bytes(), moments, steps))
        made = dealt.mapInArrow(_epoch(shared, patience.rate, dropout, batch, (seed, epoch)), "chunk int, v array<double>")
        added = {r.chunk: np.array(r.v) for r in made.groupBy("chunk").applyInArrow(_added, "chunk int, v array<double>").collect()}
        shared.destroy()
        lost, checked, learnt = added.pop(-1)
        loss = lost / checked if checked else -epoch  # without held-out rows the last state counts
        if best is None or loss < best[0]:
            best = loss, net.to_bytes(), epoch
        if not learnt or epoch == epochs or epoch and not patience.goes_on(loss):
            break
        mean = np.concatenate([added[i] for i in sorted(added)]) / learnt
        size = len(net.numbers())
        net.put(mean[:size])
        moments, steps = mean[size : 3 * size].reshape(2, size), round(mean[-1])
    return Network.from_bytes(best[1]), best[2]


def scored(rows: DataFrame, net: Network, vector: str = "features") -> DataFrame:
    """Column ``prob``; null for a null vector."""
    shared = rows.sparkSession.sparkContext.broadcast(net.to_bytes())

    def score(s: pd.Series) -> pd.Series:
        known = s.notna()
        out = pd.Series(np.nan, index=s.index, dtype="float64")
        if known.any():
            out[known] = Network.from_bytes(shared.value).predict(np.stack(s[known].to_numpy()).astype(np.float64))
        return out.astype(object).where(known, None)

    score.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return rows.withColumn("prob", F.pandas_udf(score, "double")(vector))


def expected_gradients(net: Network, x: np.ndarray, background: np.ndarray, points: int = 16) -> np.ndarray:
    """Each row's attributions to its inputs: the output's slopes along the ways from all background rows to it, times the ways, in the mean.

    A row's attributions sum to its output less the background's mean output, but for what ``points`` places on a way leave out.
    """
    node, weight = np.polynomial.legendre.leggauss(points)
    at, weight = (node + 1) / 2, weight / 2 / len(background)
    out = np.zeros(x.shape)
    step = max(1, (1 << 13) // (len(background) * points))
    for lo in range(0, len(x), step):
        way = x[lo : lo + step, None] - background[None]
        spots = background[None, :, None] + way[:, :, None] * at[:, None]
        slope = net.slopes(spots.reshape(-1, x.shape[1])).reshape(spots.shape)
        out[lo : lo + step] = np.einsum("rbpd,p,rbd->rd", slope, weight, way)
    return out


def attributions(rows: DataFrame, net: Network, background: np.ndarray, vector: str = "features", points: int = 16) -> DataFrame:
    """Columns ``prob``, ``mean_prob`` (of the background, some tens of rows) and ``values``: what each input adds to the output. A null vector has null in all."""
    shared = rows.sparkSession.sparkContext.broadcast((net.to_bytes(), background))

    def explain(s: pd.Series) -> pd.Series:
        data, ground = shared.value
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        known = np.flatnonzero(s.notna())
        if len(known):
            found = expected_gradients(Network.from_bytes(data), np.stack(s.iloc[known].to_numpy()).astype(np.float64), ground, points)
            for i, v in zip(known, found.tolist(), strict=True):
                out.iloc[i] = v
        return out

    explain.__annotations__ = {"s": pd.Series, "return": pd.Series}
    mean = F.when(F.col(vector).isNotNull(), F.lit(float(net.predict(background).mean())))
    return scored(rows, net, vector).withColumns({"mean_prob": mean, "values": F.pandas_udf(explain, "array<double>")(vector)})


def background_of(rows: DataFrame, vector: str = "features", id_col: str = "vec_id", n: int = 50, seed: int = 3) -> np.ndarray:
    """``n`` vectors, those whose ids' hashes come first."""
    some = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).select(vector).limit(n).collect()
    return np.array([r[0] for r in some], dtype=np.float64)


def mean_magnitude(explained: DataFrame) -> DataFrame:
    """(feature, importance): the mean size of each input's attributions, largest first."""
    each = explained.select(F.posexplode("values").alias("feature", "v"))
    return each.groupBy("feature").agg(F.avg(F.abs("v")).alias("importance")).orderBy(F.desc("importance"), "feature")


def depth_sweep(rows: DataFrame, depths: range = range(1, 6), seeds: tuple[int, ...] = (42, 101, 999), width: int = WIDTH, vector: str = "features", label: str = "label", id_col: str = "vec_id", epochs: int = EPOCHS) -> DataFrame:
    """(depth, seed, auc, accuracy, sensitivity, specificity) of networks on the 30 % of each class that a seed's split leaves out.

    Each depth and seed is a group of its own, fitted on a bounded sample of the split's other rows; all left-out rows are scored.
    """
    plain = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"), (F.col(label) > 0).cast("double").alias("y"))
    splits = [stratified_split(plain, "y", "id", 0.7, s) for s in seeds]
    seen, rest = None, None
    for s, split in zip(seeds, splits, strict=True):
        a = bounded_sample(split.where("train"), "y", "id", seed=s).select("id", "x", "y", F.lit(s).alias("seed"))
        b = split.where("not train").select("x", "y", F.lit(s).alias("seed"))
        seen, rest = (a, b) if seen is None else (seen.unionByName(a), rest.unionByName(b))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        depth, seed = int(group["depth"].iloc[0]), int(group["seed"].iloc[0])
        net = fit_here(np.stack(group["x"].to_numpy()), group["y"].to_numpy(), depth, width, seed, epochs)
        return pd.DataFrame({"depth": [depth], "seed": [seed], "net": [net.to_bytes()]})

    runs = seen.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    nets = {(r.depth, r.seed): bytes(r.net) for r in runs.groupBy("depth", "seed").applyInPandas(fit, "depth int, seed int, net binary").collect()}  # a model a group
    shared = rows.sparkSession.sparkContext.broadcast(nets)
    order = list(depths)

    def score(x: pd.Series, seed: pd.Series) -> pd.Series:
        out = np.zeros((len(x), len(order)))
        for s in seed.unique():
            own = (seed == s).to_numpy()
            v = np.stack(x[own].to_numpy())
            for j, d in enumerate(order):
                out[own, j] = Network.from_bytes(shared.value[d, int(s)]).predict(v)
        return pd.Series(out.tolist())

    score.__annotations__ = {"x": pd.Series, "seed": pd.Series, "return": pd.Series}
    each = rest.withColumn("p", F.pandas_udf(score, "array<double>")("x", "seed")).select("seed", "y", F.posexplode("p").alias("i", "p")).withColumn("depth", F.get(F.array(*map(F.lit, order)), "i"))
    yes, on = F.col("y") > 0.5, F.col("p") > 0.5
    counts = each.groupBy("depth", "seed").agg(F.avg((yes == on).cast("double")).alias("accuracy"), F.avg(F.when(yes, on.cast("double"))).alias("sensitivity"), F.avg(F.when(~yes, (~on).cast("double"))).alias("specificity"))
    u = mann_whitney(each.select("depth", "seed", yes.alias("yes"), "p"), ["depth", "seed"], "yes", "p")
    return u.select("depth", "seed", F.try_divide(F.col("u"), F.col("n1") * F.col("n2")).alias("auc")).join(counts, ["depth", "seed"])


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.col("label") >= 5).cast("double").alias("label"))


@query("m15_m17_depth_sweep")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths 1 to 5 with three seeds, 128 units a layer."""
    return depth_sweep(_embeddings(spark, sf_dir))


@query("m18_attributions")
def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of 64 inputs adds to the output of a network of two layers, for all rows."""
    rows = _embeddings(spark, sf_dir)
    net, _ = fit_network(rows)
    return attributions(rows, net, background_of(rows, n=20), points=8).select("vec_id", "prob", "mean_prob", "values")


@query("a20_attribution_importance")
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_magnitude(explained(spark, sf_dir))
