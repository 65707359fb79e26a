"""Networks: gradients against differences, training over partitions, attributions that add up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import nets

SF = "/root/testdata/sf0.001"


def points(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 6)) * [1, 2, 5, 1, 1, 1] + 3
    z = (x - 3) / [1, 2, 5, 1, 1, 1]
    return x, (z[:, 0] * z[:, 1] + 0.5 * z[:, 2] + 0.2 * rng.standard_normal(n) > 0).astype(float)


def auc(p, y):
    rank = np.argsort(np.argsort(p)) + 1.0
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_gradients_equal_differences():
    x, y = points(40)
    net = nets.Network.made(6, 2, 5, 3, x.mean(0), x.std(0))
    rng = np.random.default_rng(0)
    for a, moves in zip(net.arrays(), net.learnt(), strict=True):
        a += moves * 0.3 * rng.standard_normal(a.shape)
    loss = lambda: net.gradients(x, y, 0.3, np.random.default_rng(5))[0]
    _, found = net.gradients(x, y, 0.3, np.random.default_rng(5))
    for a, g, moves in zip(net.arrays(), found, net.learnt(), strict=True):
        for i in np.ndindex(a.shape) if moves else ():
            old = a[i]
            a[i] = old + 1e-6
            up = loss()
            a[i] = old - 1e-6
            down = loss()
            a[i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_slopes_equal_differences():
    x, y = points(300)
    net = nets.fit_here(x, y, 2, 8, epochs=5)
    got = net.slopes(x[:20])
    for j in range(6):
        e = np.zeros(6)
        e[j] = 1e-6
        assert np.abs((net.predict(x[:20] + e) - net.predict(x[:20] - e)) / 2e-6 - got[:, j]).max() < 1e-5
    assert np.array_equal(nets.Network.from_bytes(net.to_bytes()).predict(x), net.predict(x))


def test_attributions_sum_to_what_the_output_gains():
    x, y = points(1500)
    net = nets.fit_here(x, y, 2, 32, epochs=20)
    values = nets.expected_gradients(net, x[:30], x[100:140], 64)
    assert np.abs(values.sum(1) - (net.predict(x[:30]) - net.predict(x[100:140]).mean())).max() < 5e-3
    assert np.abs(values).mean(0)[:3].min() > 3 * np.abs(values).mean(0)[3:].max()


@pytest.mark.parametrize("depth", [1, 3])
def test_fit_here_learns_what_is_not_linear(depth):
    x, y = points(3000)
    test = points(1000, 9)
    assert auc(nets.fit_here(x, y, depth, 64).predict(test[0]), test[1]) > 0.93


def test_training_over_partitions(spark):
    x, y = points(6000)
    rows = [(i, v, t) for i, (v, t) in enumerate(zip(x.tolist(), y.tolist(), strict=True))] + [(-1, None, 1.0), (-2, x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, label double")
    net, epochs = nets.fit_network(df, width=32, epochs=15, batch=64)
    test = points(1000, 9)
    assert epochs > 2 and auc(net.predict(test[0]), test[1]) > 0.93
    again, _ = nets.fit_network(df, width=32, epochs=15, batch=64)
    assert np.abs(again.predict(x[:50]) - net.predict(x[:50])).max() < 0.05
    out = nets.attributions(df, net, nets.background_of(df, n=10), points=32)
    for r in out.where("vec_id < 20").collect():
        if r.vec_id == -1:
            assert (r.prob, r.mean_prob, r["values"]) == (None, None, None)
        else:
            assert abs(sum(r["values"]) - (r.prob - r.mean_prob)) < 0.02
    mean = {r.feature: r.importance for r in nets.mean_magnitude(out.where("vec_id between 0 and 200")).collect()}
    assert min(mean[i] for i in range(3)) > max(mean[i] for i in range(3, 6))
    with pytest.raises(ValueError, match="no rows"):
        nets.fit_network(df.limit(0))


def test_depth_sweep(spark):
    x, y = points(2600)
    df = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "vec_id long, features array<double>, label double")
    out = nets.depth_sweep(df, depths=range(1, 4), seeds=(1, 2), width=64).collect()
    assert {(r.depth, r.seed) for r in out} == {(d, s) for d in (1, 2, 3) for s in (1, 2)}
    assert all(r.auc > 0.85 and r.accuracy > 0.7 and 0 < r.sensitivity <= 1 and 0 < r.specificity <= 1 for r in out)


def test_queries(spark):
    rows = nets.explained(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert all(len(r["values"]) == 64 and abs(sum(r["values"]) - (r.prob - r.mean_prob)) < 0.1 for r in rows)
    assert nets.sweep(spark, SF).select(F.count_if((F.col("auc") >= 0) & (F.col("auc") <= 1))).first()[0] == 15
