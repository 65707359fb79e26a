"""Machines of all forms against their optimality conditions; bounded memory; several classes."""

import tracemalloc

import numpy as np
import pytest

from strandlake.operators import ml, svm


def sample(n, seed=1, dims=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    return x, np.where(x[:, 0] + 0.7 * np.sin(3 * x[:, 1]) + 0.3 * rng.standard_normal(n) > 0, 1.0, -1.0), rng


def spread_out(m, x):
    """A coefficient for each row of x."""
    place = {tuple(v): i for i, v in enumerate(x.tolist())}
    out = np.zeros(len(x))
    for v, c in zip(m.vectors.tolist(), m.coefficients, strict=True):
        out[place[tuple(v)]] = c
    return out


@pytest.mark.parametrize("name", ["rbf", "linear", "polynomial"])
def test_c_svc(name):
    x, y, _ = sample(400)
    m = svm.train(x, y, cost=2.0, name=name, coef0=1.0, degree=2)
    a, f = spread_out(m, x) * y, y * m.decide(x)
    assert abs((a * y).sum()) < 1e-9 and (a > -1e-12).all() and (a < 2 + 1e-12).all()
    assert (f[a == 0] > 1 - 3e-3).all() and (f[a == 2] < 1 + 3e-3).all() and (np.abs(f[(a > 0) & (a < 2)] - 1) < 3e-3).all()


def test_nu_svc():
    x, y, _ = sample(400)
    m = svm.train(x, y, "nu_svc", nu=0.4)
    a, f = spread_out(m, x) * y, y * m.decide(x)
    top = a.max()
    assert abs((a * y).sum()) < 1e-9 * top and abs(a.sum() / top - 0.4 * 400) < 1e-6 * 400
    assert (f[a == 0] > 1 - 0.03).all() and (f[a >= top * (1 - 1e-12)] < 1 + 0.03).all() and (np.abs(f[(a > 0) & (a < top * (1 - 1e-12))] - 1) < 0.03).all()
    assert (f < 1 - 0.03).mean() <= 0.4 <= (a > 0).mean()
    with pytest.raises(ValueError, match="too large"):
        svm.train(x, np.where(np.arange(400) < 5, 1.0, -1.0), "nu_svc", nu=0.9)


def test_one_class():
    x, _, _ = sample(300)
    m = svm.train(x, np.zeros(300), "one_class", nu=0.2)
    a, f = spread_out(m, x), m.decide(x)
    assert abs(a.sum() - 60) < 1e-9 and (f[a == 0] > -3e-3).all() and (f[a == 1] < 3e-3).all() and (np.abs(f[(a > 0) & (a < 1)]) < 3e-3).all()


@pytest.mark.parametrize("form", ["epsilon_svr", "nu_svr"])
def test_regression(form):
    x, _, rng = sample(300)
    z = np.sin(x[:, 0]) + 0.1 * rng.standard_normal(300)
    m = svm.train(x, z, form, cost=3.0, tube=0.15, nu=0.3)
    c, rest = spread_out(m, x), z - m.decide(x)
    tube = 0.15 if form == "epsilon_svr" else np.abs(rest[(np.abs(c) > 0) & (np.abs(c) < 3)]).mean()
    assert abs(c.sum()) < 1e-9 and (np.abs(c) <= 3 + 1e-12).all()
    assert (np.abs(rest[c == 0]) < tube + 4e-3).all() and (rest[c == 3] > tube - 4e-3).all() and (rest[c == -3] < -tube + 4e-3).all()
    assert (np.abs(np.abs(rest[(c != 0) & (np.abs(c) < 3)]) - tube) < 4e-3).all()
    if form == "nu_svr":
        assert abs(np.abs(c).sum() - 3 * 0.3 * 300) < 3 * 0.3 * 300 * 0.1


def test_shrinking_and_few_columns_change_nothing():
    x, y, _ = sample(2000, 3)
    whole = svm.train(x, y, cost=4.0, eps=1e-5, shrinking=False)
    for m in (svm.train(x, y, cost=4.0, eps=1e-5), svm.train(x, y, cost=4.0, eps=1e-5, cache_bytes=40 * 8 * 2000)):
        assert np.abs(m.decide(x) - whole.decide(x)).max() < 1e-3 and abs(m.rho - whole.rho) < 1e-3


def test_memory_is_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20_000, 8))
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    x[:, 0] += 2 * y  # classes apart: few support vectors
    tracemalloc.start()
    m = svm.train(x, y, cost=1.0, gamma=0.1, cache_bytes=50 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20 and (np.sign(m.decide(x[:500])) == y[:500]).all()


def test_precomputed_kernel_and_model_files():
    x, y, _ = sample(150)
    plain = svm.train(x, y, cost=2.0)
    k = plain.gram(x, x)
    m = svm.train(k, y, cost=2.0, name="precomputed")
    assert np.abs(m.decide(k) - plain.decide(x)).max() < 1e-9
    for one, rows in ((m, k), (plain, x), (svm.train(x, x[:, 0], "epsilon_svr"), x), (svm.train(x, y, "one_class"), x)):
        back = svm.Svm.from_text(one.to_text(), None if one is m else 4)
        assert back.form == one.form and np.abs(back.decide(rows) - one.decide(rows)).max() < 1e-9


def test_coupling_equals_a_fixed_point():
    rng = np.random.default_rng(2)
    r = rng.uniform(0.05, 0.95, (20, 5, 5))
    r = np.where(np.arange(5)[:, None] < np.arange(5), r, 1 - r.transpose(0, 2, 1))
    got = svm.coupled(r)
    for row, p in zip(r, got, strict=True):
        q = -row * row.T
        np.fill_diagonal(q, [sum(row[s, i] ** 2 for s in range(5) if s != i) for i in range(5)])
        x = np.full(5, 0.2)
        for _ in range(20_000):
            t = int(_ % 5)
            x[t] = (-(q[t] @ x - q[t, t] * x[t]) + x @ q @ x) / q[t, t]
            x /= x.sum()
        assert np.abs(p - x).max() < 1e-6


def test_sigmoid():
    rng = np.random.default_rng(4)
    d = rng.standard_normal(20_000) * 2
    yes = rng.random(20_000) < 1 / (1 + np.exp(-1.5 * d + 0.3))
    a, b = svm.sigmoid_of(d, yes)
    assert abs(a + 1.5) < 0.06 and abs(b - 0.3) < 0.06


def test_class_probabilities(spark):
    rng = np.random.default_rng(6)
    centre = {"a": (0, 0), "b": (3, 0), "c": (0, 3)}
    rows = [(i, [float(v) for v in rng.standard_normal(2) + centre[k]], k) for i, k in enumerate(rng.choice(list(centre), 240).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, label string")
    model = ml.fit_classes(df, vector="features", label="label")
    assert model.labels == ["a", "b", "c"]
    out = ml.class_probabilities(df.drop("label"), model, "features").toPandas().sort_values("vec_id")
    p = np.stack(out["probs"].to_numpy())
    assert np.abs(p.sum(1) - 1).max() < 1e-9
    assert (out["predicted"].to_numpy() == np.array([r[2] for r in rows])).mean() > 0.9
    assert (np.array(model.labels)[p.argmax(1)] == out["predicted"].to_numpy()).all()
    sure = p.max(1)
    assert sure.mean() > 0.75
    one = ml.fit_classes(df.where("label = 'a'"), vector="features", label="label")
    assert {(r.predicted, tuple(r.probs)) for r in ml.class_probabilities(df, one, "features").collect()} == {("a", (1.0,))}
