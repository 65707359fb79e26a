"""Machines of all rows of a table against their optimality conditions and the solver for a task's rows."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandlake import catalog
from strandlake.operators import machines, svm
from strandlake.operators.rows import dropped, shared_dir
from strandlake.operators.sources_lr import stratified_split


def sample(n, seed=1, dims=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32).astype(np.float64)
    return x, np.where(x[:, 0] + 0.7 * np.sin(3 * x[:, 1]) + 0.8 * rng.standard_normal(n) > 0, 1, -1)


def frame(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "vec_id long, features array<double>, label int")


def left(spark):
    at = f"{shared_dir(spark)}/strandlake"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


@pytest.mark.parametrize(("name", "cost", "working"), [("rbf", 1.0, 128), ("linear", 0.1, 64)])
def test_all_rows_meet_the_conditions(spark, name, cost, working):
    """More rows than a sample had, many tiles and rounds; the decisions are those of the plain solver."""
    x, y = sample(2600)
    before = left(spark)
    m = machines.fit(frame(spark, x, y), cost=cost, name=name, tile=300, working=working)
    rows = [v for r in m.support.collect() for v in zip(np.reshape(r.x, (len(r.y), -1)).tolist(), r.y, r.s, strict=True)]
    assert len(rows) == len(x) and {tuple(v) for v, *_ in rows} == {tuple(v) for v in x.tolist()}
    own, sign, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    a, d = s * sign, svm.Svm(own, s, m.rho, name=name).decide(own)
    assert abs(s.sum()) < 1e-9 and (a >= 0).all() and (a <= cost).all()
    assert (sign * d)[a == 0].min() > 1 - 2e-3 and (sign * d)[a == cost].max() < 1 + 2e-3 and np.abs((sign * d)[(a > 0) & (a < cost)] - 1).max() < 2e-3
    fresh = sample(500, 2)[0]
    got = machines.decided(frame(spark, fresh, np.arange(500)), m, "label")
    plain = svm.train(x, y, cost=cost, name=name, eps=1e-4).decide(fresh)
    assert np.abs(np.array([r.decision for r in got.orderBy("label").collect()]) - plain).max() < 5e-3
    dropped(m.support, got)
    assert left(spark) == before


def test_query_takes_all_rows(spark, tmp_path):
    """More training rows than the sample had; rows whose decision is near 0 may fall on either side."""
    x, y = sample(4400, 3)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32())), "label": np.where(y > 0, 7, 2)}), tmp_path / "embeddings.parquet")
    train = {r.vec_id for r in stratified_split(frame(spark, x, y), "label", "vec_id").where("train").collect()}
    own = np.isin(np.arange(len(x)), list(train))
    d = svm.train(x[own], y[own], eps=1e-4).decide(x[~own])
    got, yes = catalog.QUERIES["m2_m3_train_validate"](spark, str(tmp_path)).first(), y[~own] > 0
    assert own.sum() > 3000 and got.n == len(d)
    for n, side, on in ((got.tp, yes, d >= 0), (got.fp, ~yes, d >= 0), (got.tn, ~yes, d < 0), (got.fn, yes, d < 0)):
        assert abs(n - (side & on).sum()) <= (side & (np.abs(d) < 2e-3)).sum()
    wins = (d[yes][:, None] > d[~yes]).mean()
    assert abs(got.auc - wins) < 1e-4


def test_odd_rows(spark):
    """One class, copies, vectors and labels that are null, and no rows."""
    x, y = sample(200, 5)
    x[50:120], y[50:120] = x[0], 1
    some = frame(spark, x, y)
    odd = some.unionByName(spark.createDataFrame([(1000, None, 1), (1001, x[1].tolist(), None)], some.schema))
    plain = svm.train(x, y, eps=1e-5).decide(x)
    for tile in (30, 1024):
        m = machines.fit(odd, tile=tile, working=40)
        d = {r.vec_id: r.decision for r in machines.decided(odd, m, "vec_id").collect()}
        assert set(d) == {*range(200), 1001} and np.abs(np.array([d[i] for i in range(200)]) - plain).max() < 5e-3
    for k in (1, -1):
        m = machines.fit(some.where(f"label = {k}"))
        assert {r.decision for r in machines.decided(some, m, "vec_id").collect()} == {float(k)}
    m = machines.fit(some.where("label = 5"))
    assert {r.decision for r in machines.decided(some, m, "vec_id").collect()} == {0.0}
    with pytest.raises(ArithmeticError):
        machines.fit(some.unionByName(spark.createDataFrame([(1000, [float("nan")] * 4, 1)], some.schema)), tile=100)


def test_problem_of_some_rows():
    """With many copies the kernel is singular; the conditions hold all the same."""
    x, y = sample(150, 7)
    x = np.concatenate([x, x[:80], np.repeat(x[:1], 40, axis=0)])
    y = np.concatenate([y, -y[:80], np.ones(40)]).astype(float)
    k = svm.Svm(x[:0], np.zeros(0), 0.0).gram(x, x)
    low, high = np.minimum(0, y), np.maximum(0, y)
    s = machines.solve_rows(k, -y, low, high, np.zeros(len(y)), 1e-6)
    v = y - k @ s
    assert abs(s.sum()) < 1e-12 and (s >= low).all() and (s <= high).all() and v[s < high].max() - v[s > low].min() < 1e-5
