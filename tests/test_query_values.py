"""Queries without SQL against plain code."""

import math
from collections import defaultdict

import numpy as np
import pytest

from strandlake import catalog
from strandlake.operators import ml, stats, svm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet").toPandas()


def tail(t, df):
    """Two-sided p of Student's t by Simpson's rule over the density, in the angle whose tangent is t over the root of df."""
    top = math.atan(abs(t) / math.sqrt(df))
    x = np.linspace(0, top, 4001)
    y = np.cos(x) ** (df - 1)
    area = (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return 1 - 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def student(a, b):
    df = len(a) + len(b) - 2
    pooled = ((len(a) - 1) * np.var(a, ddof=1) + (len(b) - 1) * np.var(b, ddof=1)) / df if len(a) > 1 and len(b) > 1 else math.nan
    return (np.mean(a) - np.mean(b)) / math.sqrt(pooled * (1 / len(a) + 1 / len(b))) if pooled > 0 else math.nan, df


def test_p_values(spark, lineitem):
    got = {(r.np, r.platform): r for r in catalog.QUERIES["a13_p_values"](spark, SF).collect()}
    for (n, platform), g in lineitem[lineitem.l_quantity < 100].groupby(["l_linenumber", "l_returnflag"]):
        a, b = g.l_quantity[g.l_linestatus == "O"].to_numpy(), g.l_quantity[g.l_linestatus != "O"].to_numpy()
        t, df = student(a, b)
        assert got[n, platform].df == df and abs(got[n, platform].t - t) < 1e-6 and abs(got[n, platform].p - tail(t, df)) < 1e-6


def test_signal_tests(spark, lineitem):
    values = defaultdict(list)
    for k, place, v, s in zip(lineitem.l_suppkey, lineitem.l_linenumber, lineitem.l_quantity + 0.5, lineitem.l_linestatus, strict=True):
        values[k, place, s == "O"].append(v)
    ratios = defaultdict(list)
    for k, place, z in values:
        if z and (k, place, False) in values:
            ratios[k].append(np.median(values[k, place, True]) / np.median(values[k, place, False]))
    want = {}
    for k, place, z in values:
        if z and (k, place, False) in values:
            a, b = np.array(values[k, place, False]), np.array(values[k, place, True]) / np.median(ratios[k])
            t, df = student(a, b)
            want[k, place] = [np.median(b) / np.median(a), t, df, 1.0 if math.isnan(t) else tail(t, df)]
    p = np.array([w[3] for w in want.values()])
    order = np.argsort(p)
    adjusted = np.empty(len(p))
    adjusted[order] = np.minimum(1, np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    got = {(r.kmer, r.place): r for r in catalog.QUERIES["a13_a15_signal_tests"](spark, SF).collect()}
    both = {k: r for k, r in got.items() if r.ratio is not None}
    assert set(both) == set(want)
    for (key, (ratio, t, df, p_value)), a in zip(want.items(), adjusted, strict=True):
        r = got[key]
        assert abs(r.ratio - ratio) < 1e-6 and r.df == df and abs(r.p - p_value) < 1e-6 and abs(r.adjusted - a) < 1e-6
        assert (r.t is None or math.isnan(r.t)) if math.isnan(t) else abs(r.t - t) < 1e-6


def embedded(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    return e["vec_id"].to_numpy(), np.stack(e["embedding"].to_numpy()).astype(np.float64), np.where(e["label"] >= 5, 1.0, -1.0)


def test_grid_search_and_probabilities(spark):
    """All rows are in the sample at this size, so plain folds give the same accuracies."""
    ids, x, y = embedded(spark)
    decided = {(r.cost, r.gamma, r.id): r.decision for r in ml.out_of_fold(ml._samples(spark, SF), [(0.5, 0.25), (2.0, 0.5)], vector="embedding").collect()}
    folds = {r.id: r.fold for r in ml.out_of_fold(ml._samples(spark, SF), [(0.5, 0.25)], vector="embedding").collect()}
    fold = np.array([folds[i] for i in ids])
    assert max(np.bincount(fold)) - min(np.bincount(fold)) <= 2
    found = {(r.cost, r.gamma): r for r in catalog.QUERIES["m10_m13_grid_search"](spark, SF).collect()}
    for cost, gamma in ((0.5, 0.25), (2.0, 0.5)):
        plain = np.zeros(len(y))
        for f in range(5):
            plain[fold == f] = svm.train(x[fold != f], y[fold != f], cost=cost, gamma=gamma).decide(x[fold == f])
        assert np.abs(plain - [decided[cost, gamma, i] for i in ids]).max() < 1e-9
        assert found[cost, gamma].n == len(y) and abs(found[cost, gamma].accuracy - ((plain > 0) == (y > 0)).mean()) < 1e-12
    whole = svm.train(x, y)
    rows = {r.vec_id: r for r in catalog.QUERIES["m9_probabilities"](spark, SF).collect()}
    assert np.abs(whole.decide(x) - [rows[i].decision for i in ids]).max() < 1e-9
    logit = np.array([math.log(rows[i].prob / (1 - rows[i].prob)) for i in ids])
    slope, offset = np.polyfit([rows[i].decision for i in ids], logit, 1)
    assert np.abs(slope * np.array([rows[i].decision for i in ids]) + offset - logit).max() < 1e-6


def test_train_and_validate(spark):
    """The counts are those of the machine of the split's training rows on its other rows."""
    from strandlake.operators.sources_lr import stratified_split

    ids, x, y = embedded(spark)
    rows = spark.createDataFrame([(int(i), int(v)) for i, v in zip(ids, y, strict=True)], "vec_id long, label int")
    train = {r.vec_id for r in stratified_split(rows, "label", "vec_id").where("train").collect()}
    own = np.array([i in train for i in ids])
    d = svm.train(x[own], y[own]).decide(x[~own])
    got = catalog.QUERIES["m2_m3_train_validate"](spark, SF).first()
    want = [(y[~own] > 0) & (d >= 0), (y[~own] < 0) & (d >= 0), (y[~own] < 0) & (d < 0), (y[~own] > 0) & (d < 0)]
    assert [got.tp, got.fp, got.tn, got.fn] == [int(w.sum()) for w in want]
    wins = (d[y[~own] > 0][:, None] > d[y[~own] < 0]).mean() + (d[y[~own] > 0][:, None] == d[y[~own] < 0]).mean() / 2
    assert abs(got.auc - wins) < 1e-9


def test_tail_of_large_and_small_degrees():
    for t, df in ((0.5, 1), (2.0, 3), (4.0, 200)):
        assert abs(stats.t_tail(t, df) - tail(t, df)) < 1e-9
