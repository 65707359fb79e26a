"""Ranks, adjusted p-values, areas under curves and splits over many ranges, against numpy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.operators import rows, sources_lr, stats

N = 300_000


@pytest.fixture(params=[8, 200])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def table(spark):
    """Ids, values of many ties and some nulls, labels, and columns that play no part."""
    i = F.col("id")
    p = F.when(i % 1000 == 7, F.lit(None).cast("double")).otherwise(F.pow(F.pmod(F.xxhash64("id"), F.lit(50_000)) / 50_000.0, F.lit(3.0)))
    label = (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10)) < 3).cast("int")
    return spark.range(0, N, 1, 7).select(i, p.alias("p"), label.alias("y"), F.repeat(F.lit("x"), 5).alias("_part_name"), F.xxhash64("id", F.lit(3)).alias("other"))


def test_adjusted_p_values(spark, parts):
    t = table(spark)
    got = stats.benjamini_hochberg(t, "p", "id")
    assert got.columns == [*t.columns, "adjusted"]
    got = got.select("id", "other", "adjusted").toPandas().sort_values("id")
    raw = t.select("id", "p", "other").toPandas().sort_values("id")
    p = raw["p"].fillna(1.0).to_numpy()
    order = np.argsort(p, kind="stable")
    want = np.empty(N)
    want[order] = np.minimum(1, np.minimum.accumulate((p[order] * N / np.arange(1, N + 1))[::-1])[::-1])
    assert (got["other"].to_numpy() == raw["other"].to_numpy()).all()
    assert np.abs(got["adjusted"].to_numpy() - want).max() < 1e-12


def test_ordinals(spark, parts):
    t = table(spark)
    got = rows.numbered(t, "y", "p", "id").toPandas()
    assert sorted(got["ordinal"]) == list(range(N))
    got = got.sort_values("ordinal")
    key = [(y, -1.0 if math.isnan(p) else p, i) for y, p, i in zip(got["y"], got["p"], got["id"], strict=True)]
    assert key == sorted(key)


def test_area_under_the_curve(spark, parts):
    t = table(spark).where("p is not null").withColumn("p", F.round(F.col("p") + 0.1 * F.col("y"), 3))
    got = stats.binary_scores(t, "y", "p").first()
    raw = t.select("p", "y").toPandas()
    values, place, n = np.unique(raw["p"], return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    yes = raw["y"].to_numpy() == 1
    want = (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())
    assert abs(got.auc - want) < 1e-12 and got.n == len(raw)


def test_split_stays_the_same(spark, parts):
    """Halves that are evaluated apart never overlap, and each class has its share."""
    split = sources_lr.stratified_split(table(spark), "y", "id", 0.7)
    train = {r.id: r.y for r in split.where("train").select("id", "y").collect()}
    rest = {r.id: r.y for r in split.where("not train").select("id", "y").collect()}
    assert not train.keys() & rest.keys() and len(train) + len(rest) == N
    for y in (0, 1):
        n = sum(v == y for v in train.values())
        assert n == math.ceil(0.7 * (n + sum(v == y for v in rest.values()) - 1))


VALUES = st.lists(st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True), st.sampled_from([0.0, -0.0, 1.5, 5e-324, 1.7e308, -1.7e308])), min_size=1, max_size=12)


@settings(max_examples=12, deadline=None)
@given(VALUES, st.integers(0, 11))
def test_order_statistics(spark, values, k):
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    if k >= len(known):
        with pytest.raises(IndexError):
            rows.order_statistic(df, "x", k, few=2)
    else:
        assert rows.order_statistic(df, "x", k, few=2) == known[k]


def test_quantiles_with_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, inf, -inf)], "x double").coalesce(1)
    assert [rows.quantile(df, "x", q) for q in (0, 0.5, 1)] == [-inf, 1.5, inf]
    assert rows.quantile(df.where("x = 0"), "x", 0.5) is None
