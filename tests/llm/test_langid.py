import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import langid

SF = "/root/testdata/sf0.01"


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    out = docs.select("doc_id", "lang").join(langid.identify(docs, model), "doc_id").where(langid.held_out()).toPandas()
    assert len(out) > 150 and (out.lang == out.lang_pred).mean() > 0.97
    assert ((out.score > 0) & (out.score <= 1)).all()
    assert langid.known_languages(docs, model, 0.3).schema == docs.schema


def test_language_source_and_id_play_no_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    other = docs.withColumns({"doc_id": F.col("doc_id") + 7, "lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    a = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    b = {r.doc_id - 7: r for r in langid.identify(other, model).collect()}
    assert all((a[k].lang_pred, a[k].score) == (b[k].lang_pred, b[k].score) for k in a)


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in langid.fit(spoiled).languages
    assert [r[0] for r in spark.range(50).select(langid.held_out("id")).collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)]


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = [(1, None), (2, ""), (3, "123 !? 4"), (None, "the of and"), (5, "the and of to " * 30000), (5, "der die das und ist"), (6, "±×÷"), (7, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as lang_pred", "1 as score")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df, model).collect()]
    assert (5, "en") in got and (5, "de") in got and (None, "en") in got
    assert sorted(i for i, p in got if p == "und") == [1, 2, 3, 6]
    assert langid.identify(df.limit(0), model).collect() == []
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.identify(df, one).collect()} == {"und", "fr"}


def plain_prediction(model, vector):
    """One text: each machine's decision in turn, votes by hand."""

    def winner(m):
        wins, total = {n: 0 for n in m.names}, {n: 0.0 for n in m.names}
        for a, b, w in zip(m.first, m.second, m.weights, strict=True):
            d = sum(float(v) * float(u) for v, u in zip(vector, w[:-1], strict=True)) + float(w[-1])
            p = 1 / (1 + math.exp(-2 * min(30, max(-30, d))))
            wins[m.names[a]] += p >= 0.5
            wins[m.names[b]] += p <= 0.5
            total[m.names[a]] += p
            total[m.names[b]] += 1 - p
        best = sorted(m.names, key=lambda n: (-wins[n], -total[n], n))[0]
        return best, total[best] / (len(m.names) - 1) if len(m.names) > 1 else 1.0

    family, sure = winner(model.between)
    lang, own = winner(model.within[family])
    return lang, sure * own


def test_query_equals_plain_predictions(spark):
    """Every row of the query on the smallest tables, by votes counted one by one."""
    from strandlake.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in queries.QUERIES["op9_language_id"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    x, lettered = langid.features(pa.array([r.text for r in rows], pa.string()))
    for r, v, known in zip(rows, x, lettered, strict=True):
        lang, score = plain_prediction(model, v) if known else ("und", 0.0)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-6
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_machine_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 30)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * rng.standard_normal(120) > 0.4, 1.0, -1.0)
    w = langid.support_vector_machine(x, y)
    full = np.hstack([x.astype(np.float64), np.ones((120, 1))])
    each = np.array([120 / (2 * (y == v).sum()) * 100 / 120 for v in y])
    loss = lambda v: v @ v / 2 + (each * np.maximum(0, 1 - y * (full @ v)) ** 2).sum()
    for i in range(31):
        step = np.zeros(31)
        step[i] = 1e-4
        assert loss(w) <= min(loss(w + step), loss(w - step)) + 1e-9


def test_ties_in_votes():
    """Three names that each win once: the larger sum of margins decides, then the first name."""
    one = np.zeros((1, langid.FEATURES), dtype=np.float32)
    weights = np.zeros((3, langid.FEATURES + 1))
    weights[:, -1] = [0.2, -0.2, 0.2]  # a beats b, c beats a, b beats c
    m = langid.Machines(["a", "b", "c"], np.array([0, 0, 1]), np.array([1, 2, 2]), weights)
    assert langid._vote(one, m)[0].tolist() == [0]
    weights[2, -1] = 0.9
    assert langid._vote(one, m)[0].tolist() == [1]
    m = langid.Machines(["a", "b"], np.array([0]), np.array([1]), np.zeros((1, langid.FEATURES + 1)))
    assert langid._vote(one, m)[0].tolist() == [0]


@pytest.mark.parametrize("labels", [30, 4500])
def test_many_languages(spark, labels):
    """With more labels than are learnt the frequent ones still are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.range(labels).select((F.col("id") + 10**6).alias("doc_id"), F.concat(F.lit("qx zyx "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("lang"))
    model = langid.fit(docs.unionByName(odd))
    assert {"de", "en", "es", "fr"} <= set(model.languages) and 4 < len(model.languages) <= langid.MOST_LANGUAGES
    out = docs.join(langid.identify(docs, model), "doc_id").where(langid.held_out()).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.9
