import math

import pytest
from pyspark.sql import functions as F

from strandlake.operators import kmers


def test_motifs(spark):
    df = spark.createDataFrame([("GGCATGG",), ("GGAATGG",), ("CAT",), ("AT",), ("CAGG",), (None,)], "kmer string")
    assert sorted(r.kmer for r in kmers.centre_in(df, kmers.TRIPLES).collect()) == ["CAGG", "CAT", "GGCATGG"]
    assert sorted(r.kmer for r in kmers.with_motif(df, "A[AT]G").collect()) == ["GGAATGG", "GGCATGG"]
    assert len(kmers.TRIPLES) == 9 and {"TAT", "CAG", "GAC"} < set(kmers.TRIPLES)


def test_common_keys(spark):
    rows = [("x", True), ("x", False), ("x", None), ("y", True), ("y", True), (None, True), (None, False), ("z", False), ("z", True), ("z", True)]
    df = spark.createDataFrame(rows, "k string, side boolean")
    got = sorted((r.k, r.side) for r in kmers.of_common_keys(df, "k", F.col("side"), 1).collect())
    assert got == [("x", False), ("x", True), ("z", False), ("z", True), ("z", True)]
    assert kmers.of_common_keys(df.limit(0), "k", F.col("side")).collect() == []


def test_wide_and_exploded(spark):
    df = spark.createDataFrame([(1, ["1", "x"], ["2", "NaN"]), (2, ["3"], ["4", "5"]), (3, [], []), (4, None, ["1"])], "i int, ipd array<string>, pw array<string>")
    assert [tuple(r) for r in kmers.wide(df, ["ipd", "pw"], 2).orderBy("i").collect()] == [(1, "1", "x", "2", "NaN"), (2, "3", None, "4", "5"), (3, None, None, None, None), (4, None, None, "1", None)]
    got = kmers.exploded(df, ["ipd", "pw"])
    assert got.columns == ["i", "place", "ipd", "pw"]
    rows = sorted((r.i, r.place, r.ipd, r.pw) for r in got.collect())
    assert [r[:3] for r in rows] == [(1, 1, 1.0), (1, 2, None), (2, 1, 3.0), (2, 2, None)] and rows[3][3] == 5 and math.isnan(rows[1][3])
    assert sorted((r.i, r.place) for r in kmers.with_numbers(got, ["ipd", "pw"]).collect()) == [(1, 1), (2, 1)]


def test_training_text(spark, tmp_path):
    rows = [(1, [0.5, 0.0, -2.0]), (2, []), (3, None), (4, [0.0, 1e-7, None])]
    df = spark.createDataFrame(rows, "label int, features array<double>")
    lines = {r.label: r.line for r in df.select("label", kmers.training_line(F.col("label"), F.col("features")).alias("line")).collect()}
    assert lines == {1: "1 1:0.5 3:-2.0", 2: "2", 3: "3", 4: "4 2:1.0E-7"}
    kmers.write_training_text(df, str(tmp_path / "t"))
    for dims in (3, None):
        back = {int(r.label): r.features for r in kmers.read_training_text(spark, str(tmp_path / "t"), dims).collect()}
        assert back == {1: [0.5, 0, -2.0], 2: [0, 0, 0], 3: [0, 0, 0], 4: [0, 1e-7, 0]}
    with pytest.raises(Exception, match="without a label"):
        spark.createDataFrame([(None, [1.0])], "label int, features array<double>").select(kmers.training_line(F.col("label"), F.col("features"))).collect()


def test_counters_and_order(spark):
    df = spark.createDataFrame([(i, "ACGT" * (i % 3)) for i in range(50)], "id long, seq string")
    for n in (50, 0):
        rows, seen = kmers.counted(df.where(F.col("id") < n), F.lit(2), F.length("seq"))
        assert rows.count() == n
        assert seen.get == {"reads": n, "samples": 2 * n, "bases": sum(4 * (i % 3) for i in range(n))}
    order = [r.id for r in kmers.shuffled(df, "id", 1).collect()]
    assert sorted(order) == list(range(50)) and order != sorted(order)
    assert order == [r.id for r in kmers.shuffled(df.repartition(7), "id", 1).collect()] != [r.id for r in kmers.shuffled(df, "id", 2).collect()]
