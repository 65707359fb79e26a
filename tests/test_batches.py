"""Memory of Python workers doesn't grow with partitions: Arrow batches are bounded by bytes, features that are only worked on further stay in their task."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.operators import alignment, calls, reads
from strandlake.operators.rows import BATCH_BYTES, BATCH_ROWS, by_read, letters
from strandlake.plans import driver_views as views

NAMES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(256 << 20)}


@pytest.fixture
def large_batches(spark):
    """The session's settings as they are by default; they come back."""
    before = {n: spark.conf.get(n) for n in NAMES}
    for n, v in NAMES.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def bounded(spark) -> bool:
    return [int(spark.conf.get(n)) for n in NAMES] == [BATCH_ROWS, BATCH_BYTES]


def test_batches_of_reads_are_bounded_by_bytes(large_batches):
    rows = large_batches.range(0, 9000, 1, 1).select(F.col("id").alias("read_id"), F.repeat(F.lit("ACGT"), 500).alias("seq"))
    most = by_read(rows, lambda b, i: {"n": pa.array([b.num_rows], pa.int32())}, "n int").agg(F.max("n"), F.count("*")).first()
    assert most[0] * 2000 < 2 * BATCH_BYTES and most[1] == 9000


def test_reads_joined_with_their_calls_come_in_bounded_batches(large_batches):
    """One partition of one shuffle, as large ones have it: what a worker gets at once is bounded, and every read comes."""
    rows = large_batches.range(0, 6000, 1, 1).select(F.col("id").alias("read_id"), F.repeat(F.lit("ACGT"), 1000).alias("seq"))
    made = rows.select("read_id", F.explode(F.sequence(F.lit(0), F.lit(30), F.lit(3))).alias("pos"), F.lit(0.75).alias("prob"))
    both = rows.join(calls.grouped_calls(made).hint("merge"), "read_id").repartition(1)
    most = by_read(both, lambda b, i: {"n": pa.array([b.nbytes]), "calls": pa.array([len(calls.called(b, i, letters(b.column("seq")[i].as_py()))[0])])}, "n long, calls long")
    assert most.agg(F.max("n") < 2 * BATCH_BYTES, F.count("*"), F.min("calls"), F.max("calls")).first()[:] == (True, 6000, 6, 6)


@pytest.mark.parametrize("query", [reads.quantiles, reads.context, reads.kmer_features, calls.relabel_in_order, alignment.bases])
def test_queries_over_reads_bound_their_batches(large_batches, query):
    query(large_batches, "/root/testdata/sf0.001")
    assert bounded(large_batches)


def test_features_of_a_digest_stay_in_their_task(spark):
    plan = reads.kmer_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "features" not in plan


def test_signals_of_a_digest_stay_in_their_task(spark):
    """No list of signals leaves Python, where only its weighted sum is asked for."""
    plan = reads.context(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow") and plan.count("MapInArrow") == 2


def test_what_is_made_of_contexts_is_what_their_lists_give(spark):
    rows = views.reads(spark, "/root/testdata/sf0.001").where("read_id < 60")
    made = reads.context_rows(rows, made=lambda ipd, pw: {"total": ipd.sum(axis=1) + 1000 * pw[:, 0].astype("int64")}, schema="total long")
    total = F.aggregate("ipd", F.lit(0).cast("long"), lambda s, x: s + x) + 1000 * F.col("pw")[0].cast("long")
    lists = reads.context_rows(rows).select("read_id", "pos", "base", "kmer", total.alias("total"))
    assert made.count() == lists.count() > 1000 and made.exceptAll(lists).isEmpty()
