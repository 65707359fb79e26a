"""Base calls as tags and back, relabelling and histograms."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.rows import by_read, letters, lists, numbers
from strandlake.plans import driver_views as views
from strandlake.registry import query

A, T = ord("A"), ord("T")


def grouped_calls(calls: DataFrame) -> DataFrame:
    """(read_id, places, probs): a read's calls in one row, by place. Calls without a probability are none; of calls at one place the least counts."""
    one = calls.where("prob is not null").groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("prob").cast("double").alias("prob")))).alias("c"))
    return one.select("read_id", F.col("c.pos").alias("places"), F.col("c.prob").alias("probs"))


def called(b: pa.RecordBatch, i: int, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and probabilities of a row's calls that stand at an A or T."""
    at, p = numbers(b.column("places"), i, np.int64), numbers(b.column("probs"), i)
    if at is None:
        return np.zeros(0, np.int64), np.zeros(0)
    at, first = np.unique(at, return_index=True)
    p = p[first]
    inside = (at >= 0) & (at < len(seq))
    at, p = at[inside], p[inside]
    here = (seq[at] == A) | (seq[at] == T)
    return at[here], p[here]


def base_ordinals(seqs: DataFrame) -> DataFrame:
    """(read_id, pos, base, ordinal): each A and T numbered among its like."""

    def of(b: pa.RecordBatch, i: int) -> dict | None:
        if not b.column("seq")[i].is_valid:
            return None
        seq = letters(b.column("seq")[i].as_py())
        at = [np.flatnonzero(seq == base) for base in (A, T)]
        base = np.repeat(["A", "T"], [len(x) for x in at])
        return {"pos": np.concatenate(at).astype(np.int32), "base": pa.array(base.tolist(), pa.string()), "ordinal": np.concatenate([np.arange(len(x), dtype=np.int32) for x in at])}

    return by_read(seqs.select("read_id", "seq"), of, "pos int, base string, ordinal int")


def encode_tags(seqs: DataFrame, calls: DataFrame) -> DataFrame:
    """MM, ML and ZP of each read with calls: gap counts of like bases, A first and then T, and probabilities in that order.

    Only calls are shuffled, and joined with a read as one row; a call elsewhere than at an A or T is none.
    """

    def of(b: pa.RecordBatch, i: int) -> dict | None:
        seq = letters(b.column("seq")[i].as_py())
        at, p = called(b, i, seq)
        if not len(at):
            return None
        text, zp = [], []
        for base, code in ((A, "A+m"), (T, "T-m")):
            own = seq[at] == base
            ordinal = np.cumsum(seq == base)[at[own]] - 1
            gaps = np.diff(ordinal, prepend=-1) - 1
            text.append(",".join([code, *map(str, gaps.tolist())]) + ";")
            zp.append(p[own])
        zp = np.concatenate(zp)
        ml = np.minimum(255, np.floor(zp * 256)).astype(np.int16)
        return {"mm": pa.array(["".join(text)]), "ml": lists([ml], pa.int16()), "zp": lists([zp.astype(np.float32)], pa.float32())}

    rows = seqs.where("seq is not null").select("read_id", "seq").join(grouped_calls(calls), "read_id")
    return by_read(rows, of, "mm string, ml array<short>, zp array<float>")


_GROUP = re.compile(r"([A-Z])([+-])([a-z]+|[0-9]+)[.?]?((?:,[0-9]+)*)\Z")


def parsed_tags(mm: str, n: int) -> list[tuple[int, np.ndarray]]:
    """Base and ordinals of each group, in order. Other groups than A+m and T-m, and gaps that don't match ``n`` probabilities, are errors."""
    out, total = [], 0
    for group in mm.split(";"):
        if not group:
            continue
        m = _GROUP.match(group)
        if not m or m[1] + m[2] + m[3] not in ("A+m", "T-m"):
            raise ValueError(f"no group of A+m or T-m: {group[:40]}")
        gaps = np.array(m[4].split(",")[1:], dtype=np.int64)
        out.append((ord(m[1]), np.cumsum(gaps + 1) - 1))
        total += len(gaps)
    if total != n:
        raise ValueError(f"{total} gaps and {n} probabilities")
    return out


def _tagged(b: pa.RecordBatch, i: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray] | None:
    mm, zp, ml = b.column("mm")[i].as_py(), numbers(b.column("zp"), i), numbers(b.column("ml"), i)
    if mm is None:
        return None
    p = zp if zp is not None else ml / 255.0 if ml is not None else np.zeros(0)
    return parsed_tags(mm, len(p)), p


def tag_calls(tags: DataFrame) -> DataFrame:
    """(read_id, base, ordinal, prob) of MM with ZP, or ML / 255 where there is no ZP; a null MM gives no rows, one that can't be right is an error."""

    def of(b: pa.RecordBatch, i: int) -> dict | None:
        found = _tagged(b, i)
        if found is None:
            return None
        groups, p = found
        base = np.repeat([chr(g) for g, _ in groups], [len(o) for _, o in groups])
        return {"base": pa.array(base.tolist(), pa.string()), "ordinal": np.concatenate([o for _, o in groups] or [p]).astype(np.int32), "prob": pa.array(p)}

    return by_read(tags.select("read_id", "mm", "ml", "zp"), of, "base string, ordinal int, prob double")


def resolve_tags(seqs: DataFrame, tags: DataFrame) -> DataFrame:
    """(read_id, pos, base, prob): tags resolved to places of the read as it was sequenced, inside the read's row; ordinals beyond its bases give none."""

    def of(b: pa.RecordBatch, i: int) -> dict | None:
        found = _tagged(b, i)
        if found is None:
            return None
        groups, p = found
        seq, places, bases, probs, at = letters(b.column("seq")[i].as_py()), [], [], [], 0
        for base, ordinal in groups:
            like, own = np.flatnonzero(seq == base), p[at : at + len(ordinal)]
            at += len(ordinal)
            own, ordinal = own[ordinal < len(like)], ordinal[ordinal < len(like)]
            places.append(like[ordinal])
            bases += [chr(base)] * len(ordinal)
            probs.append(own)
        return {"pos": np.concatenate(places or [np.zeros(0)]).astype(np.int32), "base": pa.array(bases, pa.string()), "prob": pa.array(np.concatenate(probs or [np.zeros(0)]))}

    rows = seqs.where("seq is not null").select("read_id", "seq").join(tags.select("read_id", "mm", "ml", "zp"), "read_id")
    return by_read(rows, of, "pos int, base string, prob double")


def _written(seq: np.ndarray, at: np.ndarray, p: np.ndarray, least: float) -> dict:
    out = seq.copy()
    on = at[p >= least]
    out[on] = np.where(seq[on] == A, ord("Z"), ord("O"))
    return {"seq": pa.array([out.tobytes().decode("latin-1")])}


def relabelled(seqs: DataFrame, calls: DataFrame, least: float = 0.5) -> DataFrame:
    """Sequences with Z for called A and O for called T of ``least`` or more; N stays."""

    def of(b: pa.RecordBatch, i: int) -> dict:
        seq = letters(b.column("seq")[i].as_py())
        return _written(seq, *called(b, i, seq), least)

    rows = seqs.where("seq is not null").select("read_id", "seq").join(grouped_calls(calls), "read_id", "left")
    return by_read(rows, of, "seq string")


def relabelled_in_order(seqs: DataFrame, tags: DataFrame, least: float = 0.5) -> DataFrame:
    """``relabelled`` with the i-th value of ZP taken for the i-th A or T of the sequence, wherever it belongs; reads without ZP give no row.

    ZP lists all calls at A before those at T, so these places are wrong for most reads. This is how older outputs were made; ``relabelled`` is right.
    """

    def of(b: pa.RecordBatch, i: int) -> dict:
        seq, p = letters(b.column("seq")[i].as_py()), numbers(b.column("zp"), i, np.float32)
        at = np.flatnonzero((seq == A) | (seq == T))
        n = min(len(at), len(p))
        return _written(seq, at[:n], p[:n].astype(np.float64), least)

    rows = seqs.where("seq is not null").select("read_id", "seq").join(tags.where(F.size("zp") > 0).select("read_id", "zp"), "read_id")
    return by_read(rows, of, "seq string")


def histogram(values: DataFrame, buckets: int = 100, least: int = 1) -> DataFrame:
    """(read_id, bucket, share): of all values of a read, the share in each bucket; reads with fewer than ``least`` values give none."""
    at = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(F.col("prob") / F.lit(1.0 / buckets)))).cast("int")
    counts = values.groupBy("read_id", at.alias("bucket")).agg(F.count("*").alias("n"))
    all_values = F.sum("n").over(Window.partitionBy("read_id"))
    return counts.withColumn("total", all_values).where(F.col("total") >= least).select("read_id", "bucket", (F.col("n") / F.col("total")).alias("share"))


@query("p16_p21_mm_roundtrip", f"WITH {views.SEQS_SQL}, {views.CALLS_SQL} SELECT read_id, pos::INT AS pos, base, round(prob, 4) AS prob FROM calls")
def mm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = views.sequences(spark, sf_dir).select("read_id", "seq")
    return resolve_tags(seqs, encode_tags(seqs, views.calls(seqs))).withColumn("prob", F.round("prob", 4))


@query(
    "p16_p18_tags",
    f"""WITH {views.SEQS_SQL}, {views.CALLS_SQL},
        o AS (SELECT *, row_number() OVER (PARTITION BY read_id, base ORDER BY pos) - 1 AS k FROM (SELECT read_id, seq[i + 1] AS base, i AS pos FROM (SELECT read_id, seq, unnest(range(len(seq))) AS i FROM reads)) WHERE base IN ('A', 'T')),
        g AS (SELECT c.read_id, c.base, c.pos, c.prob, o.k - coalesce(lag(o.k) OVER (PARTITION BY c.read_id, c.base ORDER BY c.pos), -1) - 1 AS gap FROM calls c JOIN o USING (read_id, base, pos))
        SELECT read_id, 'A+m' || coalesce(string_agg(',' || gap, '' ORDER BY pos) FILTER (WHERE base = 'A'), '') || ';T-m' || coalesce(string_agg(',' || gap, '' ORDER BY pos) FILTER (WHERE base = 'T'), '') || ';' AS mm,
               sum(i * least(255, floor(prob * 256)))::BIGINT AS ml, sum(i * round(prob * 100))::BIGINT AS zp FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY base, pos) AS i FROM g) GROUP BY read_id""",
)
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities weighted by their places."""
    seqs = views.sequences(spark, sf_dir).select("read_id", "seq")
    by_place = lambda c: F.aggregate(F.transform(c, lambda x, i: (i + 1) * x.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    zp = F.transform("zp", lambda x: F.round(x.cast("double") * 100))
    return encode_tags(seqs, views.calls(seqs)).select("read_id", "mm", by_place("ml").alias("ml"), by_place(zp).alias("zp"))


@query(
    "p27_relabel",
    f"""WITH {views.SEQS_SQL}, {views.CALLS_SQL}, b AS (SELECT read_id, seq[i + 1] AS base, i AS pos FROM (SELECT read_id, seq, unnest(range(len(seq))) AS i FROM reads))
        SELECT read_id, md5(string_agg(CASE WHEN prob >= 0.5 AND b.base = 'A' THEN 'Z' WHEN prob >= 0.5 AND b.base = 'T' THEN 'O' ELSE b.base END, '' ORDER BY b.pos)) AS seq FROM b LEFT JOIN calls USING (read_id, pos) GROUP BY read_id""",
)
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = views.sequences(spark, sf_dir).select("read_id", "seq")
    return relabelled(seqs, views.calls(seqs)).withColumn("seq", F.md5("seq"))


@query(
    "p27_relabel_in_order",
    f"""WITH {views.SEQS_SQL}, {views.CALLS_SQL}, b AS (SELECT read_id, seq[i + 1] AS base, i AS pos FROM (SELECT read_id, seq, unnest(range(len(seq))) AS i FROM reads)),
        o AS (SELECT read_id, pos, row_number() OVER (PARTITION BY read_id ORDER BY pos) AS k FROM b WHERE base IN ('A', 'T')),
        z AS (SELECT read_id, prob, row_number() OVER (PARTITION BY read_id ORDER BY base, pos) AS k FROM calls)
        SELECT read_id, md5(string_agg(CASE WHEN prob >= 0.5 AND base = 'A' THEN 'Z' WHEN prob >= 0.5 AND base = 'T' THEN 'O' ELSE base END, '' ORDER BY pos)) AS seq
        FROM b LEFT JOIN o USING (read_id, pos) LEFT JOIN z USING (read_id, k) WHERE read_id IN (SELECT read_id FROM calls) GROUP BY read_id""",
)
def relabel_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = views.sequences(spark, sf_dir).select("read_id", "seq")
    return relabelled_in_order(seqs, encode_tags(seqs, views.calls(seqs))).withColumn("seq", F.md5("seq"))


@query(
    "p29_prob_histogram",
    """SELECT l_suppkey AS read_id, b AS bucket, round(count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey), 6) AS share
       FROM (SELECT l_suppkey, greatest(0, least(99, floor(l_discount * 10 / (1.0::DOUBLE / 100))))::INT AS b FROM lineitem) GROUP BY 1, 2""",
)
def prob_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("read_id"), (F.col("l_discount") * 10).alias("prob"))
    return histogram(values).withColumn("share", F.round("share", 6))
