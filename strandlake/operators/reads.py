"""Read filters and per-read signal summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import kinetics, sequence
from strandlake.operators.rows import COMPLEMENT, cut, flat, quantile, small_batches
from strandlake.plans import driver_views as views
from strandlake.registry import query

TAGS = ("fi", "ri", "fp", "rp")


def _quantiles(column: pa.Array, shares: list[float]) -> np.ndarray:
    """A column of quantiles for each share, with linear interpolation; not a number for null and none."""
    values, at = flat(column)
    n = np.diff(at)
    ordered = np.append(values[np.lexsort((values, np.repeat(np.arange(len(n)), n)))], 0).astype(np.float64)
    place = np.maximum(0, n - 1)[:, None] * np.array(shares)
    low, high = (ordered[np.minimum(at[:-1, None] + f(place).astype(np.int64), len(values))] for f in (np.floor, np.ceil))
    out = low + (high - low) * (place - np.floor(place))
    out[(n == 0) | ~column.is_valid().to_numpy(zero_copy_only=False)] = np.nan
    return out


def _ratios(batches):  # noqa: ANN001, ANN202
    for b in batches:
        m = {t: _quantiles(b.column(t), [0.5])[:, 0] for t in TAGS}
        below = m["fi"] + m["ri"]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(below == 0, np.nan, (m["fp"] + m["rp"]) / below)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ratio, mask=np.isnan(ratio))], [*b.schema.names, "ratio"])


def eligible(reads: DataFrame, passes: int = 3) -> DataFrame:
    """Reads with enough passes on both strands and all four signals, with their pulse width over interval ratio.

    A missing or empty signal has no median, so the ratio is null and the read goes; so does one whose intervals' medians are 0.
    """
    small_batches(reads.sparkSession)
    full = reads.where((F.col("fn") >= passes) & (F.col("rn") >= passes))
    return full.mapInArrow(_ratios, T.StructType([*full.schema.fields, T.StructField("ratio", T.DoubleType())])).where("ratio is not null")


def quality_filter(reads: DataFrame, least: float = 0.3, percentile: float = 0.99) -> DataFrame:
    """Eligible reads with a ratio of ``least`` or more and under the percentile (exact, over all eligible reads).

    The percentile is found by histograms over the ratios alone, kept while that lasts, so no task ever holds all of them.
    """
    ratios = eligible(reads.select("fn", "rn", *TAGS)).select("ratio").persist(StorageLevel.MEMORY_AND_DISK)
    cut = quantile(ratios, "ratio", percentile)
    ratios.unpersist()
    return eligible(reads).where((F.col("ratio") >= least) & (F.col("ratio") < F.lit(cut)))


def consistent(reads: DataFrame, least_length: int = 1000) -> DataFrame:
    """Reads that are long enough and whose signals, and qualities where there is such a column, are as long as their sequence. A missing quality is no fault."""
    out = reads.where(F.length("seq") >= least_length)
    for t in TAGS:
        out = out.where(F.size(t) == F.length("seq"))
    return out.where(F.col("qual").isNull() | (F.size("qual") == F.length("seq"))) if "qual" in reads.columns else out


def has_signals(reads: DataFrame, rows: int = 50) -> bool:
    """Whether any of the first rows carries signals: a cheap look before a long job."""
    return not reads.limit(rows).where(" or ".join(f"size({t}) > 0" for t in TAGS)).isEmpty()


QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75, "q90": 0.9}


def signal_quantiles(reads: DataFrame) -> DataFrame:
    """Median, quartiles and 90 % quantile of each signal of each read, exact with linear interpolation; null for a missing or empty signal."""

    names = [f"{t}_{n}" for t in TAGS for n in QUANTILES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.hstack([_quantiles(b.column(t), list(QUANTILES.values())) for t in TAGS])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, mask=np.isnan(c)) for c in found.T)], ["read_id", *names])

    small_batches(reads.sparkSession)
    kind = reads.schema["read_id"].dataType.simpleString()
    return reads.select("read_id", *TAGS).mapInArrow(run, f"read_id {kind}, " + ", ".join(f"{n} double" for n in names))


def with_status(stats: DataFrame, status: DataFrame) -> DataFrame:
    """Status of each read, NA if there is none."""
    return stats.join(status, "read_id", "left").withColumn("status", F.coalesce("status", F.lit("NA")))


_median_sql = lambda t: f"list_median({t})"
_ELIGIBLE = f"""eligible AS (SELECT read_id, ({_median_sql('fp')} + {_median_sql('rp')}) / nullif({_median_sql('fi')} + {_median_sql('ri')}, 0) AS ratio FROM reads WHERE fn >= 3 AND rn >= 3)"""


@query("f1_f3_read_filter", f"WITH {views.READS_SQL}, {_ELIGIBLE} SELECT read_id, round(ratio, 6) AS ratio FROM eligible WHERE ratio >= 0.3 AND ratio < (SELECT quantile_cont(ratio, 0.99) FROM eligible)")
def read_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(views.reads(spark, sf_dir)).select("read_id", F.round("ratio", 6).alias("ratio"))


@query("f5_f6_consistent_reads", f"""WITH {views.READS_SQL} SELECT read_id, len(seq)::BIGINT AS n FROM (SELECT read_id, seq, CASE WHEN read_id % 11 = 1 THEN fi[2:] ELSE fi END AS fi, CASE WHEN read_id % 11 = 3 THEN ri[2:] ELSE ri END AS ri, CASE WHEN read_id % 11 = 5 THEN fp[2:] ELSE fp END AS fp, CASE WHEN read_id % 11 = 7 THEN rp[2:] ELSE rp END AS rp, CASE WHEN read_id % 11 = 2 THEN NULL WHEN read_id % 11 = 9 THEN fi[2:] ELSE fi END AS qual FROM reads)
    WHERE len(seq) >= 1000 AND (qual IS NULL OR len(qual) = len(seq)) AND len(fi) = len(seq) AND len(ri) = len(seq) AND len(fp) = len(seq) AND len(rp) = len(seq)""")
def consistent_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal is a value short in some reads, and so is the quality, which others lack."""
    reads = views.reads(spark, sf_dir)
    short = {t: F.when(F.col("read_id") % 11 == k, F.slice(t, F.lit(2), F.size(t))).otherwise(F.col(t)) for t, k in zip(("fi", "ri", "fp", "rp"), (1, 3, 5, 7), strict=True)}
    qual = F.when(F.col("read_id") % 11 == 9, F.slice("fi", F.lit(2), F.size("fi"))).when(F.col("read_id") % 11 != 2, F.col("fi"))
    return consistent(reads.withColumns(short | {"qual": qual})).select("read_id", F.length("seq").cast("long").alias("n"))


_q = ", ".join(f"round(list_aggregate({t}, 'quantile_cont', {q}), 6) AS {t}_{n}" for t in TAGS for n, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75), ("q90", 0.9)))


@query("a7_j8_signal_quantiles", f"WITH {views.READS_SQL} SELECT read_id, {_q}, coalesce(CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END, 'NA') AS status FROM reads LEFT JOIN labels ON read_id = doc_id")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = signal_quantiles(views.reads(spark, sf_dir))
    labels = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("read_id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("status"))
    out = with_status(stats, labels)
    return out.select("read_id", *[F.round(c, 6).alias(c) for c in stats.columns[1:]], "status")


@query("p1_revcomp", f"WITH {views.SEQS_SQL} SELECT read_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc FROM reads")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sequences(spark, sf_dir).select("read_id", F.md5(sequence.reverse_complement(F.col("seq"))).alias("rc"))


@query("p6_p8_signal_codes", """SELECT l_orderkey, l_linenumber, code, CASE WHEN code < 64 THEN code WHEN code < 128 THEN 64 + (code - 64) * 2 WHEN code < 192 THEN 192 + (code - 128) * 4 ELSE 448 + (code - 192) * 8 END AS frames,
    round(code / 255.0, 6) AS scaled, round(1 - power(10.0, -((l_quantity + 33) - 33) / 10.0), 6) AS prob FROM (SELECT *, CASE WHEN v < 64 THEN v WHEN v < 192 THEN 64 + (v - 64) // 2 WHEN v < 448 THEN 128 + (v - 192) // 4 ELSE 192 + (v - 448) // 8 END AS code
    FROM (SELECT *, least(952, (l_partkey % 1200))::INT AS v FROM lineitem))""")
def signal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "lineitem").withColumn("code", kinetics.encode_frames((F.col("l_partkey") % 1200).cast("int")))
    return items.select("l_orderkey", "l_linenumber", "code", kinetics.decode_frames(F.col("code")).alias("frames"), F.round(F.col("code") / 255.0, 6).alias("scaled"), F.round(kinetics.phred_probability(F.col("l_quantity") + 33), 6).alias("prob"))


#: Letters of sequences that are worked on at once.
TOGETHER = 1 << 15


class _Reads:
    """Reads that have all signals, side by side: letters, the other strand's, signals, and of each place its read, its bounds and its mirrored place."""

    def __init__(self, b: pa.RecordBatch) -> None:
        whole = np.logical_and.reduce([b.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("seq", *TAGS)])
        b = b.filter(pa.array(whole))
        self.ids = b.column("read_id")
        self.seq, at = flat(b.column("seq"))
        self.signals = {}
        for t in TAGS:
            self.signals[t], own = flat(b.column(t))
            if (own != at).any():
                raise ValueError(f"read {self.ids[int((np.diff(own) != np.diff(at)).argmax())]}: {t} and the sequence differ in length")
        self.read = np.repeat(np.arange(b.num_rows), np.diff(at))
        self.first, self.last = at[:-1][self.read], at[1:][self.read] - 1
        self.mirror = self.first + self.last - np.arange(len(self.seq))
        self.other = COMPLEMENT[self.seq][self.mirror]


def _by_reads(reads: DataFrame, f, schema: str) -> DataFrame:  # noqa: ANN001
    """What ``f`` makes of some reads at a time: the places of its rows and their columns; the read's id is put in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in cut(batch, "seq", TOGETHER):
                r = _Reads(b)
                for at, columns in f(r):
                    if len(at):
                        yield pa.RecordBatch.from_arrays([r.ids.take(pa.array(r.read[at])), *columns.values()], ["read_id", *columns])

    small_batches(reads.sparkSession)
    kind = reads.schema["read_id"].dataType.simpleString()
    return reads.select("read_id", "seq", *TAGS).mapInArrow(run, f"read_id {kind}, {schema}")


def _lists(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) // width + 1, dtype=np.int32) * width), pa.array(values))


def feature_rows(reads: DataFrame, k: int = 11, made: Callable[[np.ndarray], dict[str, pa.Array | np.ndarray]] | None = None, schema: str = "features array<float>") -> DataFrame:
    """One row (read_id, strand, pos, features) for each A of either strand: its k-mer's features on the other strand, where the base is a T.

    Features are [A, C, G, T, ipd/255, pw/255] for each base of the window, the first or last base repeated beyond an end. Signals must be as
    long as the sequence; a read without one of them gives no rows. With ``made``, the columns of ``schema`` that it makes of some rows' features
    (rows, k, 6) in the same task take their place, so that features that are only worked on further never leave it.
    """
    made = made or (lambda x: {"features": _lists(x.reshape(-1), 6 * k)})

    def of(r: _Reads):  # noqa: ANN202
        for strand, mine, other, ipd, pw in (("+", r.seq, r.other, "ri", "rp"), ("-", r.other, r.seq, "fi", "fp")):
            at = np.flatnonzero(mine == ord("A"))
            window = np.clip(r.mirror[at][:, None] + np.arange(-(k // 2), k // 2 + 1), r.first[at][:, None], r.last[at][:, None])
            each = np.column_stack([*((other == base) for base in b"ACGT"), r.signals[ipd] / 255.0, r.signals[pw] / 255.0]).astype(np.float32)
            yield at, {"strand": pa.array([strand] * len(at)), "pos": pa.array((at - r.first[at]).astype(np.int32))} | {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in made(each[window]).items()}

    return _by_reads(reads, of, f"strand string, pos int, {schema}")


def context_rows(
    reads: DataFrame, half: int = 10, margin: int = 50, made: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array | np.ndarray]] | None = None, schema: str = "ipd array<int>, pw array<int>"
) -> DataFrame:
    """(read_id, pos, base, kmer, ipd, pw) for each A and T ``margin`` bases or more from both ends.

    A T's k-mer is its reverse complement, null if that has other letters than A, C, G and T. Around an A stand the reverse strand's signals at
    the mirrored place, around a T the forward one's. Signals must be as long as the sequence; a read without one of them gives no rows. With
    ``made``, the columns of ``schema`` that it makes of some rows' signals (rows, 2 * half + 1) in the same task take their place.
    """
    around, width = np.arange(-half, half + 1), 2 * half + 1
    made = made or (lambda ipd, pw: {"ipd": _lists(ipd.reshape(-1), width), "pw": _lists(pw.reshape(-1), width)})
    texts = lambda letters, n, each: pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * each), pa.py_buffer(np.ascontiguousarray(letters)))

    def of(r: _Reads):  # noqa: ANN202
        pos, n = np.arange(len(r.seq)) - r.first, r.last - r.first + 1
        inner = (pos >= max(margin, half)) & (pos <= n - max(margin, half + 1))
        at = np.flatnonzero(inner & ((r.seq == ord("A")) | (r.seq == ord("T"))))
        is_a, own = r.seq[at] == ord("A"), r.seq[at[:, None] + around]
        mer = np.where(is_a[:, None], own, COMPLEMENT[own[:, ::-1]])
        strange = ~np.isin(own, list(b"ACGT")).all(axis=1) & ~is_a
        kmers = pc.if_else(pa.array(strange), pa.scalar(None, pa.string()), texts(mer, len(at), width))
        place = np.where(is_a, r.mirror[at], at)[:, None] + around
        signal = lambda a, t: np.where(is_a[:, None], r.signals[a][place], r.signals[t][place]).astype(np.int32)
        columns = {"pos": pa.array(pos[at].astype(np.int32)), "base": texts(r.seq[at], len(at), 1), "kmer": kmers}
        yield at, columns | {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in made(signal("ri", "fi"), signal("rp", "fp")).items()}

    return _by_reads(reads, of, f"pos int, base string, kmer string, {schema}")


_rc = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_strand_sql = lambda other, i, p, s: f"SELECT read_id, '{s}' AS strand, len(seq) AS n, repeat({other}[1], 5) || {other} || repeat({other}[-1], 5) AS o, list_concat(list_concat([{i}[1] for x in range(5)], {i}), [{i}[-1] for x in range(5)]) AS ipd, list_concat(list_concat([{p}[1] for x in range(5)], {p}), [{p}[-1] for x in range(5)]) AS pw FROM reads"
_placed = lambda v: "(" + " + ".join(f"{j + 1} * {v}[c + {j + 1}]" for j in range(11)) + ")::BIGINT"


@query(
    "p11_p13_kmer_features",
    f"""WITH {views.READS_SQL}, strands AS ({_strand_sql(_rc, 'ri', 'rp', '+')} UNION ALL {_strand_sql('seq', 'fi', 'fp', '-')})
        SELECT read_id, strand, (n - 1 - c)::INT AS pos, 66 AS n, ({' + '.join(f"{4**j} * instr('CGT', o[c + {j + 1}])" for j in range(11))})::BIGINT AS kmer, {_placed('ipd')} AS ipd, {_placed('pw')} AS pw
        FROM (SELECT *, unnest(range(n)) AS c FROM strands) WHERE o[c + 6] = 'T'""",
)
def kmer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bases of each window as digits of base 4, and its signals weighted by their places."""
    powers, places = 4 ** np.arange(11), np.arange(1, 12)

    def digest(x: np.ndarray) -> dict[str, np.ndarray]:
        kmer = (x[:, :, :4] @ np.arange(4, dtype=np.float32)).astype(np.int64) @ powers
        ipd, pw = (np.rint(x[:, :, k] * 255).astype(np.int64) @ places for k in (4, 5))
        return {"n": np.full(len(x), x.shape[1] * x.shape[2], dtype=np.int32), "kmer": kmer, "ipd": ipd, "pw": pw}

    return feature_rows(views.reads(spark, sf_dir), made=digest, schema="n int, kmer long, ipd long, pw long")


_by_place = lambda value: "(" + " + ".join(f"{j + 11} * " + value.format(j=j) for j in range(-10, 11)) + ")::BIGINT"


@query(
    "p30_p31_f15_context",
    f"""WITH {views.READS_SQL}, places AS (SELECT *, unnest(range(len(seq))) AS pos FROM reads),
        c AS (SELECT *, seq[pos + 1] AS base, seq[pos - 9:pos + 11] AS kmer FROM places WHERE seq[pos + 1] IN ('A', 'T') AND pos >= 50 AND pos <= len(seq) - 50)
        SELECT read_id, pos::INT AS pos, base, CASE WHEN base = 'T' THEN reverse(translate(kmer, 'ACGT', 'TGCA')) ELSE kmer END AS kmer,
               {_by_place("CASE WHEN base = 'A' THEN ri[len(seq) - pos + {j}] ELSE fi[pos + 1 + {j}] END")} AS ipd, {_by_place("CASE WHEN base = 'A' THEN rp[len(seq) - pos + {j}] ELSE fp[pos + 1 + {j}] END")} AS pw FROM c""",
)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals weighted by their places."""
    places = np.arange(1, 22)
    return context_rows(views.reads(spark, sf_dir), made=lambda ipd, pw: {"ipd": ipd @ places, "pw": pw @ places}, schema="ipd long, pw long")
