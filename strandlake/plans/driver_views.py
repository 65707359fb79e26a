"""Reads, calls and other domain tables made of the driver's tables, in DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.rows import cut, flat, small_batches
from strandlake.registry import table

LEAST_LENGTH = 100
#: name: factors of the base's ASCII code, its index and the read's id
SIGNALS = {"fi": (7, 13, 31), "fp": (5, 11, 17), "ri": (11, 17, 23), "rp": (3, 19, 29)}


def bases(seq: str = "seq"):  # noqa: ANN201
    return F.split(seq, "")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq, flag, fn, rn and the four kinetic arrays."""
    made = _sequences(spark, sf_dir, SIGNALS)
    i = F.col("read_id")
    return made.select("read_id", "seq", F.when(i % 2 == 1, 16).otherwise(0).alias("flag"), (1 + i % 9).cast("int").alias("fn"), (1 + i * 3 % 7).cast("int").alias("rn"), *SIGNALS)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq and flag of the same reads, for what looks at sequences alone."""
    return _sequences(spark, sf_dir, {}).withColumn("flag", F.when(F.col("read_id") % 2 == 1, 16).otherwise(0))


def _sequences(spark: SparkSession, sf_dir: str, signals: dict[str, tuple[int, int, int]]) -> DataFrame:
    """read_id and seq, the letters A, C, G and T of a document's text in either case, with signals made of them; short ones are left out."""
    fold = np.zeros(256, dtype=np.uint8)
    fold[list(b"ACGTacgt")] = list(b"ACGTACGT")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in cut(batch.filter(batch.column("text").is_valid()), "text", 1 << 20):
                base, at = flat(b.column("text"))
                base = fold[base]
                at, base = np.append(0, np.cumsum(base > 0))[at], base[base > 0]
                seq = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(at), pa.py_buffer(base)).cast(pa.string())
                row = np.repeat(np.arange(b.num_rows), np.diff(at))
                base, place, key = base.astype(np.int64), np.arange(len(base)) - at[row], b.column("doc_id").to_numpy()[row]
                made = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(((base * x + place * y + key * z) % 256).astype(np.int32))) for x, y, z in signals.values()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), seq, *made], ["read_id", "seq", *signals]).filter(pa.array(np.diff(at) >= LEAST_LENGTH))

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "read_id long, seq string" + "".join(f", {n} array<int>" for n in signals))


_signal_sql = ", ".join(f"list_transform(range(len(seq)), lambda i: ((ascii(seq[i + 1]) * {a} + i * {b} + doc_id * {c}) % 256)::INT) AS {n}" for n, (a, b, c) in SIGNALS.items())
READS_SQL = f"""reads AS (
    SELECT doc_id AS read_id, seq, CASE WHEN doc_id % 2 = 1 THEN 16 ELSE 0 END AS flag, (1 + doc_id % 9)::INT AS fn, (1 + doc_id * 3 % 7)::INT AS rn, {_signal_sql}
    FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents) WHERE len(seq) >= {LEAST_LENGTH}
)"""
#: The same without signals, for what looks at sequences alone.
SEQS_SQL = f"""reads AS (
    SELECT doc_id AS read_id, seq, CASE WHEN doc_id % 2 = 1 THEN 16 ELSE 0 END AS flag
    FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents) WHERE len(seq) >= {LEAST_LENGTH}
)"""


def calls(seqs: DataFrame) -> DataFrame:
    """(read_id, pos, base, prob) at every A and T of each read, in its original orientation; prob is null where there is no call."""
    base = seqs.select("read_id", F.posexplode(bases()).alias("pos", "base")).where("base in ('A', 'T')")
    return base.withColumn("prob", F.when((F.col("pos") * 37 + F.col("read_id")) % 3 == 0, (F.col("pos") * 29 + F.col("read_id") * 7) % 101 / F.lit(100.0)))


CALLS_SQL = """calls AS (
    SELECT read_id, i AS pos, seq[i + 1] AS base, ((i * 29 + read_id * 7) % 101) / 100.0::DOUBLE AS prob
    FROM (SELECT read_id, seq, unnest(range(len(seq))) AS i FROM reads) WHERE seq[i + 1] IN ('A', 'T') AND (i * 37 + read_id) % 3 = 0
)"""


#: The same at places of the reads as they were sequenced, where ``seq`` is in alignment orientation.
ORIGINAL_CALLS_SQL = CALLS_SQL.replace("FROM (SELECT read_id, seq,", "FROM (SELECT read_id, CASE WHEN flag = 16 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq,")


#: A read in so many is unmapped.
UNMAPPED = 7


def alignments(seqs: DataFrame) -> DataFrame:
    """Reads with a cigar, a 0-based position on a contig, mapping quality and pass count. Some are unmapped, and have none but a pass count."""
    n, i = F.length("seq"), F.col("read_id")
    cut = F.least(F.lit(60), (n / 2).cast("int"))
    cigar = F.concat(F.lit("4H"), (3 + i % 5).cast("string"), F.lit("S"), (cut - 10).cast("string"), F.lit("M2I3D"), F.lit("10="), (19 + i % 3).cast("string"), F.lit("D"), (n - cut - 12 - (3 + i % 5)).cast("string"), F.lit("M"))
    none = lambda value, column, name: F.when(i % UNMAPPED == 3, F.lit(value)).otherwise(column).alias(name)
    contig = F.concat(F.lit("c"), i.cast("string"))
    flag = F.col("flag") + F.when(i % UNMAPPED == 3, 4).otherwise(0)
    return seqs.select(
        "read_id", "seq", flag.alias("flag"), none("*", cigar, "cigar"), none("*", contig, "rname"), none(-1, (i % 40).cast("int"), "pos"), none(0, (i % 30).cast("int"), "mapq"), (i % 12).cast("double").alias("ec")
    )


_none = lambda value, column: f"CASE WHEN read_id % {UNMAPPED} = 3 THEN {value} ELSE {column} END"
ALIGN_SQL = f"""aligned AS (
    SELECT read_id, seq, flag + {_none(4, 0)} AS flag, {_none("'*'", "'4H' || (3 + read_id % 5) || 'S' || (cut - 10) || 'M2I3D10=' || (19 + read_id % 3) || 'D' || (len(seq) - cut - 12 - (3 + read_id % 5)) || 'M'")} AS cigar,
           {_none("'*'", "'c' || read_id")} AS rname, {_none(-1, "(read_id % 40)::INT")} AS pos, {_none(0, "(read_id % 30)::INT")} AS mapq, (read_id % 12)::DOUBLE AS ec
    FROM (SELECT *, least(60, len(seq) // 2) AS cut FROM reads)
), ops AS (
    SELECT read_id, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS t, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) - 1 AS k FROM aligned
), walked AS (
    SELECT read_id, k, op, n,
           coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS q_start,
           coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS r_offset
    FROM (SELECT read_id, k, right(t, 1) AS op, left(t, len(t) - 1)::BIGINT AS n FROM ops)
    WINDOW w AS (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference contig of each document, its letters twice, so that its own read lies on it anywhere."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("contig"), F.repeat(F.regexp_replace(F.upper("text"), "[^ACGTN]", ""), 2).alias("seq"))


CONTIGS_SQL = """contigs AS (
    SELECT 'c' || doc_id AS contig, repeat(regexp_replace(upper(text), '[^ACGTN]', '', 'g'), 2) AS seq FROM documents
)"""
