"""Alignments: walking cigars, identity, and bases with reference coordinates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import original
from strandlake.operators.calls import called, grouped_calls
from strandlake.operators.rows import back, by_read, letters
from strandlake.plans import driver_views as views
from strandlake.registry import query

QUERY_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"
BROADCAST_BASES, TILE_BASES = 64 << 20, 1 << 20


def walk(aligned: DataFrame) -> DataFrame:
    """A row for each cigar operation: k, op, n, and where it starts on the read (q_start) and on the reference from the alignment's position (r_offset)."""
    ops = aligned.select("read_id", F.posexplode(F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"))).alias("k", "t"))
    ops = ops.select("read_id", "k", F.substr("t", F.length("t"), F.lit(1)).alias("op"), F.regexp_extract("t", r"\d+", 0).cast("long").alias("n"))
    before = Window.partitionBy("read_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda kinds: F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("n")).otherwise(0)).over(before), F.lit(0)).cast("long")
    return ops.select("*", start(QUERY_OPS).alias("q_start"), start(REFERENCE_OPS).alias("r_offset"))


def _mapped() -> Column:
    """Whether a read lies on a contig: not if it is flagged as unmapped, or lacks a contig, a position or a cigar."""
    named = lambda c: F.coalesce(F.col(c), F.lit("*")) != "*"
    return named("rname") & named("cigar") & (F.coalesce("pos", F.lit(-1)) >= 0) & (F.coalesce("flag", F.lit(0)).bitwiseAND(F.lit(4)) == 0) & F.col("seq").isNotNull()


def _known(contig: Column, found: Column) -> Column:
    """``found``, true or null; where a mapped read's contig isn't found the job ends."""
    missing = F.raise_error(F.concat(F.lit("no such contig in the reference: "), contig)).cast("boolean")
    return F.when(F.col("mapped"), F.coalesce(found, missing))


def _reference_of(spans: DataFrame, contigs: DataFrame) -> DataFrame:
    """Column ``ref`` for rows (read_id, rname, pos, span, mapped): the reference from pos on, as long as the alignment; null for unmapped reads.

    A mapped read on a contig that the reference lacks is an error. A reference of at most BROADCAST_BASES goes along with every task. A larger
    one is cut into tiles, and each alignment meets the tiles that it lies on, so that no key is a whole contig.
    """
    size = contigs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    named = contigs.select(F.col("contig").alias("rname"), F.coalesce("seq", F.lit("")).alias("whole"))
    if size <= BROADCAST_BASES:
        both = spans.join(F.broadcast(named), "rname", "left")
        piece = F.substr("whole", F.col("pos") + 1, F.col("span").cast("int"))
        return both.withColumn("ref", F.when(_known(F.col("rname"), F.when(F.col("whole").isNotNull(), F.lit(True))), piece)).drop("whole")
    last = F.floor(F.greatest(F.lit(0), F.length("whole") - 1) / TILE_BASES)
    tiles = named.select("rname", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda t: F.substr("whole", (t * TILE_BASES + 1).cast("int"), F.lit(TILE_BASES)))).alias("tile", "part"))
    first, end = F.floor(F.col("pos") / TILE_BASES), F.floor((F.col("pos") + F.greatest(F.col("span"), F.lit(1)) - 1) / TILE_BASES)
    on = spans.where("mapped").select("read_id", "rname", "pos", "span", F.explode(F.sequence(first.cast("int"), end.cast("int"))).alias("tile"))
    lo = F.greatest(F.lit(0), F.col("pos") - F.col("tile") * TILE_BASES)
    hi = F.least(F.lit(TILE_BASES), F.col("pos") + F.col("span") - F.col("tile") * TILE_BASES)
    pieces = on.join(tiles, ["rname", "tile"]).select("read_id", F.struct("tile", F.substr("part", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("s")).alias("p"))
    refs = pieces.groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("ref"))
    names = named.select("rname", F.lit(True).alias("known"))  # no bases
    checked = spans.join(names, "rname", "left").join(refs, "read_id", "left")
    return checked.withColumn("ref", F.when(_known(F.col("rname"), F.col("known")), F.coalesce("ref", F.lit("")))).drop("known")


_OP = re.compile(r"(\d+)([MIDNSHP=X])")


def _placed(aligned: DataFrame, contigs: DataFrame, *more: str) -> DataFrame:
    """Alignments with the piece of the reference that they lie on (``ref``, null for unmapped reads); other letters than ACGT read A there."""
    each = F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"))
    span = F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    rows = aligned.withColumn("mapped", _mapped()).select("read_id", "seq", "cigar", "rname", "pos", "mapped", *more)
    both = _reference_of(rows.withColumn("span", span), contigs)
    return both.withColumn("ref", F.translate("ref", "NRYKMSWBDHVU", "A" * 12))


class Alignment:
    """A row's aligned columns: places on the read (q) and from the alignment's position on (r), whether the letters are equal, and its identity."""

    def __init__(self, b: pa.RecordBatch, i: int, long_gap: int = 20) -> None:
        self.seq, self.ref = letters(b.column("seq")[i].as_py()), letters(b.column("ref")[i].as_py())
        q, r, at, gaps, side, run = [], [], [0, 0], 0, None, 0
        for n, op in [(int(n), op) for n, op in _OP.findall(b.column("cigar")[i].as_py())]:
            if op in "M=X":
                q.append(np.arange(at[0], at[0] + n))
                r.append(np.arange(at[1], at[1] + n))
            own = "q" if op == "I" else "r" if op in "DN" else None
            if op not in "SHP":
                if own != side:
                    gaps += run if run < long_gap else 0
                    side, run = own, 0
                run += n if own else 0
            at[0] += n if op in QUERY_OPS else 0
            at[1] += n if op in REFERENCE_OPS else 0
        gaps += run if run < long_gap else 0
        q, r = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (q, r))
        inside = (q < len(self.seq)) & (r < len(self.ref))
        self.q, self.r = q[inside], r[inside]
        self.equal = self.seq[self.q] == self.ref[self.r]
        total = len(self.q) + gaps
        self.identity = 100.0 * int(self.equal.sum()) / total if total else 0.0


def aligned_pairs(aligned: DataFrame, contigs: DataFrame) -> DataFrame:
    """(read_id, q, r, query, reference) of every aligned column of mapped reads; a contig that the reference lacks is an error."""

    def of(b: pa.RecordBatch, i: int) -> dict:
        a, pos = Alignment(b, i), b.column("pos")[i].as_py()
        chars = lambda x: pa.array(list(x.tobytes().decode("latin-1")), pa.string())
        return {"q": a.q, "r": a.r + pos, "query": chars(a.seq[a.q]), "reference": chars(a.ref[a.r])}

    return by_read(_placed(aligned, contigs).where("mapped"), of, "q long, r long, query string, reference string")


def identity(aligned: DataFrame, contigs: DataFrame, long_gap: int = 20) -> DataFrame:
    """(read_id, identity) of mapped reads: equal columns out of all columns, in percent. Runs of gaps on one side of ``long_gap`` or more don't count."""
    return by_read(_placed(aligned, contigs).where("mapped"), lambda b, i: {"identity": pa.array([Alignment(b, i, long_gap).identity])}, "identity double")


def base_table(aligned: DataFrame, contigs: DataFrame, calls: DataFrame, least_mapq: int = 10, least_identity: float = 98.0, least_passes: float = 6.0, mapped_only: bool = False) -> DataFrame:
    """A row for each called A or T: read_id, strand, qpos, base, rname, rpos, prob.

    Calls are by place in the read as it was sequenced; rows are in alignment orientation. Coordinates are null unless the read is mapped well
    enough and the base equals the reference's; an unmapped read keeps its bases, without coordinates. A mapped read on a contig that the reference
    lacks ends the job. Reads with fewer passes give no rows; ``mapped_only`` drops rows without coordinates.

    A null flag is that of a forward read, a null mapping quality or pass count is 0, a null contig, position or cigar is that of an unmapped
    read, and a null sequence has no bases. A read's alignment is walked once, in its own row, which its calls join as one row too.
    """
    good = aligned.where(F.coalesce("ec", F.lit(0.0)) >= least_passes)
    rows = _placed(good, contigs, "flag", "mapq").where("seq is not null").join(grouped_calls(calls), "read_id")

    def of(b: pa.RecordBatch, i: int) -> dict | None:
        seq = letters(b.column("seq")[i].as_py())
        reverse, n = bool((b.column("flag")[i].as_py() or 0) & 16), len(seq)
        at, p = called(b, i, back(seq) if reverse else seq)
        if reverse:
            at = n - 1 - at
        rpos = np.full(n, -1, dtype=np.int64)
        if b.column("ref")[i].is_valid and (b.column("mapq")[i].as_py() or 0) >= least_mapq:
            a = Alignment(b, i)
            if a.identity >= least_identity:
                rpos[a.q[a.equal]] = a.r[a.equal] + b.column("pos")[i].as_py()
        rpos = rpos[at]
        if mapped_only:
            at, p, rpos = at[rpos >= 0], p[rpos >= 0], rpos[rpos >= 0]
        if not len(at):
            return None
        none = rpos < 0
        names = pa.array(np.where(none, None, b.column("rname")[i].as_py()), pa.string())
        base = pa.array(np.where(seq[at] == ord("A"), "A", "T").tolist(), pa.string())
        return {"strand": pa.array(["-" if reverse else "+"] * len(at)), "qpos": at, "base": base, "rname": names, "rpos": pa.array(rpos, mask=none), "prob": pa.array(p)}

    return by_read(rows, of, "strand string, qpos long, base string, rname string, rpos long, prob double")


def with_checked_alignment(aligned: DataFrame) -> DataFrame:
    """``aligned``, but a row whose cigar does not add up to its sequence, has an unknown letter or starts before its contig is an error when it is read."""
    total = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MIS=X]")), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    right = (F.col("cigar") == "*") | (F.col("cigar").rlike(r"^(\d+[MIDNSHP=X])+$") & (total == F.length("seq")) & (F.col("pos") >= 0))
    return aligned.withColumn("cigar", F.when(F.coalesce(right, F.lit(True)), F.col("cigar")).otherwise(F.raise_error(F.concat(F.lit("not an alignment of its sequence: "), F.col("read_id").cast("string")))))


def unknown_contigs(aligned: DataFrame, contigs: DataFrame) -> DataFrame:
    """Alignments to contigs that the reference lacks; there should be none."""
    return aligned.join(contigs.select(F.col("contig").alias("rname")), "rname", "left_anti")


_PAIRS = """pairs AS (
    SELECT read_id, q, r, seq[q + 1] AS a, CASE WHEN ref[r + 1] IN ('A', 'C', 'G', 'T') THEN ref[r + 1] ELSE 'A' END AS b
    FROM (SELECT w.read_id, q_start + i AS q, pos + r_offset + i AS r, a.seq, c.seq AS ref FROM (SELECT *, unnest(range(n)) AS i FROM walked WHERE op IN ('M', '=', 'X')) w JOIN aligned a USING (read_id) JOIN contigs c ON c.contig = a.rname)
    WHERE q < len(seq) AND r < len(ref)
)"""
_IDENTITY = """runs AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY k) AS run FROM (
        SELECT *, CASE WHEN coalesce(lag(side) OVER (PARTITION BY read_id ORDER BY k), '-') = coalesce(side, '-') THEN 0 ELSE 1 END AS new
        FROM (SELECT *, CASE WHEN op = 'I' THEN 'q' WHEN op IN ('D', 'N') THEN 'r' END AS side FROM walked WHERE op NOT IN ('S', 'H', 'P')))),
    short AS (SELECT read_id, sum(n) AS gaps FROM (SELECT read_id, run, sum(n) AS n FROM runs WHERE side IS NOT NULL GROUP BY 1, 2) WHERE n < 20 GROUP BY 1),
    same AS (SELECT read_id, count(*) AS cols, count(*) FILTER (WHERE a = b) AS same FROM pairs GROUP BY 1),
    ident AS (SELECT a.read_id, coalesce(100.0 * coalesce(same, 0) / nullif(coalesce(cols, 0) + coalesce(gaps, 0), 0), 0)::DOUBLE AS identity FROM aligned a LEFT JOIN same USING (read_id) LEFT JOIN short USING (read_id))"""
_ALL = f"WITH {views.SEQS_SQL}, {views.ALIGN_SQL}, {views.CONTIGS_SQL}, {_PAIRS}, {_IDENTITY}"


def sequenced(seqs: DataFrame) -> DataFrame:
    """(read_id, seq) of reads as they were sequenced."""
    return seqs.select("read_id", original(F.col("seq"), F.col("flag")).alias("seq"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.alignments(views.sequences(spark, sf_dir).select("read_id", "seq", "flag"))


@query("p23_cigar_walk", f"WITH {views.SEQS_SQL}, {views.ALIGN_SQL} SELECT read_id, k::INT AS k, op, n, q_start, r_offset FROM walked")
def cigar_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk(_aligned(spark, sf_dir))


@query("p24_identity", f"{_ALL} SELECT read_id, round(identity, 6) AS identity FROM ident JOIN aligned USING (read_id) WHERE rname <> '*'")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity(_aligned(spark, sf_dir), views.contigs(spark, sf_dir)).withColumn("identity", F.round("identity", 6))


@query(
    "p26_f7_f11_base_table",
    f"""{_ALL}, {views.ORIGINAL_CALLS_SQL}, placed AS (SELECT c.read_id, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS strand, (CASE WHEN flag & 16 > 0 THEN len(seq) - 1 - c.pos ELSE c.pos END)::BIGINT AS qpos,
            CASE WHEN flag & 16 > 0 THEN translate(base, 'AT', 'TA') ELSE base END AS base, rname, mapq, prob FROM calls c JOIN aligned USING (read_id) WHERE ec >= 6)
        SELECT p.read_id, strand, qpos, base, CASE WHEN mapq >= 10 AND identity >= 20 AND r IS NOT NULL THEN rname ELSE '' END AS rname, CASE WHEN mapq >= 10 AND identity >= 20 THEN coalesce(r, -1) ELSE -1 END AS rpos, prob
        FROM placed p JOIN ident USING (read_id) LEFT JOIN (SELECT * FROM pairs WHERE a = b AND a IN ('A', 'T')) x ON x.read_id = p.read_id AND x.q = p.qpos""",
)
def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a low identity, as invented sequences agree by chance only."""
    seqs = views.sequences(spark, sf_dir).select("read_id", "seq", "flag")
    return base_table(views.alignments(seqs), views.contigs(spark, sf_dir), views.calls(sequenced(seqs)), least_identity=20.0).fillna({"rname": "", "rpos": -1})

