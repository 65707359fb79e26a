"""Text formats of sequencing, read and written with Spark's own text sources, so that any store and any file size will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import kinetics
from strandlake.sources.fastq import SPLIT_BYTES, FastqSource

SIGNALS = ("fi", "ri", "fp", "rp")
CALLS = "qname string, read_id int, strand string, qpos int, base string, rname string, rpos int, prob double"
FREQUENCIES = "chr string, coor int, num_records_above_threshold long, num_records_below_threshold long, ratio_above_threshold double"


def tsv(spark: SparkSession, path: str, schema: str, header: bool = False, comment: str | None = None) -> DataFrame:
    """A table with a fixed schema; no types are guessed."""
    r = spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", "")
    return (r.option("comment", comment) if comment else r).csv(path)


def base_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of 8 columns, or of 6 without coordinates; shorter lines are skipped."""
    c = F.split("value", "\t")
    get = lambda i, kind: F.get(c, i).try_cast(kind)
    full = F.size(c) >= 8
    rows = spark.read.text(path).where(F.size(c) >= 6)
    last = F.when(full, get(7, "double")).otherwise(get(5, "double"))
    return rows.select(F.get(c, 0).alias("qname"), get(1, "int").alias("read_id"), F.get(c, 2).alias("strand"), get(3, "int").alias("qpos"), F.get(c, 4).alias("base"), F.when(full, F.get(c, 5)).alias("rname"), F.when(full, get(6, "int")).alias("rpos"), last.alias("prob"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): lines with their place, which orders them by file path, block of the file, and place within it, however files are taken apart.

    A block is read in one task from its begin to its end, so the numbers that a task deals out put its lines in order.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return spark.read.text(path).select("value", place.alias("line"))


def status_table(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, status) of rows of two columns; of a key that comes again the last row in file order counts."""
    lines = ordered_lines(spark, path).select(F.split("value", "\t").alias("c"), "line").where(F.size("c") == 2)
    return lines.groupBy(F.get("c", 0).alias("read_id")).agg(F.max_by(F.get("c", 1), "line").alias("status"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(c) >= 5)).select(F.get(c, 0).alias("chr"), F.get(c, 1).try_cast("int").alias("pos"), F.get(c, 3).alias("ref"), F.get(c, 4).alias("alt"))


def paf(spark: SparkSession, path: str) -> DataFrame:
    """The first columns, the tags as one text, and ``line``, a key that follows file order."""
    c = F.split(F.trim("value"), r"\s+")
    get = lambda i: F.get(c, i).try_cast("long")
    rows = ordered_lines(spark, path).where(F.size(c) >= 12)
    return rows.select(F.get(c, 0).alias("qname"), get(1).alias("qlen"), get(2).alias("qstart"), get(3).alias("qend"), F.get(c, 4).alias("strand"), F.get(c, 5).alias("target"), F.array_join(F.slice(c, 13, F.size(c)), " ").alias("tags"), "line")


def _signal(tag: Column, values: Column) -> Column:
    """Codes of a signal's values, by the type that its tag names."""
    kind = F.substring(tag, 6, 1)
    most = F.when(kind == "C", 255).otherwise((1 << 16) - 1)
    bad = ~kind.isin("C", "S") | ~F.forall(values, lambda x: F.coalesce((x >= 0) & (x <= most), F.lit(False)))
    codes = F.when(kind == "S", F.transform(values, kinetics.encode_frames)).otherwise(values)
    return F.when(bad, F.raise_error(F.concat(F.lit("bad signal: "), F.substring(tag, 1, 40))).cast("array<int>")).otherwise(codes)


def sam(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Alignment lines with their kinetic tags; positions are 0-based, a missing qual is null.

    A line of fewer than 11 columns, or whose flag, position or mapping quality is no number, is an error; with ``mode="PERMISSIVE"`` the former
    are left out and the latter are null. Empty lines are none.

    Pulse signals are codes of 0 to 255: raw frames (B:S) are encoded. A signal of another type or with a value out of range is an error.
    """
    strict = mode == "FAILFAST"
    bad = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.substring(F.array_join("c", " "), 1, 60)))
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.split("value", "\t").alias("c"))
    full = F.size("c") >= 11
    lines = lines.select(F.when(full, F.col("c")).otherwise(bad("not an alignment line").cast("array<string>")).alias("c")) if strict else lines.where(full)
    kinds = dict.fromkeys(SIGNALS, "B") | {"fn": "i", "rn": "i", "ec": "f", "MM": "Z", "ML": "B", "ZP": "B"}
    tag = lambda name, kind: F.get(F.filter("tags", lambda x: x.startswith(f"{name}:{kind}:")), 0)
    # Steps of their own, so that a long line is taken apart once.
    rows = lines.select("c", F.slice("c", 12, F.size("c")).alias("tags")).select("c", *[tag(t, kind).alias(f"tag_{t}") for t, kind in kinds.items()])
    rows = rows.withColumns({f"parts_{t}": F.split(f"tag_{t}", ",") for t, kind in kinds.items() if kind == "B"})
    numbers = lambda name, kind: F.slice(f"parts_{name}", 2, F.size(f"parts_{name}")).cast(f"array<{kind}>")
    rows = rows.withColumns({f"raw_{t}": numbers(t, "int") for t in SIGNALS})
    get = lambda i, kind: F.coalesce(F.get("c", i).try_cast(kind), bad(f"column {i + 1} is no number").cast(kind)) if strict else F.get("c", i).try_cast(kind)
    one = lambda name, to: F.coalesce(F.substr(f"tag_{name}", F.lit(6)).try_cast(to), F.lit(0).cast(to))
    qual = F.when(F.get("c", 10) != "*", F.transform(F.split(F.get("c", 10), ""), lambda x: (F.ascii(x) - 33).cast("short")))
    return rows.select(
        F.get("c", 0).alias("qname"), get(1, "int").alias("flag"), F.get("c", 2).alias("rname"), (get(3, "int") - 1).alias("pos"), get(4, "int").alias("mapq"), F.get("c", 5).alias("cigar"), F.get("c", 9).alias("seq"), qual.alias("qual"),
        *[_signal(F.col(f"tag_{t}"), F.col(f"raw_{t}")).alias(t) for t in SIGNALS], one("fn", "int").alias("fn"), one("rn", "int").alias("rn"), one("ec", "double").alias("ec"),
        F.substr("tag_MM", F.lit(6)).alias("mm"), numbers("ML", "short").alias("ml"), numbers("ZP", "float").alias("zp"),
    )


def plausible(line: Column) -> Column:
    """Whether a first data line looks like a sequence: of its first 70 characters up to a semicolon, few are no residues."""
    head = F.regexp_replace(F.substr(line, F.lit(1), F.lit(70)), ";[\\s\\S]*$", "")
    good = F.length(F.regexp_replace(head, "[^A-Za-z*-]", ""))
    bad = F.length(F.regexp_replace(head, r"[A-Za-z*\-\s0-9]", ""))
    few = F.length(F.substr(line, F.lit(1), F.lit(70))) > 3
    return (line == "") | ~((bad >= F.floor(good / 3)) & (few | (good == 0) | (bad > good)))


def fasta(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """(contig, comment, seq). A '>' that begins a line begins a record. The text source splits there, so large files are read in parallel.

    Comment lines (!, #, ;) and what follows a semicolon go, white space goes, letters become upper-case. A record without a name, with an
    implausible first line or with characters that are no residues is dropped, or ends the job with ``mode="FAILFAST"``. Blank and comment
    lines before a file's first record are none; other lines there count as a record.
    """
    parts = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n>")  # lines that end with a carriage return alone aren't split by the source
    # A file's first record keeps its '>', as no line feed stands before it.
    records = spark.read.option("lineSep", "\n>").text(path).select(F.explode(parts).alias("value")).where(~F.col("value").rlike(r"\A(?:\s*+[!#;][^\n]*+)*+\s*+\z"))
    lines = F.split(F.regexp_replace("value", "^>", ""), "\n")
    name = F.regexp_extract(F.get(lines, 0), r"^(\S*)", 1)
    data = F.filter(F.slice(lines, 2, 1 << 30), lambda x: ~x.rlike("^[!#;]"))
    seq = F.upper(F.regexp_replace(F.array_join(F.transform(data, lambda x: F.regexp_replace(x, ";.*$", "")), ""), r"\s", ""))
    good = (name != "") & F.coalesce(plausible(F.get(data, 0)), F.lit(True)) & ~seq.rlike("[^ACGTURYSWKMBDHVN*-]")
    out = records.select(name.alias("contig"), F.trim(F.regexp_extract(F.get(lines, 0), r"^\S*\s+(.*)$", 1)).alias("comment"), seq.alias("seq"), good.alias("ok"))
    if mode == "FAILFAST":
        return out.select("contig", "comment", F.when(F.col("ok"), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), "contig"))).alias("seq"))
    return out.where("ok").drop("ok")


def fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(name, comment, seq, qual) of records of four lines whose quality is as long as their sequence, read in ranges of some ``split_bytes``.

    Other lines, and records whose quality is of another length, are passed over.
    """
    spark.dataSource.register(FastqSource)
    rows = spark.read.format("fastq").option("splitBytes", split_bytes).load(path).where(F.length("seq") == F.length("qual"))
    return rows.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), F.trim(F.regexp_extract("head", r"^@\S*\s+(.*)$", 1)).alias("comment"), "seq", "qual")


def write_fasta(seqs: DataFrame, path: str, name: str = "read_id", seq: str = "seq") -> None:
    seqs.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_tsv(rows: DataFrame, path: str, header: bool = False) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").csv(path)


def write_frequencies(sites: DataFrame, path: str) -> None:
    """Sites in order of chromosome bytes and coordinate, the ratio with two decimals."""
    named = sites.select("chr", "coor", F.col("above").alias("num_records_above_threshold"), F.col("below").alias("num_records_below_threshold"), F.format_string("%.2f", "ratio").alias("ratio_above_threshold"))
    write_tsv(named.orderBy("chr", "coor"), path, header=True)
