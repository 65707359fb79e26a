"""Tables of k-mers with their signals: filters, wide and long forms, training text and counters on the way."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import reads
from strandlake.plans import driver_views as views
from strandlake.registry import query, table

#: An A between two other bases: the motifs looked at around a modified base.
TRIPLES = [f"{a}A{b}" for a in "CGT" for b in "CGT"]


def with_motif(rows: DataFrame, pattern: str, kmer: str = "kmer") -> DataFrame:
    """Rows whose k-mer has a match of the pattern anywhere; a null k-mer has none."""
    return rows.where(F.col(kmer).rlike(pattern))


def centre_in(rows: DataFrame, motifs: list[str], kmer: str = "kmer") -> DataFrame:
    """Rows whose k-mer has one of the motifs, all of one odd length, in its middle; a null or shorter k-mer has none."""
    width = len(motifs[0])
    start = ((F.length(kmer) - width) / 2).cast("int") + 1
    return rows.where((F.length(kmer) >= width) & F.substr(F.col(kmer), start, F.lit(width)).isin(motifs))


def of_common_keys(rows: DataFrame, key: str, side: Column, least: int = 10) -> DataFrame:
    """Rows of the keys that have ``least`` rows or more on either side; those with a null key or side go.

    Keys are counted before they are shuffled. Where they are too many to be broadcast, a frequent key's rows are split by the adaptive join.
    """
    rows = rows.where(side.isNotNull())
    counts = rows.groupBy(key).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    return rows.join(counts.where((F.col("a") >= least) & (F.col("b") >= least)).select(key), key, "left_semi")


def wide(rows: DataFrame, lists: list[str], length: int = 21) -> DataFrame:
    """A column for each place of the lists, ``ipd_1`` and so on, instead of them. Places beyond a list's end are null."""
    places = [F.get(c, i).alias(f"{c}_{i + 1}") for c in lists for i in range(length)]
    return rows.select(*[c for c in rows.columns if c not in lists], *places)


def exploded(rows: DataFrame, lists: list[str], place: str = "place") -> DataFrame:
    """A row for each place (from 1) of lists of one length, whose values become numbers; what isn't a number is null. Empty and null lists give no row.

    Lists of unequal lengths are filled with nulls.
    """
    values = [F.col("_v")[c].try_cast("double").alias(c) for c in lists]
    others = [c for c in rows.columns if c not in lists]
    each = rows.select(*others, F.posexplode(F.arrays_zip(*lists)).alias("_at", "_v"))
    return each.select(*others, (F.col("_at") + 1).alias(place), *values)


def with_numbers(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or NaN in these columns."""
    return rows.dropna(subset=columns)


def counted(rows: DataFrame, samples: Column, bases: Column, name: str = "batch") -> tuple[DataFrame, Observation]:
    """The same rows, and what counts reads, samples and bases while an action runs over them, without a pass of its own.

    Tasks that run again after a lost executor may count twice; a table that must be exact is aggregated instead.
    """
    seen = Observation(name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.observe(seen, F.count(F.lit(1)).alias("reads"), total(samples).alias("samples"), total(bases).alias("bases")), seen


def shuffled(rows: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows in an order by chance that is the same for the same seed, sorted by ranges; a ``limit`` of it is a sample."""
    return rows.orderBy(F.xxhash64(F.lit(seed), id_col), id_col)


def training_line(label: Column, vector: Column) -> Column:
    """``label index:value ...``, indices from 1, zeros and nulls left out. A null or empty vector is its label alone; a null label is an error."""
    pairs = F.filter(F.transform(vector, lambda v, i: F.struct((i + 1).alias("i"), v.alias("v"))), lambda p: p["v"] != 0)
    line = F.concat_ws(" ", label.cast("string"), F.transform(pairs, lambda p: F.concat_ws(":", p["i"].cast("string"), p["v"].cast("string"))))
    return F.when(label.isNull(), F.raise_error(F.lit("a training line without a label"))).otherwise(line)


def write_training_text(rows: DataFrame, path: str, label: str = "label", vector: str = "features") -> None:
    rows.select(training_line(F.col(label), F.col(vector)).alias("value")).write.text(path)


def read_training_text(spark: SparkSession, path: str, dims: int | None = None) -> DataFrame:
    """(label, features) of training lines. Give ``dims`` to spare the pass that looks for the largest index."""
    source = spark.read.format("libsvm")
    rows = (source.option("numFeatures", dims) if dims else source).load(path)
    return rows.select("label", vector_to_array("features").alias("features"))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for contexts: label for the k-mer, two runs of 21 components for the signals, even ids for one condition."""
    v = table(spark, sf_dir, "embeddings")
    part = lambda first: F.slice("embedding", first, 21)
    return v.select("vec_id", F.col("label").alias("kmer"), (F.col("vec_id") % 2 == 0).alias("z"), part(1).alias("ipd"), part(22).alias("pw"))


_WIDE = ", ".join(f"embedding[{first + i}] AS {c}_{i}" for c, first in (("ipd", 0), ("pw", 21)) for i in range(1, 22))


@query("p36_j9_f22_wide", f"""SELECT vec_id, label AS kmer, vec_id % 2 = 0 AS z, {_WIDE} FROM embeddings
    WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) FILTER (WHERE vec_id % 2 = 0) >= 10 AND count(*) FILTER (WHERE vec_id % 2 <> 0) >= 10)
      AND len(list_filter(embedding[1:42], lambda x: x IS NOT NULL AND NOT isnan(x))) = 42""")
def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide(of_common_keys(_contexts(spark, sf_dir), "kmer", F.col("z")), ["ipd", "pw"])
    return with_numbers(rows, rows.columns[3:]).select("vec_id", "kmer", "z", *rows.columns[3:])


@query("p37_f22_exploded", """SELECT vec_id, label AS kmer, vec_id % 2 = 0 AS z, (i + 1)::INT AS place, embedding[i + 1]::DOUBLE AS ipd, embedding[i + 22]::DOUBLE AS pw
    FROM (SELECT *, unnest(range(21)) AS i FROM embeddings) WHERE (vec_id + i) % 7 <> 0 AND NOT isnan(embedding[i + 1]) AND NOT isnan(embedding[i + 22])""")
def exploded_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh value is text that isn't a number."""
    spoilt = F.transform("ipd", lambda v, i: F.when((F.col("vec_id") + i) % 7 == 0, "none").otherwise(v.cast("double").cast("string")))
    return with_numbers(exploded(_contexts(spark, sf_dir).withColumn("ipd", spoilt), ["ipd", "pw"]), ["ipd", "pw"])


@query(
    "f19_f21_motifs",
    f"""WITH {views.SEQS_SQL}, c AS (SELECT read_id, seq[pos + 1] AS base, pos, seq[pos - 9:pos + 11] AS own FROM (SELECT read_id, seq, unnest(range(len(seq))) AS pos FROM reads) WHERE seq[pos + 1] IN ('A', 'T') AND pos >= 50 AND pos <= len(seq) - 50),
        k AS (SELECT read_id, pos::INT AS pos, CASE WHEN base = 'T' THEN reverse(translate(own, 'ACGT', 'TGCA')) ELSE own END AS kmer FROM c)
        SELECT * FROM k WHERE regexp_matches(kmer, 'GA[CT]C') AND regexp_matches(kmer, '^.{{9}}[CGT]A[CGT].{{9}}$')""",
)
def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads.context_rows(views.reads(spark, sf_dir)).select("read_id", "pos", "kmer")
    return centre_in(with_motif(rows, "GA[CT]C"), TRIPLES)


@query("m11_training_text", """SELECT vec_id, concat_ws(' ', coalesce(label, 0)::VARCHAR, array_to_string(list_transform(list_filter(range(1, len(e) + 1), lambda i: e[i] <> 0), lambda i: i || ':' || e[i]), ' ')) AS line
    FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)::BIGINT) AS e FROM embeddings)""")
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    hundredths = F.transform("embedding", lambda v: F.floor(v.cast("double") * 100))
    return table(spark, sf_dir, "embeddings").select("vec_id", training_line(F.coalesce("label", F.lit(0)), hundredths).alias("line"))


@query("a21_batch_counters", f"WITH {views.SEQS_SQL} SELECT count(*) AS reads, sum(len(regexp_replace(seq, '[^AT]', '', 'g')))::BIGINT AS samples, sum(len(seq))::BIGINT AS bases FROM reads")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a pass over all reads, whose rows go nowhere here."""
    rows, seen = counted(views.sequences(spark, sf_dir), F.length(F.regexp_replace("seq", "[^AT]", "")), F.length("seq"))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "reads long, samples long, bases long")
