"""From read classes to likelihood ratios by source, and the mapping filter before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.rows import numbered
from strandlake.registry import query, table

FALSE_POSITIVE_RATE = 0.002


def likelihood_ratio(classes: DataFrame, contig_of: DataFrame, species_of: DataFrame | None = None, false_positive_rate: float = FALSE_POSITIVE_RATE) -> DataFrame:
    """(source, reads, z_reads, lr): by contig, or by species where a table of them is given. Reads tagged ``*`` don't count.

    One conditional aggregate stands for the counts of all and of positive reads and the join of the two.
    """
    known = classes.where("tag <> '*'").join(contig_of, "read").withColumn("source", F.col("contig"))
    if species_of is not None:
        known = known.drop("source").join(species_of.select("contig", F.col("species").alias("source")), "contig")
    out = known.groupBy("source").agg(F.count("*").alias("reads"), F.count_if(F.col("tag") == "+").alias("z_reads"))
    return out.withColumn("lr", F.col("z_reads") / F.col("reads") / F.lit(false_positive_rate))


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that came first in file order."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def mapping_filter(paf: DataFrame, least: float = 0.4, most_divergence: float = 0.05, coverage_mode: str = "literal") -> DataFrame:
    """First mapping of each read that covers enough of it and diverges little.

    ``literal`` tests qend - qstart / qlen as the original command is evaluated, ``fraction`` (qend - qstart) / qlen as it is described.
    """
    part = (F.col("qend") - F.col("qstart")) / F.col("qlen") if coverage_mode == "fraction" else F.col("qend") - F.col("qstart") / F.col("qlen")
    dv = F.expr("try_cast(regexp_extract(tags, 'dv:f:([0-9.eE+-]+)', 1) as double)")
    return first_per_key(paf, "qname", "line").where((part > least) & (dv < most_divergence))


def sample_per_group(rows: DataFrame, group: str, n: int, id_col: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Up to ``n`` rows of each group, those whose ids' hashes (or ``order``) come first: the same rows in every run.

    Spark keeps the first ``n`` of each group in each partition before it shuffles, so a large group does not meet in one task.
    """
    first = Window.partitionBy(group).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)) if order is None else order, id_col)
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_n")


def stratified_split(rows: DataFrame, label: str, id_col: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """A boolean column ``train``: the given share of each class, dealt by a hash of the id.

    Rows are numbered by ranges of (class, hash, id), so that a class of any size is shared by many tasks. Ids must be distinct.
    """
    mixed = rows.withColumn("_hash", F.xxhash64(F.col(id_col), F.lit(seed)))
    placed = numbered(mixed, label, "_hash", id_col, name="_i")
    classes = placed.groupBy(label).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    known = placed.join(F.broadcast(classes.withColumnRenamed(label, "_label")), F.col(label).eqNullSafe(F.col("_label")))  # one row a class
    return known.select(*rows.columns, (F.col("_i") - F.col("_first") < share * F.greatest(F.lit(1), F.col("_n") - 1)).alias("train"))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("toxic") == 1, "*").when(F.col("quality") == 1, "+").otherwise("-")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("read"), tag.alias("tag"))


_CLASSES = "classes AS (SELECT doc_id AS read, CASE WHEN toxic = 1 THEN '*' WHEN quality = 1 THEN '+' ELSE '-' END AS tag FROM labels)"


@query("j1_j3_likelihood_ratio", f"WITH {_CLASSES} SELECT source, count(*) AS reads, count(*) FILTER (WHERE tag = '+') AS z_reads, round(count(*) FILTER (WHERE tag = '+') / count(*) / 0.002, 6) AS lr FROM classes JOIN documents ON read = doc_id WHERE tag <> '*' GROUP BY 1")
def by_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    contig = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read"), F.col("source").alias("contig"))
    return likelihood_ratio(_classes(spark, sf_dir), contig).withColumn("lr", F.round("lr", 6))


@query("j2_species_ratio", f"WITH {_CLASSES}, species AS (SELECT DISTINCT source, 's' || (substr(source, 4)::INT % 4) AS s FROM documents) SELECT s AS source, count(*) AS reads, count(*) FILTER (WHERE tag = '+') AS z_reads, round(count(*) FILTER (WHERE tag = '+') / count(*) / 0.002, 6) AS lr FROM classes JOIN documents ON read = doc_id JOIN species USING (source) WHERE tag <> '*' GROUP BY 1")
def by_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    contig = docs.select(F.col("doc_id").alias("read"), F.col("source").alias("contig"))
    species = docs.select(F.col("source").alias("contig")).distinct().withColumn("species", F.concat(F.lit("s"), (F.substring("contig", 4, 9).cast("int") % 4).cast("string")))
    return likelihood_ratio(_classes(spark, sf_dir), contig, species).withColumn("lr", F.round("lr", 6))


def _paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    dv = F.concat(F.lit("tp:A:P dv:f:0.0"), (F.col("event_id") % 10).cast("string"))
    return e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("qname"), F.col("event_id").alias("line"), F.lit(1000).alias("qlen"), (F.col("event_id") % 700).alias("qstart"), (F.col("event_id") % 3).alias("qend"), dv.alias("tags"))


@query("w1_f14_mapping_filter", """SELECT 'r' || user_id AS qname, event_id AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
    WHERE n = 1 AND event_id % 3 - (event_id % 700) / 1000.0 > 0.4 AND (event_id % 10) / 100.0 < 0.05""")
def first_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_filter(_paf(spark, sf_dir)).select("qname", "line")


@query(
    "w5_w6_group_sample",
    """WITH i AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id FROM lineitem)
       SELECT l_suppkey, count(*) AS n, sum(l_partkey)::BIGINT AS parts, min(id) AS least FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(id), id) AS k FROM i) WHERE k <= 50 GROUP BY 1""",
)
def group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    kept = sample_per_group(rows, "l_suppkey", 50, "id", order=F.md5("id"))
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"), F.min("id").alias("least"))
