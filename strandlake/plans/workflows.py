"""Whole analyses, each one plan without files in between."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import alignment, calls, ml, reads, sites, sources_lr


def base_calls(raw: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], k: int = 11, least_length: int = 1000) -> DataFrame:
    """Reads to calls (read_id, pos, base, prob): A of either strand, scored by the network on its k-mer features.

    Calls on the reverse strand are given at their place on the forward one, where the base is a T.
    """
    rows = ml.score_network(reads.feature_rows(reads.consistent(raw, least_length), k), layers)
    n = raw.select("read_id", F.length("seq").alias("n"))
    back = F.col("strand") == "-"
    return rows.join(n, "read_id").select("read_id", F.when(back, F.col("n") - 1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), F.when(back, "T").otherwise("A").alias("base"), "prob")


def tagged_reads(raw: DataFrame, found: DataFrame) -> DataFrame:
    """All reads, kinetic tags gone, those with calls with their new tags."""
    tags = calls.encode_tags(raw.select("read_id", "seq"), found)
    return raw.drop("fi", "ri", "fp", "rp", "mm", "ml", "zp").join(tags, "read_id", "left")


def site_frequencies(aligned: DataFrame, contigs: DataFrame, found: DataFrame, threshold: float = 0.5, **limits) -> DataFrame:  # noqa: ANN003
    """Alignments and calls to frequencies by reference site."""
    table = alignment.base_table(aligned, contigs, found, mapped_only=True, **limits)
    return sites.site_frequency(table.select(F.col("rname").alias("chr"), F.col("rpos").alias("coor"), "prob"), threshold)


def read_classes(found: DataFrame, model: ml.Svm, buckets: int = 100, least_calls: int = 1) -> DataFrame:
    """(read, tag) of each read with calls, from the histogram of its probabilities."""
    shares = calls.histogram(found, buckets)
    vectors = shares.groupBy("read_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "share"))).alias("m"))
    dense = vectors.select("read_id", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("features"))
    counted = dense.join(found.groupBy("read_id").agg(F.count("*").alias("n_calls")), "read_id")
    return ml.predict_reads(counted, model, least_calls=least_calls).select(F.col("read_id").alias("read"), "tag")


def source_ratios(found: DataFrame, model: ml.Svm, contig_of: DataFrame, species_of: DataFrame | None = None) -> DataFrame:
    """Calls to likelihood ratios by source."""
    return sources_lr.likelihood_ratio(read_classes(found, model), contig_of, species_of)
