"""Queries of whole workflows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.alignment import _ALL, sequenced
from strandlake.plans import driver_views as views
from strandlake.plans import workflows
from strandlake.registry import query


@query(
    "wf_site_frequencies",
    f"""{_ALL}, {views.ORIGINAL_CALLS_SQL}, placed AS (SELECT c.read_id, CASE WHEN flag & 16 > 0 THEN len(seq) - 1 - c.pos ELSE c.pos END AS q, rname, prob FROM calls c JOIN aligned USING (read_id) WHERE ec >= 6 AND mapq >= 10)
        SELECT rname AS chr, r AS coor, count(*) FILTER (WHERE prob >= 0.5) AS above, count(*) FILTER (WHERE prob < 0.5) AS below, round(avg((prob >= 0.5)::INT), 6) AS ratio
        FROM placed JOIN ident USING (read_id) JOIN pairs ON pairs.read_id = placed.read_id AND pairs.q = placed.q AND a = b AND a IN ('A', 'T') WHERE identity >= 20 GROUP BY 1, 2""",
)
def site_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = views.sequences(spark, sf_dir).select("read_id", "seq", "flag")
    out = workflows.site_frequencies(views.alignments(seqs), views.contigs(spark, sf_dir), views.calls(sequenced(seqs)), least_identity=20.0)
    return out.withColumn("ratio", F.round("ratio", 6))
