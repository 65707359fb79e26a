"""Per-site call frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.registry import query, table


def site_frequency(calls: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Calls at or above and below ``threshold`` by (chr, coor), and the share above; calls without a site or probability don't count."""
    known = calls.where("chr is not null and coor is not null and prob is not null")
    above, below = F.count_if(F.col("prob") >= threshold), F.count_if(F.col("prob") < threshold)
    return known.groupBy("chr", "coor").agg(above.alias("above"), below.alias("below")).withColumn("ratio", F.coalesce(F.try_divide("above", F.col("above") + F.col("below")), F.lit(0.0)))


def driver_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base calls made of line items."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("chr"), F.col("l_partkey").alias("coor"), (F.col("l_discount") * 10).alias("prob"))


@query(
    "a1_site_frequency",
    """SELECT l_returnflag || '_' || l_linestatus AS chr, l_partkey AS coor,
              count(*) FILTER (WHERE l_discount * 10 >= 0.5)::BIGINT AS above, count(*) FILTER (WHERE l_discount * 10 < 0.5)::BIGINT AS below,
              round(avg((l_discount * 10 >= 0.5)::INT), 6) AS ratio
       FROM lineitem GROUP BY 1, 2""",
)
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_frequency(driver_calls(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))
