"""Site frequencies of a stream of calls, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_frequency(calls: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts by site over all of the stream so far; the state is two counts a site."""
    known = calls.where("chr is not null and coor is not null and prob is not null")
    return known.groupBy("chr", "coor").agg(F.count_if(F.col("prob") >= threshold).alias("above"), F.count_if(F.col("prob") < threshold).alias("below"))


def windowed_frequency(calls: DataFrame, time: str, every: str = "10 minutes", late: str = "30 minutes", threshold: float = 0.5) -> DataFrame:
    """Counts by site and time window; windows are given out once the watermark has passed them, and their state goes."""
    return calls.withWatermark(time, late).groupBy(F.window(time, every).alias("window"), "chr", "coor").agg(F.count_if(F.col("prob") >= threshold).alias("above"), F.count_if(F.col("prob") < threshold).alias("below"))


def keep_updated(calls: DataFrame, path: str, checkpoint: str, threshold: float = 0.5) -> StreamingQuery:
    """Append each batch's counts by site, marked with the batch's number, to ``path``; ``totals`` sums them up.

    A batch that runs again overwrites its own folder, so no call counts twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        running_frequency(batch, threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return calls.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("chr", "coor").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
    return sums.withColumn("ratio", F.coalesce(F.try_divide("above", F.col("above") + F.col("below")), F.lit(0.0)))
