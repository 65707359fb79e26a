"""Connected components by repeated contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.store import delete, written


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (a, b): vertices have the same root if and only if they are connected.

    In each round every vertex points at the neighbour (or itself) that comes first in an order drawn anew for
    the round; edges are carried over to the vertices pointed at. A constant share of the vertices goes in each
    round whatever the graph's shape, so the rounds grow as the logarithm of its size. Hubs meet partial
    aggregates and splittable joins only. Null ends and loops are ignored; no edges give no rows.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    chains = None
    turn = 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("o"), F.col(c).alias("v"))
        to = written(both.groupBy(F.col("a").alias("u")).agg(F.min(order("b")).alias("n")).select("u", F.least("n", order("u"))["v"].alias("p")), "pointers")
        if chains is None:
            chains = to.select(F.col("u").alias("vertex"), F.col("p").alias("root"))
        else:
            hop = to.select(F.col("u").alias("root"), F.col("p").alias("next"))
            chains = chains.join(hop, "root", "left").select("vertex", F.coalesce("next", "root").alias("root"))
        before, chains = chains, written(chains, "chains")
        pa, pb = to.select(F.col("u").alias("a"), F.col("p").alias("pa")), to.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = left.join(pa, "a").join(pb, "b").where("pa <> pb")
        old, left = left, written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        delete(old, to, before)
        turn += 1
    delete(left)
    if chains is None:
        kind = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], "vertex int, root int").select(F.col("vertex").cast("string").cast(kind), F.col("root").cast("string").cast(kind))
    return chains
