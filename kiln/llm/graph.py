"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import written


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (the smallest node that links reach) for every node of ``edges`` (u, v of one orderable type).

    Each round hangs every neighbour on the smallest one, first the larger ones, then the smaller ones, so
    paths shorten by a constant factor; rounds stop when the edges no longer change. Neighbour minima are
    partial aggregates and each round is written to the shared folder."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                f"{name}-edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), f"{name}-edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()


def _mark(e: DataFrame) -> tuple:
    """Row count and order-free checksum: two numbers."""
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]
