"""Exact ranks and running aggregates over an order, without a single-task window.

``ordered_parts`` range-partitions the rows by (group, order, tiebreak) and
writes them, each row with the number of its part, to the shared checkpoint
folder: parts are monotone in the order, equal order values are split by the
tiebreak, and a lost executor cannot change where a part begins. Row counts or
sums of the parts (a table of groups x parts) give offsets by a small window,
and ranks or running sums inside a part add up with them. The input is read
twice (once for the range sample), whatever the number of passes after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART = "_part"


def ordered_parts(df: DataFrame, order: str, tiebreak: list[str] | None = None, by: list[str] | None = None,
                  desc: bool = False) -> DataFrame:
    """``df`` with ``_part``, a part number that rises with ``order`` (falls
    for ``desc``) then ``tiebreak`` within ``by``; parts hold equal shares."""
    from kiln.session import scratch_path
    spark = df.sparkSession
    key = F.desc(order) if desc else F.asc(order)
    keys = [*(by or []), key, *(tiebreak or [])]
    parts = df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id())
    path = scratch_path(spark, "ordered")
    parts.write.parquet(path)
    return spark.read.schema(parts.schema).parquet(path)


def ordered_rank(df: DataFrame, order: str, tiebreak: list[str] | None = None, by: list[str] | None = None,
                 desc: bool = False, rank_col: str = "rank", count_col: str | None = None) -> DataFrame:
    """Adds ``rank_col`` (1-based ``row_number`` order within ``by``) by
    ``order`` (non-null; ``desc`` for descending) then ``tiebreak``, and the
    group's row count as ``count_col`` if named."""
    by = by or []
    x = ordered_parts(df, order, tiebreak, by, desc)
    wg = Window.partitionBy(*by)
    counts = x.groupBy(*by, PART).agg(F.count(F.lit(1)).alias("_c"))
    offsets = (counts.withColumn("_off", F.coalesce(F.sum("_c").over(
                   wg.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                     .withColumn("_n", F.sum("_c").over(wg)).drop("_c"))
    key = F.desc(order) if desc else F.asc(order)
    rn = F.row_number().over(Window.partitionBy(*by, PART).orderBy(key, *(tiebreak or [])))
    out = (x.withColumn("_rn", rn).join(offsets, [*by, PART])
            .withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("bigint")).drop(PART, "_rn", "_off"))
    return out.withColumnRenamed("_n", count_col) if count_col else out.drop("_n")


def prefix_sum(df: DataFrame, value: str, order: str, by: list[str] | None = None, out: str = "prefix",
               op: str = "sum", parts: bool = False) -> DataFrame:
    """Inclusive running sum (``op="max"``: running maximum) of ``value`` in
    ``order`` within ``by``, exact. ``parts``: ``df`` comes from
    ``ordered_parts`` on the same order and groups, which several calls can
    share (its part column stays)."""
    by = by or []
    agg = F.sum if op == "sum" else F.max
    combine = (lambda a, b: a + b) if op == "sum" else (lambda a, b: F.greatest(a, b))
    x = df if parts else ordered_parts(df, order, by=by)
    tot = x.groupBy(*by, PART).agg(agg(value).alias("_t"))
    off = tot.withColumn("_off", agg("_t").over(
        Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    run = agg(value).over(Window.partitionBy(*by, PART).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    res = F.when(F.col("_off").isNull(), F.col("_run")).when(F.col("_run").isNull(), F.col("_off")) \
           .otherwise(combine(F.col("_off"), F.col("_run")))
    x = x.withColumn("_run", run).join(off, [*by, PART]).withColumn(out, res).drop("_run", "_off")
    return x if parts else x.drop(PART)


def bucketed_lag(df: DataFrame, value: str, order: str, by: list[str] | None = None, out: str = "prev",
                 parts: bool = False) -> DataFrame:
    """``lag(value)`` in ``order`` within ``by`` for a non-decreasing ``value``
    (e.g. the order column itself): the previous row of the part, or for a
    part's first row the largest value of the parts before it."""
    by = by or []
    x = df if parts else ordered_parts(df, order, by=by)
    mx = x.groupBy(*by, PART).agg(F.max(value).alias("_m"))
    before = mx.withColumn("_pb", F.max("_m").over(
        Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    lag = F.lag(value).over(Window.partitionBy(*by, PART).orderBy(order))
    x = (x.withColumn("_l", lag).join(before, [*by, PART])
          .withColumn(out, F.coalesce(F.col("_l"), F.col("_pb"))).drop("_l", "_pb"))
    return x if parts else x.drop(PART)
