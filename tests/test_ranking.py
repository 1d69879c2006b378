"""The bucketed rank / running-aggregate / lag helpers equal plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from kiln.functions.ranking import bucketed_lag, ordered_rank, prefix_sum
from kiln.operators.sampling import hash_rank


def _data(spark, n=3000, seed=5):
    rnd = random.Random(seed)
    # one hot group holding half the rows, ties in the order values
    rows = [("hot" if rnd.random() < 0.5 else f"g{rnd.randint(0, 9)}", i, rnd.randint(0, 500) / 7.0, rnd.randint(0, 3))
            for i in range(n)]
    return spark.createDataFrame(rows, "g string, seq long, v double, w int")


def test_ordered_rank_equals_row_number(spark):
    df = _data(spark)
    got = ordered_rank(df, "v", ["seq"], by=["g"]).select("seq", "rank")
    exp = df.select("seq", F.row_number().over(Window.partitionBy("g").orderBy("v", "seq")).alias("rank"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    desc = ordered_rank(df, "v", ["seq"], desc=True).select("seq", "rank")
    exp2 = df.select("seq", F.row_number().over(Window.orderBy(F.col("v").desc(), "seq")).alias("rank"))
    assert desc.exceptAll(exp2).count() == 0


def test_prefix_sum_and_max(spark):
    df = _data(spark)
    w = Window.partitionBy("g").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    got = prefix_sum(df, "w", "seq", by=["g"], out="p").select("seq", "p")
    exp = df.select("seq", F.sum("w").over(w).alias("p"))
    assert got.exceptAll(exp).count() == 0
    gotm = prefix_sum(df, "v", "seq", by=["g"], out="p", op="max").select("seq", "p")
    expm = df.select("seq", F.max("v").over(w).alias("p"))
    assert gotm.exceptAll(expm).count() == 0


def test_bucketed_lag(spark):
    df = _data(spark).withColumn("t", F.col("seq").cast("double"))
    got = bucketed_lag(df, "t", "t", ["g"], out="prev").select("seq", "prev")
    exp = df.select("seq", F.lag("t").over(Window.partitionBy("g").orderBy("t")).alias("prev"))
    assert got.exceptAll(exp).count() == 0


def test_hash_rank_is_a_permutation(spark):
    df = _data(spark)
    r = hash_rank(df, "seq", seed=3, by=["g"], hex_digits=2)
    exp = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit("3"), F.col("seq").cast("string")))).select(
        "seq", F.row_number().over(Window.partitionBy("g").orderBy("_h", "seq")).alias("_rank"))
    assert r.select("seq", "_rank").exceptAll(exp).count() == 0


def test_dedup_combines_before_the_shuffle(spark):
    """A line repeated in a third of all rows is folded map-side: the plan
    aggregates partially before the exchange and the result is exact."""
    from kiln.operators import clean
    rows = [(i, '{"a": "hot"}' if i % 3 == 0 else '{"a": %d}' % i) for i in range(3000)]
    df = spark.createDataFrame(rows, "pos long, line string").repartition(8)
    out = clean.dedup_exact(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and plan.index("partial_min") > plan.index("Exchange")  # partial below the exchange
    got = {r.line: r.pos for r in out.collect()}
    assert got['{"a": "hot"}'] == 0 and len(got) == 2001
    st = clean.clean_stats(df).collect()[0]
    assert st.duplicates == 999 and st.valid_lines == 2001


def test_ordered_rank_splits_ties(spark):
    """Equal order values are split by the tiebreak: no part is above twice the mean."""
    from kiln.functions.ranking import PART, ordered_parts
    rows = [(i, float("inf") if i % 7 == 0 else float(i)) for i in range(20000)]
    df = spark.createDataFrame(rows, "seq long, v double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ordered_parts(df, "v", ["seq"]).groupBy(PART).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = ordered_rank(df, "v", ["seq"], count_col="n").select("seq", "rank", "n")
    exp = df.select("seq", F.row_number().over(Window.orderBy("v", "seq")).alias("rank"), F.lit(20000).cast("long").alias("n"))
    assert got.exceptAll(exp).count() == 0
