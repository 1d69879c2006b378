"""Keyed merges as a row-by-row run makes them, stored tables, and stream batches that are written once."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from kiln.sources import sinks as K
from kiln.streaming import live


def row_by_row(old, new, how):
    """The reference's loop: one record after another."""
    table = [list(r) for r in old]
    for key, value, _ in sorted(new, key=lambda r: r[2]):
        at = [i for i, r in enumerate(table) if r[0] == key]
        if not at:
            table.append([key, value])
        elif how == "upsert":
            table[at[0]][1] = value
    return sorted(map(tuple, table), key=str)


def made(seed, n_keys=40):
    rng = random.Random(seed)
    keys = [None if k == 0 else f"k{k}" for k in range(n_keys)]
    old = [(k, "old") for k in rng.sample(keys, n_keys // 2)]
    new = [("hot" if i % 3 == 0 else rng.choice(keys), f"v{i}", i) for i in range(200)]
    rng.shuffle(new)
    return old, new


@pytest.mark.parametrize("how", ["upsert", "absent"])
def test_repeated_keys(spark, how):
    old, new = made(1)
    merge = {"upsert": K.upsert, "absent": K.append_if_absent}[how]
    o = spark.createDataFrame(old, "`a.key` string, v string")
    n = spark.createDataFrame(new, "`a.key` string, v string, seq long").repartition(7)
    got = sorted(((r["a.key"], r.v) for r in merge(o, n, ["a.key"], "seq").collect()), key=str)
    assert got == row_by_row(old, new, how)


def test_equal_order_and_no_rows(spark):
    o = spark.createDataFrame([("a", "old")], "k string, v string")
    n = spark.createDataFrame([("a", "1", 5), ("a", "2", 5), ("b", "1", 5), ("b", "1", 5)], "k string, v string, seq long")
    for parts in (1, 4):
        assert sorted((r.k, r.v) for r in K.upsert(o, n.repartition(parts), ["k"], "seq").collect()) == [("a", "2"), ("b", "1")]
    none = n.where("false")
    assert [tuple(r)[:2] for r in K.upsert(o, none, ["k"], "seq").collect()] == [("a", "old")]
    assert K.append_if_absent(o.where("false"), none, ["k"]).count() == 0


@pytest.mark.parametrize("how", ["upsert", "absent"])
def test_merges_into_a_stored_table(spark, tmpdir_fresh, how):
    path, want = f"{tmpdir_fresh}/table", []
    for step in range(3):
        _, new = made(10 + step)
        new = [(k, f"{step}-{v}", s) for k, v, s in new if step < 2 or k == "hot"]
        before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/*.parquet")}
        df = spark.createDataFrame(new, "k string, v string, seq long")
        K.merge_into(spark, path, df, ["k"], "seq", how, buckets=8)
        want = row_by_row(want, new, how)
        assert sorted(((r.k, r.v) for r in spark.read.parquet(path).collect()), key=str) == want
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/*.parquet")}
    kept = [f for f in before if f in after]
    assert len({os.path.dirname(f) for f in before}) - len({os.path.dirname(f) for f in kept}) == 1  # one bucket was rewritten
    K.merge_into(spark, path, df, ["k"], "seq", how, buckets=8)  # again: nothing changes
    assert sorted(((r.k, r.v) for r in spark.read.parquet(path).collect()), key=str) == want


def test_a_retried_batch_is_there_once(spark, tmpdir_fresh):
    src, out = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/log"
    os.makedirs(src)
    for i in range(3):
        with open(f"{src}/run-{i}.log", "w") as f:
            f.write("CUDA out of memory\nok\nNCCL timeout\n")
    sink, broken = live.notify_sink(out), []

    def dies_after_the_second_write(batch, epoch):
        sink(batch, epoch)
        if epoch == 1 and not broken:
            broken.append(epoch)
            raise RuntimeError("killed between the write and the commit")

    def run():
        errors = live.stream_errors_transform(live.stream_logs(spark, src, max_files_per_trigger=1)).select("log_id", "error_type")
        q = (errors.writeStream.foreachBatch(dies_after_the_second_write).option("checkpointLocation", f"{tmpdir_fresh}/ck")
             .trigger(availableNow=True).start())
        q.awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        run()
    assert broken == [1]
    run()
    got = K.read_batches(spark, out, "log_id string, error_type string")
    assert sorted((r.log_id, r.error_type) for r in got.collect()) == sorted((f"run-{i}", e) for i in range(3) for e in ("OOM", "NCCL"))
    assert sorted(r.batch for r in got.select("batch").distinct().collect()) == [0, 1, 2]
    assert got.where(F.col("timestamp").isNull()).count() == 0
