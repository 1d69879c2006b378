"""File sources, sinks and streaming, on fixtures written by the tests."""

import io
import json
import os
import tarfile
import zipfile

from pyspark.sql import functions as F

from kiln.operators import telemetry as H
from kiln.sources import files as S
from kiln.sources import sinks as K
from kiln.streaming import live


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_jsonl_line_numbers_and_flags(spark, tmpdir_fresh):
    lines = ['{"a": 1}', "", "not json", '{"a": 2}'] * 50
    _write(f"{tmpdir_fresh}/x.jsonl", "\n".join(lines) + "\n")
    df = S.read_jsonl(spark, f"{tmpdir_fresh}/x.jsonl")
    rows = sorted(df.collect(), key=lambda r: r.line_no)
    assert [r.line_no for r in rows] == list(range(1, 201))
    assert [r.raw for r in rows] == lines
    assert sum(r.is_blank for r in rows) == 50 and sum(r.is_bad for r in rows) == 50


def test_json_doc_rules(spark, tmpdir_fresh):
    _write(f"{tmpdir_fresh}/a/doc.json", json.dumps({"meta": 1, "rows": [{"x": 1}, {"x": 2}], "data": [{"y": 1}]}))
    first = S.read_json_doc(spark, f"{tmpdir_fresh}/a/doc.json")
    assert first.count() == 2  # first list-valued key in document order: rows
    env = S.read_json_doc(spark, f"{tmpdir_fresh}/a/doc.json", rule="envelope")
    assert env.count() == 1  # envelope precedence: data


def test_csv_long_and_short_rows(spark, tmpdir_fresh):
    _write(f"{tmpdir_fresh}/q.csv", "question,answer\nq1,a1\nq2,a2,extra\nq3\n")
    rows = S.read_delimited(spark, f"{tmpdir_fresh}/q.csv").collect()
    assert [(r.question, r.answer) for r in rows] == [("q1", "a1"), ("q3", None)]
    _write(f"{tmpdir_fresh}/t.tsv", "a\tb\n1\t2\n")
    assert S.read_delimited(spark, f"{tmpdir_fresh}/t.tsv", sep="\t").collect()[0].b == "2"


def test_xml_row_tag(spark, tmpdir_fresh):
    _write(f"{tmpdir_fresh}/d.xml", '<?xml version="1.0"?><root><meta n="1"/>' +
           "".join(f'<item id="{i}"><v>{i}</v></item>' for i in range(5)) + "</root>")
    assert S.infer_row_tag(spark, f"{tmpdir_fresh}/d.xml") == "item"
    df = S.read_xml(spark, f"{tmpdir_fresh}/d.xml")
    assert df.count() == 5 and "_id" in df.columns


def test_archives(spark, tmpdir_fresh):
    zb = io.BytesIO()
    with zipfile.ZipFile(zb, "w") as z:
        z.writestr("readme.md", "x")
        z.writestr("data/train.jsonl", '{"a":1}\n')
    with open(f"{tmpdir_fresh}/a.zip", "wb") as f:
        f.write(zb.getvalue())
    with tarfile.open(f"{tmpdir_fresh}/b.tar.gz", "w:gz") as t:
        data = b"q,a\n1,2\n"
        info = tarfile.TarInfo("set/x.csv")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    m = S.read_archive(spark, tmpdir_fresh)
    assert m.count() == 3
    first = {os.path.basename(r.archive): r.member for r in S.first_data_member(m).collect()}
    assert first == {"a.zip": "data/train.jsonl", "b.tar.gz": "set/x.csv"}


def test_inventory_and_sniff(spark, tmpdir_fresh):
    _write(f"{tmpdir_fresh}/d1/train.jsonl", '{"a":1}\n')
    _write(f"{tmpdir_fresh}/d2/x.csv", "a,b\n1,2\n")
    _write(f"{tmpdir_fresh}/d2/download_log.json", "[]")
    _write(f"{tmpdir_fresh}/img/p.png", "png")
    inv = S.file_inventory(spark, tmpdir_fresh)
    assert inv.where("is_data").count() == 2
    assert sorted(r.dataset for r in S.expand_datasets(inv).collect()) == ["d1", "d2"]
    assert S.list_images(spark, tmpdir_fresh).count() == 1
    lines = S.read_lines(spark, f"{tmpdir_fresh}/d*/*.*")
    fmts = {os.path.basename(r.file): r.format for r in S.sniff_format(lines).collect()}
    assert fmts["train.jsonl"] == "jsonl" and fmts["x.csv"] == "csv" and fmts["download_log.json"] == "json"


def test_sinks_upsert(spark, tmpdir_fresh):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "source_path string, n long")
    new = spark.createDataFrame([("b", 20), ("c", 3)], "source_path string, n long")
    got = {r.source_path: r.n for r in K.upsert_index(old, new).collect()}
    assert got == {"a": 1, "b": 20, "c": 3}
    got = {r.source_path: r.n for r in K.append_if_absent(old, new, ["source_path"]).collect()}
    assert got == {"a": 1, "b": 2, "c": 3}
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "y")], "v double, s string")
    K.write_jsonl(df, f"{tmpdir_fresh}/out")
    txt = "".join(open(os.path.join(f"{tmpdir_fresh}/out", p)).read() for p in os.listdir(f"{tmpdir_fresh}/out")
                  if p.endswith(".json"))
    assert '"v":null' in txt


def test_stream_latest_metrics(spark, tmpdir_fresh):
    src = f"{tmpdir_fresh}/logs"
    _write(f"{src}/run-a.log", "global_step: 1, loss: 2.00\nglobal_step: 2, loss: 1.50\n")
    _write(f"{src}/run-b.log", "x ERROR y\nglobal_step: 5, loss: 0.50\n")
    lines = live.stream_logs(spark, src)
    live.run_available(live.latest_metrics_stream(lines), "kiln_latest", mode="complete",
                       checkpoint=f"{tmpdir_fresh}/ck1")
    got = {r.log_id: (r.step, r.loss) for r in spark.table("kiln_latest").collect()}
    assert got == {"run-a": (2, 1.5), "run-b": (5, 0.5)}
    live.run_available(live.stream_errors_transform(lines), "kiln_errors", checkpoint=f"{tmpdir_fresh}/ck2")
    assert [r.error_type for r in spark.table("kiln_errors").collect()] == ["ERROR"]


def test_stream_action_gate_matches_batch(spark, tmpdir_fresh):
    rows = []
    for i, a in enumerate(["disk_low", "disk_low", "disk_low", None, "hang_detected", "hang_detected",
                           "hang_detected", "process_dead", "process_dead"]):
        rows.append({"run_id": "n1", "ts": f"2024-01-01 00:{i * 2:02d}:00", "anomaly": a, "in_grace": False})
    src = f"{tmpdir_fresh}/verdicts"
    os.makedirs(src)
    for i in range(0, len(rows), 3):
        _write(f"{src}/part{i}.json", "\n".join(json.dumps(r) for r in rows[i:i + 3]))
    schema = "run_id string, ts timestamp, anomaly string, in_grace boolean"
    batch = H.actions(spark.read.schema(schema).json(src).withColumnRenamed("in_grace", "_g").drop("_g"))
    b = sorted((r.ts, r.anomaly) for r in batch.collect())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    live.run_available(live.actions_stream(stream), "kiln_actions", checkpoint=f"{tmpdir_fresh}/ck3")
    s = sorted((r.ts, r.anomaly) for r in spark.table("kiln_actions").collect())
    assert s == b and len(s) >= 2


def test_foreach_batch_notifications(spark, tmpdir_fresh):
    src = f"{tmpdir_fresh}/logs2"
    _write(f"{src}/run-c.log", "CUDA out of memory\nall good\nNCCL timeout\n")
    errs = live.stream_errors_transform(live.stream_logs(spark, src)).select(
        F.col("error_type").alias("level"), "message")
    out = f"{tmpdir_fresh}/notify"
    q = (errs.writeStream.foreachBatch(live.notify_sink(out)).option("checkpointLocation", f"{tmpdir_fresh}/ck4")
             .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(r.level for r in spark.read.json(out).collect())
    assert got == ["NCCL", "OOM"]


def test_stream_hang_timeout(spark, tmpdir_fresh):
    import time as _t
    src = f"{tmpdir_fresh}/logs3"
    _write(f"{src}/run-h.log", "global_step: 1, loss: 1.00\n")
    lines = live.stream_logs(spark, src)
    q = (live.hang_stream(lines, hang_s=2.0).writeStream.format("memory").queryName("kiln_hang")
             .outputMode("append").option("checkpointLocation", f"{tmpdir_fresh}/ck5")
             .trigger(processingTime="1 second").start())
    try:
        deadline = _t.time() + 60
        while _t.time() < deadline and spark.table("kiln_hang").count() == 0:
            _t.sleep(1)
    finally:
        q.stop()
    rows = spark.table("kiln_hang").collect()
    assert [(r.log_id, r.anomaly) for r in rows] == [("run-h", "hang_detected")] and rows[0].silent_s >= 2.0


def test_stream_latest_metrics_retiring(spark, tmpdir_fresh):
    src = f"{tmpdir_fresh}/logs4"
    _write(f"{src}/run-a.log", "global_step: 1, loss: 2.00\nglobal_step: 2, loss: 1.50\n")
    _write(f"{src}/run-b.log", "global_step: 5, loss: 0.50\nx ERROR y\n")
    import time as _t
    lines = live.stream_logs(spark, src)
    # processing-time timeouts keep an availableNow query alive: drive it with a
    # processing-time trigger and stop once both logs have reported
    q = (live.latest_metrics_stream_retiring(lines, 600).writeStream.format("memory").queryName("kiln_latest2")
             .outputMode("update").option("checkpointLocation", f"{tmpdir_fresh}/ck6")
             .trigger(processingTime="1 second").start())
    try:
        deadline = _t.time() + 60
        while _t.time() < deadline and spark.table("kiln_latest2").select("log_id").distinct().count() < 2:
            _t.sleep(1)
    finally:
        q.stop()
    got = {}
    for r in spark.table("kiln_latest2").collect():
        got[r.log_id] = (r.step, r.loss)
    assert got == {"run-a": (2, 1.5), "run-b": (5, 0.5)}


def test_readme_flow(spark, tmpdir_fresh):
    from kiln.operators import clean, logs, profile, sampling
    for name, n in (("a", 30), ("b", 12)):
        body = "\n".join(['{"messages":[{"role":"user","content":"q%d"},{"role":"assistant","content":"a"}]}' % (i % 10)
                          for i in range(n)] + ["", "oops"])
        _write(f"{tmpdir_fresh}/ds/{name}/train.jsonl", body + "\n")
    raw = S.read_lines(spark, f"{tmpdir_fresh}/ds/*/train.jsonl")
    raw = raw.withColumn("dataset", raw.file)
    st = {r.dataset.split("/")[-2]: r for r in clean.clean_stats(raw, by=["dataset"]).collect()}
    assert st["a"].input_lines == 32 and st["a"].json_errors == 1 and st["a"].duplicates == 20
    kept = clean.dedup_exact(raw, pos="line_no", by=["dataset"], drop_empty=True)
    prof = {r.dataset.split("/")[-2]: r for r in profile.profile(kept, by=["dataset"]).collect()}
    assert prof["a"].num_samples == 10 and prof["a"].len_min == 3
    split = sampling.split_exact(kept, ["dataset", "line_no"], 0.9, 0.05, seed=42, by=["dataset"])
    sinks_dir = f"{tmpdir_fresh}/prepared"
    K.write_splits(split.drop("md5"), sinks_dir)
    assert spark.read.json(sinks_dir).count() == 20
    _write(f"{tmpdir_fresh}/runs/r1.log", "global_step: 1, loss: 2.00\nx ERROR y\nglobal_step: 2, loss: 1.00\n")
    lines = S.read_logs(spark, f"{tmpdir_fresh}/runs/*.log")
    fm = logs.final_metrics(lines).collect()[0]
    assert fm.log_id == "r1" and fm.final_step == 2 and fm.final_loss == 1.0
    assert [r.error_type for r in logs.error_summary(lines).collect()] == ["ERROR"]


def test_action_gate_pruning_is_exact(spark):
    """Feeding only state-changing polls to the gate gives the same actions
    as running the state machine over every poll of each run."""
    import pandas as pd
    from kiln.plans.telemetry import v_snapshots
    verdicts = H.classify_health(v_snapshots(spark, "/root/testdata/sf0.001"))
    v = verdicts.select("run_id", "ts", "anomaly").toPandas()
    exp = set()
    for _rid, g in v.groupby("run_id"):
        g = g.sort_values("ts")
        g = g.assign(in_grace=(g["ts"] - g["ts"].min()).dt.total_seconds() < 30)
        out, _ = H.gate_actions(g)
        exp |= {(r.run_id, pd.Timestamp(r.ts), r.anomaly, r.count) for r in out.itertuples()}
    got = {(r.run_id, pd.Timestamp(r.ts), r.anomaly, r["count"]) for r in H.actions(verdicts).collect()}
    assert got == exp


def test_read_any_directory(spark, tmpdir_fresh):
    _write(f"{tmpdir_fresh}/d/a/train.jsonl", '{"x":1}\n{"x":2}\n')
    _write(f"{tmpdir_fresh}/d/b/val.jsonl", '{"x":3}\n')
    _write(f"{tmpdir_fresh}/d/readme.md", "docs")
    df = S.read_any(spark, f"{tmpdir_fresh}/d")
    assert df.count() == 3 and "rec" in df.columns


def test_read_any_csv_directory(spark, tmpdir_fresh):
    _write(f"{tmpdir_fresh}/c/one/x.csv", "question,answer\nq1,a1\n")
    _write(f"{tmpdir_fresh}/c/two/y.csv", "question,answer\nq2,a2\nq3,a3\n")
    rows = sorted(r.question for r in S.read_any(spark, f"{tmpdir_fresh}/c").collect())
    assert rows == ["q1", "q2", "q3"]


def test_line_numbers_across_splits(spark, tmpdir_fresh):
    """A file read in many splits still gets exact 1..N line numbers."""
    lines = [f"line {i} " + "x" * (i % 37) for i in range(1, 2001)]
    _write(f"{tmpdir_fresh}/big/log.txt", "\n".join(lines) + "\n")
    _write(f"{tmpdir_fresh}/big/other.txt", "a\nb\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        df = S.read_lines(spark, f"{tmpdir_fresh}/big")
        assert spark.read.text(f"{tmpdir_fresh}/big/log.txt").rdd.getNumPartitions() > 10
        got = {(r.file.rsplit("/", 1)[-1], r.line_no): r.line for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [got[("log.txt", i)] for i in range(1, 2001)] == lines
    assert got[("other.txt", 1)] == "a" and got[("other.txt", 2)] == "b" and len(got) == 2002


def _hangs(rows, hang_s, waits_until):
    """Silences of each log: between its lines, and after the last one if the latest line of all is far enough on."""
    out = []
    for log in sorted({r[0] for r in rows}):
        t = sorted(x for name, x in rows if name == log)
        out += [(log, a) for a, b in zip(t, t[1:]) if b - a > hang_s] + ([(log, t[-1])] if waits_until > t[-1] + hang_s else [])
    return sorted(out)


def test_event_time_hangs_survive_restarts(spark, tmpdir_fresh):
    """Silences across micro-batches and restarts are told once each."""
    import datetime as dt
    import random
    rng = random.Random(3)
    rows = sorted({(f"log{rng.randrange(4)}", rng.randrange(0, 9_000, 7)) for _ in range(120)}, key=lambda r: r[1])
    src, out = f"{tmpdir_fresh}/lines", f"{tmpdir_fresh}/out"
    os.makedirs(src)
    schema = "log_id string, ts timestamp"
    for i in range(3):
        part = rows[len(rows) * i // 3:len(rows) * (i + 1) // 3]
        # slices must not share a time: what the watermark has passed is late
        part = [r for r in part if i == 0 or r[1] > rows[len(rows) * i // 3 - 1][1]]
        rows = [r for r in rows if r in part or not rows.index(r) in range(len(rows) * i // 3, len(rows) * (i + 1) // 3)]
        _write(f"{src}/part{i}.json", "\n".join(json.dumps(
            {"log_id": n, "ts": dt.datetime.fromtimestamp(t, dt.timezone.utc).isoformat()}) for n, t in part))
        lines = spark.readStream.schema(schema).json(src).withWatermark("ts", "0 seconds")
        q = (live.hang_stream(lines, 300.0, event_time="ts").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", f"{tmpdir_fresh}/ck").trigger(availableNow=True).start())
        q.awaitTermination(120)
    got = sorted((r.log_id, int(r.s)) for r in spark.read.parquet(out).selectExpr("log_id", "unix_seconds(last_seen) as s").collect())
    assert got == _hangs(rows, 300, max(t for _, t in rows)) and len(got) > 5


def test_event_time_gate_retires(spark, tmpdir_fresh):
    """A run that is silent for the retirement time begins anew: its counters are gone."""
    polls = [("a", 0, "disk_low"), ("b", 10, None), ("b", 2_000, "x"), ("a", 2_100, "disk_low"), ("a", 2_200, "disk_low")]
    src = f"{tmpdir_fresh}/polls"
    os.makedirs(src)
    for i, part in enumerate((polls[:2], polls[2:3], polls[3:])):
        _write(f"{src}/p{i}.json", "\n".join(json.dumps(
            {"run_id": r, "ts": f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}", "anomaly": a, "in_grace": False}) for r, t, a in part))
        stream = spark.readStream.schema("run_id string, ts timestamp, anomaly string, in_grace boolean").json(src)
        acts = live.actions_stream(stream.withWatermark("ts", "0 seconds"), retire_after_s=1_000, event_time=True)
        q = (acts.writeStream.format("parquet").option("path", f"{tmpdir_fresh}/out").option("checkpointLocation", f"{tmpdir_fresh}/ck")
             .trigger(availableNow=True).start())
        q.awaitTermination(120)
    got = [(r.run_id, r.ts.minute * 60 + r.ts.second, r["count"]) for r in spark.read.parquet(f"{tmpdir_fresh}/out").collect()]
    assert got == [("a", 2_200, 2)]
