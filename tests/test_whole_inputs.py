"""Operators read whole inputs (the only hit lies beyond an old limit), and the
inputs on which answers were wrong."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kiln.operators import clean, convert, logs, profile, sampling, telemetry, textmetrics
from kiln.sources import files as S


def lines_of(spark, rows, cols="pos long, line string"):
    return spark.createDataFrame(rows, cols)


# ------------------------------------------------------------ beyond the old limits

def log(spark, special, n=110_000):
    """A log of ``n`` lines, ``special`` (number -> text) among filler."""
    marks = spark.createDataFrame(list(special.items()), "line_no long, text string")
    base = spark.range(1, n + 1).select(F.col("id").alias("line_no"))
    return base.join(marks, "line_no", "left").select(F.lit("run").alias("log_id"), "line_no",
                                                      F.coalesce("text", F.lit("filler")).alias("line"))


def test_final_metrics_read_the_whole_log(spark):
    x = log(spark, {4: "eval_loss: 0.25", 5: "global_step: 7, loss: 1.5", 9000: "Total optimization steps = 1,234"})
    r = logs.final_metrics(x).collect()[0]
    assert (r.max_steps, r.final_step, r.final_loss, r.best_eval_loss) == (1234, 7, 1.5, 0.25)
    assert [tuple(e) for e in logs.eval_losses(x).collect()] == [("run", 4, 0.25)]
    assert logs.final_metrics(x, tail=200, header=2000).count() == 0


def test_errors_far_down_with_whole_messages(spark):
    long = "FATAL " + "x" * 500
    r = logs.error_summary(log(spark, {109_000: long})).collect()
    assert [(e.line_num, e.message) for e in r] == [(109_000, long)]


def test_run_status_from_an_early_step(spark):
    final = logs.final_metrics(log(spark, {3: "global_step: 95, loss: 1.0", 4: "Total optimization steps = 100"}))
    exits = spark.createDataFrame([("run", 1)], "log_id string, exit_code int")
    assert logs.run_status(final, exits).collect()[0].status == "completed"


def test_checks_see_every_line(spark):
    filler = [(i, '{"a": 1}') for i in range(12_000)]
    ek = '{"image_info": [{"image_url": "./b.png"}, {"image_url": "./a.png"}], "text_info": [{"text": "t", "tag": "mask"}]}'
    x = lines_of(spark, [*filler, (12_000, ek)])
    assert clean.detect_format(x).collect()[0].format == "erniekit"
    none = spark.createDataFrame([], "path string")
    got = clean.missing_images(x, none, "/d").orderBy("line_no", "k").collect()
    assert [(r.line_no, r.url) for r in got] == [(12_000, "./b.png"), (12_000, "./a.png")]  # in the line's order
    assert clean.image_drop(x, True).collect()[0].rows_checked == 12_001
    s = clean.validation_summary(x, "erniekit").collect()[0]
    assert (s.valid, s.n_errors, s.samples_checked) == (False, 12_000, 12_001)
    assert clean.validation_errors(x, "erniekit").count() == 12_000
    assert clean.jsonl_has_images(lines_of(spark, [*filler, (12_000, '{"image": 1}')])).collect()[0].has_images
    csv = [(0, "q,a")] + [(i, "x,y") for i in range(1, 50)]
    assert not clean.csv_has_images(lines_of(spark, csv)).collect()[0].has_images
    assert clean.csv_has_images(lines_of(spark, [*csv, (50, "x,img/1.png")])).collect()[0].has_images
    assert {r.key for r in clean.infer_schema(lines_of(spark, [*filler, (12_000, '{"late": "x"}')])).collect()} == {"a", "late"}


def test_sniff_and_row_tag(spark, tmpdir_fresh):
    p = f"{tmpdir_fresh}/blank.txt"
    with open(p, "w") as f:
        f.write("\n" * 40 + '{"a": 1}\n')
    assert S.sniff_format(S.read_lines(spark, p)).collect()[0].format == "jsonl"
    os.makedirs(f"{tmpdir_fresh}/xml")
    for k in range(3):
        with open(f"{tmpdir_fresh}/xml/{k}.xml", "w") as f:
            f.write("<root>" + "<head><row/></head>" * (2 if k else 1) + "<!-- <row/> -->" + "<row><v>1</v></row>" * (3 + 4000 * (k == 2)) + "</root>")
    assert S.infer_row_tag(spark, f"{tmpdir_fresh}/xml") == "row"
    assert S.read_xml(spark, f"{tmpdir_fresh}/xml").where("v = 1").count() == 4009


# ------------------------------------------------------------ answers that were wrong

def test_expand_datasets_from_a_uri(spark, tmpdir_fresh):
    for name in ("one", "two.x"):
        os.makedirs(f"{tmpdir_fresh}/{name}")
        with open(f"{tmpdir_fresh}/{name}/d.jsonl", "w") as f:
            f.write("{}\n")
    for root in (tmpdir_fresh, f"file:{tmpdir_fresh}", f"file://{tmpdir_fresh}/"):
        got = S.expand_datasets(S.file_inventory(spark, root)).collect()
        assert sorted(r.dataset for r in got) == ["one", "two.x"]
    assert S.read_any(spark, f"file:{tmpdir_fresh}").count() == 2


def test_align_pairs_fails_in_both_directions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, pred string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k long, ref string")
    assert textmetrics.align_pairs(a, b, "k").count() == 2
    for p, r in ((a.where("k = 1"), b), (a, b.where("k = 1"))):
        with pytest.raises(Exception, match="Length mismatch"):
            textmetrics.align_pairs(p, r, "k").select("pred").collect()
        with pytest.raises(Exception, match="Length mismatch"):
            textmetrics.align_pairs(p, r, "k").select("ref").collect()


@pytest.mark.parametrize("sep", [",", "\t"])
def test_quoted_delimited(spark, tmpdir_fresh, sep):
    p = f"{tmpdir_fresh}/q.csv"
    with open(p, "w") as f:
        f.write(sep.join(['"a, b"', "c"]) + "\n")
        f.write(sep.join(['"say ""hi"""', "1"]) + "\n")
        f.write(sep.join(['"two\nlines"', f'"x{sep}y"']) + "\n")
        f.write(sep.join(["too", "many", "fields"]) + "\n")
        f.write("short\n" + sep.join(["", "e"]) + "\n")
    df = S.read_delimited(spark, p, sep)
    assert df.columns == ["a, b", "c"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        [('say "hi"', "1"), ("two\nlines", f"x{sep}y"), ("short", None), (None, "e")], key=str)


def test_missing_fields_are_empty(spark):
    rows = ['{"text_info":[{"tag":"mask"}]}', '{"messages":[{"role":"user"}]}', '{"text_info":[{"text":null}]}',
            '{"messages":[{"content":"x"}]}', '{"text_info":[]}']
    x = lines_of(spark, list(enumerate(rows)))
    assert sorted(r.pos for r in clean.dedup_exact(x, drop_empty=True).collect()) == [2, 3]
    assert clean.clean_stats(x).collect()[0].empty_content == 3


def test_clean_lines_output(spark):
    rows = ['{"text_info":[{"text":"  a \\" b\\n","tag":"mask"},7,{"text":5}],"z":[1,{"q":null}],"k\\"ey":" keep "}', "bad",
            '{"messages":[{"role":"u","content":"\\u00a0é "}]}', '{"messages":[{"role":"u","content":"\\u00a0é "}]}', '{"x":" "}']
    got = [json.loads(r.line) for r in clean.clean_lines(lines_of(spark, list(enumerate(rows)))).orderBy("pos").collect()]
    assert got == [{"text_info": [{"text": 'a " b', "tag": "mask"}, 7, {"text": "5"}], "z": [1, {"q": None}], 'k"ey': " keep "},
                   {"messages": [{"role": "u", "content": "é"}]}]


def test_falsy_lists_count_as_length_zero(spark):
    rows = ['{"text_info":null}', '{"text_info":""}', '{"messages":[]}', '{"text_info":[{"text":"abcd"}]}', '{"other":1}']
    r = profile.profile(lines_of(spark, list(enumerate(rows)))).collect()[0]
    assert (r.len_min, r.len_max, r.len_p50, r.len_avg) == (0, 4, 0, 1)


def test_size_sums_equal_files(spark, tmpdir_fresh):
    os.makedirs(f"{tmpdir_fresh}/s")
    for k in range(3):
        with open(f"{tmpdir_fresh}/s/{k}.txt", "w") as f:
            f.write("x" * (1 << 20))
    df = spark.read.text(f"{tmpdir_fresh}/s")
    assert profile.size_mb(df).collect()[0].size_mb == 3.0


def test_object_images_pass(spark):
    df = spark.createDataFrame([(1, [("u", "hi")], [("./a.png", 2)])],
                               "id long, messages array<struct<role:string,content:string>>, "
                               "images array<struct<image_url:string,matched_text_index:int>>")
    r = convert.messages_to_erniekit(df).collect()[0]
    assert [tuple(i) for i in r.image_info] == [("./a.png", 2)]


def test_tier1_reason_and_factor(spark):
    df = spark.createDataFrame([("CUDA out of memory",), ("loss is nan",), ("fine",)], "message string")
    got = {r.message: (r.factor, r.reason) for r in logs.diagnose_tier1(df).collect()}
    assert got == {"CUDA out of memory": (0.5, "GPU OOM detected"), "loss is nan": (0.1, "NaN loss detected"), "fine": (None, None)}


def test_action_notifications(spark):
    rows = [("hang_detected", 50.0), ("oom_risk_gpu1", 50.0), ("disk_low", 3.4), ("process_dead", 1.0)]
    got = telemetry.action_notifications(spark.createDataFrame(rows, "anomaly string, disk_free_gb double")).collect()
    assert {(r.anomaly, r.level, r.message) for r in got} == {
        ("hang_detected", "ACTION", "Watchdog auto-killing hung training process"),
        ("oom_risk_gpu1", "WARN", "GPU OOM risk: oom_risk_gpu1"), ("disk_low", "CRITICAL", "Disk space critical: 3.4GB free")}


def test_merge_needs_a_completed_dataset(spark):
    rec = spark.createDataFrame([("d", "train", [("./images/1.png", 0)]), ("d", "val", [("./images/2.png", 0)]),
                                 ("e", "train", [("./x.png", 0)]), ("d", "test", [])],
                                "dataset string, split string, image_info array<struct<image_url:string,matched_text_index:int>>")
    index = spark.createDataFrame([("d", "completed", "/src/d/"), ("e", "failed", "/src/e")],
                                  "dataset string, status string, source_dir string")
    m = sampling.merge_completed(rec, index)
    assert sorted((r.split, r.image_info[0].image_url) for r in m.collect()) == [
        ("train", "/src/d/images/1.png"), ("val", "./images/2.png")]
    assert [tuple(r) for r in sampling.merge_counts(m).collect()] == [("d", 1, 1)]
    with pytest.raises(Exception, match="no completed datasets"):
        sampling.merge_completed(rec, index.where("status = 'failed'")).collect()


def test_trial_run_is_bounded(spark):
    def fn(batches):
        yield from batches
    df = spark.range(500)
    assert convert.user_conversion(df, fn, "id long", trial_rows=100).count() == 100


def test_live_gate_orders_a_run_across_chunks():
    import pandas as pd
    from kiln.streaming.live import _Gate

    class State(dict):
        """One state variable, and the timers of its handle."""

        def exists(self):
            return bool(self)

        def get(self):
            return self["value"]

        def update(self, value):
            self["value"] = value

        def updateValue(self, key, value):
            self[key] = value

        def removeKey(self, key):
            del self[key]

        def iterator(self):
            return iter(self.items())

    class Handle:
        timers = []
        getMapState = getValueState = lambda *_: State()

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers = [*self.timers, at]

        def deleteTimer(self, at):
            self.timers = [t for t in self.timers if t != at]

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 5_000

    t = pd.Timestamp("2026-01-01")
    at = lambda s: pd.DataFrame({"run_id": ["r"] * len(s), "ts": [t + pd.Timedelta(seconds=x) for x in s],
                                 "anomaly": ["hang_detected"] * len(s), "in_grace": [False] * len(s)})
    gate, handle = _Gate(60.0, False), Handle()
    gate.init(handle)
    out = pd.concat(list(gate.handleInputRows(("r",), iter([at([700, 800]), at([0, 100])]), Clock())))
    assert out["ts"].tolist() == [t + pd.Timedelta(seconds=100), t + pd.Timedelta(seconds=700)]
    assert handle.timers == [65_001] and gate.counters == {("hang_detected",): (4,)}
    list(gate.handleInputRows(("r",), iter([at([900])]), Clock()))
    assert handle.timers == [65_001]  # moved, not added
    assert list(gate.handleExpiredTimer(("r",), Clock(), None)) == [] and not gate.counters and not gate.last


def test_no_scratch_folder_on_a_cluster():
    from kiln import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Spark:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Spark())


def test_jvm_functions_run(spark):
    """The jar's functions are there and agree with the Python kernels."""
    from kiln.functions import editdistance, jvm
    assert jvm.available()
    df = spark.createDataFrame([("kitten", "sitting"), ("é😀a", "ea"), ("", "x")], "a string, b string")
    got = df.select("a", "b", F.call_function("kiln_levenshtein", "a", "b").alias("d")).collect()
    assert all(r.d == editdistance.levenshtein_bits(r.a, r.b) for r in got)


def test_ratio_sweep_rows_sum_to_one():
    for n in range(2, 13):
        rows = sampling.ratio_sweep(n)
        assert all(len(r) == n and abs(sum(r) - 1) < 1e-12 for r in rows)
    assert len(sampling.ratio_sweep(4)) == 5 and len(sampling.ratio_sweep(12)) == 1


def test_log_ends_by_top_k(spark):
    """Skeleton and traceback tail keep the right lines of logs of any make-up, and no join sees whole logs."""
    import random
    from kiln.operators import logs as L
    rng = random.Random(5)
    rows, want_tail, want_skeleton = [], {}, {}
    for n in range(40):
        kinds = rng.choice([["same ERROR"], ["plain %d"], ["x ERROR %d", "plain %d"], ["plain", "ERROR", "Traceback (most %d)", "b %d"]])
        lines = [(k % i if "%d" in k else k) for i in range(rng.choice([0, 1, 4, 9, 10, 11, 14, 16, 40, 120])) for k in [rng.choice(kinds)]]
        rows += [(f"log{n}", i + 1, x) for i, x in enumerate(lines)]
        tb = max((i for i, x in enumerate(lines) if "Traceback" in x), default=None)
        want_tail[f"log{n}"] = lines[-10:] if tb is None else lines[tb:][-15:]
        if len(lines) <= 10:
            want_skeleton[f"log{n}"] = lines
        else:
            key = [x for i, x in enumerate(lines) if "ERROR" in x or "Traceback" in x]
            found = list(dict.fromkeys(lines[:5] + [x for x in key] + [x for x in lines[-5:]]))
            want_skeleton[f"log{n}"] = found if len(found) <= 10 else found[:5] + ["...[truncated]..."] + found[-5:]
    df = spark.createDataFrame(rows, "log_id string, line_no long, line string").repartition(5)
    got = {}
    for r in L.stderr_tail(df).orderBy("log_id", "line_no").collect():
        got.setdefault(r.log_id, []).append(r.line)
    assert got == {k: v for k, v in want_tail.items() if v}
    got = {}
    for r in L.skeleton(df, max_lines=10).orderBy("log_id", "seq").collect():
        got.setdefault(r.log_id, []).append(r.line)
    assert got == {k: v for k, v in want_skeleton.items() if v}
    plan = L.stderr_tail(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("WindowGroupLimit") == 2


def test_halves_of_many_experiments(spark, monkeypatch):
    """The best losses of both halves, with a sketch so coarse that it has to leave rows out."""
    import random
    from kiln.operators import experiments as E
    monkeypatch.setattr(E, "MIDDLE", 50)
    rng = random.Random(2)
    factors = [(f"f{i}", "linear", False, 0.0, 1e9, 9, 1.0) for i in range(6)]
    rows = []
    for (f, *_), n in zip(factors, (0, 1, 4, 5, 999, 3000)):
        seqs = rng.sample(range(10 ** 9), n)
        rows += [(f, float(rng.randrange(100)), s, "completed", rng.choice([1.0, 0.96, 0.9]) * (1 + rng.random())) for s in seqs]
    df = spark.createDataFrame(rows, "factor string, value double, seq long, status string, final_loss double").repartition(6)
    fac = spark.createDataFrame(factors, "factor string, scale string, discrete boolean, min_value double, max_value double, "
                                         "max_rounds int, default_value double")
    got = {r.factor: r.reason for r in E.factor_trend(df, fac, 1).collect()}
    for f, *_ in factors:
        losses = [r[4] for r in sorted((r for r in rows if r[0] == f), key=lambda r: r[2])]
        if len(losses) >= 4:
            a, b = min(losses[:len(losses) // 2]), min(losses[len(losses) // 2:])
            assert (got[f] == "converged") == ((a - b) / a < 0.05), f
    assert got["f0"] == "no_valid" and got["f1"] == "single"
