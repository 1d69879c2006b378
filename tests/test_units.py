"""Operator unit tests with hand-computed values (the reference's own test
values and the examples from its plan documents)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kiln.functions.editdistance import levenshtein_bits, token_levenshtein
from kiln.operators import experiments as E
from kiln.operators import logs as L
from kiln.operators import runs as R
from kiln.operators import sampling as S
from kiln.operators import textmetrics as T


def dp(s, t):
    if len(s) < len(t):
        s, t = t, s
    prev = list(range(len(t) + 1))
    for i, a in enumerate(s):
        cur = [i + 1]
        for j, b in enumerate(t):
            cur.append(min(prev[j + 1] + 1, cur[j] + 1, prev[j] + (a != b)))
        prev = cur
    return prev[-1]


def test_levenshtein_bits_matches_dp():
    rnd = random.Random(3)
    alpha = "ab cé\U00010000\t"
    for _ in range(500):
        a = "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 90)))
        b = "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 90)))
        assert levenshtein_bits(a, b) == dp(a, b)
    assert token_levenshtein("a b c".split(), "a x c d".split()) == 2


def _lines(spark, lines):
    return spark.createDataFrame([("log", i + 1, s) for i, s in enumerate(lines)], "log_id string, line_no long, line string")


def test_parse_metrics_reference_values(spark):
    lines = ["eval_loss: 1.234, eval_ppl: 3.435",
             "eval_loss: 0.5, eval_accuracy: 0.92, eval_bleu: 45.6, global_step: 100",
             "loss: nan",
             "some random line",
             "global_step: 10, loss: 2.5, learning_rate: 1e-4, throughput: 900.5 tokens/s",
             "grad_norm: 1.5e-3 epoch: 2 memory: 1024.5 MB"]
    r = {row.line_no: row for row in L.parse_metrics(_lines(spark, lines)).collect()}
    assert r[1].eval_loss == 1.234 and r[1].eval_ppl == 3.435
    assert r[2].eval_loss == 0.5 and r[2].step == 100 and dict(r[2].extra) == {"eval_accuracy": 0.92, "eval_bleu": 45.6}
    assert r[3].has_nan and r[3].loss is None
    assert 4 not in r
    assert r[5].step == 10 and r[5].loss == 2.5 and r[5].lr == 1e-4 and r[5].throughput == 900.5
    assert 6 not in r  # grad_norm / epoch / memory alone do not make a metric line


def test_error_precedence(spark):
    lines = ["CUDA out of memory loss nan", "FATAL: loss nan", "loss is nan", "NCCL timeout", "x ERROR y",
             "WARNING slow", "WARNING NCCL noise", "fine"]
    got = {r.line_no: (r.error_type, r.severity) for r in L.classify_errors(_lines(spark, lines)).collect()}
    assert got == {1: ("OOM", "fatal"), 2: ("FATAL", "fatal"), 3: ("NaN", "error"), 4: ("NCCL", "error"),
                   5: ("ERROR", "error"), 6: ("WARNING", "warning")}


def test_final_metrics_summary_loss(spark):
    lines = ["Total optimization steps = 1,000", "global_step: 10, loss: 2.50", "eval_loss: 1.10, global_step: 10",
             "global_step: 20, loss: 1.50", "train_loss: 0.75"]
    r = L.final_metrics(_lines(spark, lines)).collect()[0]
    assert r.max_steps == 1000 and r.final_step == 20 and r.final_loss == 0.75
    assert r.n_eval_losses == 1 and r.best_eval_loss == 1.1


def test_ocr_metric_examples(spark):
    pairs = spark.createDataFrame([("helo", "hello", "g1"), ("hello earth", "hello world", "g2"),
                                   ("abc", "abd", "g3")], "pred string, ref string, g string")
    m = {r.g: r for r in T.ocr_metrics(pairs, by=["g"]).collect()}
    assert m["g1"].cer == 0.2
    assert m["g2"].wer == 0.5
    assert m["g3"].ned == round(1 / 3, 6)
    assert m["g1"].exact_match == 0.0


def test_teds(spark):
    df = spark.createDataFrame([("<table><tr><td>a</td></tr></table>", "<table><tr><td>a</td><td>b</td></tr></table>"),
                                ("no tags", "no tags either")], "p string, r string")
    got = [row.t for row in df.select(T.teds("p", "r").alias("t")).collect()]
    assert got[0] == pytest.approx(1 - 2 / 8) and got[1] == 1.0


def test_efficiency_plan_example(spark):
    steps = [100, 200, 300, 400, 500]
    train = [2.0, 1.5, 1.0, 0.5, 0.3]
    ev = [2.1, 1.6, 1.1, 0.6, 0.4]
    h = spark.createDataFrame([("x", i, s, l) for i, (s, l) in enumerate(zip(steps, train))],
                              "experiment_id string, idx long, step long, train_loss double")
    e = spark.createDataFrame([("x", i, l) for i, l in enumerate(ev)], "experiment_id string, eidx long, eval_loss double")
    t = spark.createDataFrame([("x", 600.0)], "experiment_id string, total_time_seconds double")
    r = E.efficiency(h, e, t).collect()[0]
    assert r.training_time_per_step == 1.2
    assert r.best_step == 500
    assert r.loss_reduction_rate == round(1.7 / 401, 8)
    assert r.overfitting_gap == pytest.approx(-0.1)
    assert r.convergence_speed == 500


def test_importance_and_score(spark):
    loo = spark.createDataFrame([("ds1", 0.7), ("ds2", 1.1), ("ds3", 0.98)], "dataset string, score double")
    r = {x.dataset: x for x in E.dataset_importance(loo, 1.0).collect()}
    assert r["ds1"].verdict == "important" and r["ds1"].rank == 1
    assert r["ds2"].verdict == "noise" and r["ds3"].verdict == "neutral"
    res = spark.createDataFrame([(0.5, 100.0, True)], "eval_loss double, throughput double, has_nan boolean")
    s = E.composite_score(res, {"eval_loss": 1.0, "throughput": 100.0}).collect()[0].score
    assert s == pytest.approx(0.7 * 2 + 0.2 * 0.5 + 0.1 * 1.0)


def test_ratios(spark):
    ds = spark.createDataFrame([("a", 10), ("b", 30), ("c", 60)], "dataset string, n long")
    v = S.dataset_vector(ds)
    row = v.select(S.equal_ratios_col(F.size("names")).alias("e"), S.proportional_ratios_col(F.col("counts")).alias("p"),
                   S.leave_one_out_col(S.equal_ratios_col(F.size("names"))).alias("l")).collect()[0]
    base = 1 / 3
    assert row.e == [base, base, 1.0 - (base + base)]
    assert math.isclose(sum(row.p), 1.0) and row.p[0] == 0.1
    assert row.l[1].ratios[1] == 0.0 and math.isclose(sum(row.l[1].ratios), 1.0)
    assert S.ratio_sweep(3)[0][-1] == 1.0 - (0.33 + 0.33)


def test_split_sizes_and_determinism(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    s = S.split_exact(df, "k", 0.9, 0.05, seed=7)
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 900, "val": 50, "test": 51}
    a = sorted(r.k for r in s.where("split = 'val'").collect())
    b = sorted(r.k for r in S.split_exact(df, "k", 0.9, 0.05, seed=7).where("split = 'val'").collect())
    assert a == b


def test_progress_two_phases(spark):
    ev = spark.createDataFrame([(1, "r", 0, "completed"), (2, "r", 1, "completed"), (3, "r", 2, "failed")],
                               "id long, run_id string, phase int, status string")
    runs = spark.createDataFrame([("r",)], "run_id string")
    assert R.progress(ev, runs).collect()[0].progress_pct == 28.6


def test_checkpoint_retention(spark):
    rows = [("r", "e", f"/o/checkpoint-{s}", s, l) for s, l in [(100, 0.9), (200, 0.5), (300, 0.7), (400, 0.8)]]
    rows.append(("r", "e", "/o/checkpoint-bad", None, 0.1))
    c = spark.createDataFrame(rows, "run_id string, experiment_id string, path string, step long, loss double")
    drop = sorted(r.path for r in R.checkpoints_to_drop(c, ["run_id", "experiment_id"], 1, 1).collect())
    assert drop == ["/o/checkpoint-100", "/o/checkpoint-300"]


def test_factor_trend_lr_sweep(spark):
    vals = [1e-6, 3e-6, 5e-6, 1e-5, 3e-5, 5e-5]
    losses = [0.8435, 0.8242, 0.7737, 0.7343, 1.0112, 1.8296]
    ex = spark.createDataFrame([(f"e{i}", i, "lr", v, "completed", l, None) for i, (v, l) in enumerate(zip(vals, losses))],
                               "id string, seq long, factor string, value double, status string, final_loss double, eval_loss double")
    f = spark.createDataFrame([("lr", "log", False, 1e-7, 1e-3, 5, 1e-5)],
                              "factor string, scale string, discrete boolean, min_value double, max_value double, max_rounds int, default_value double")
    r = E.factor_trend(ex, f, round_number=0).collect()[0]
    xs = [math.log10(v) for v in vals]
    mx, my = sum(xs) / 6, sum(losses) / 6
    cov = sum((x - mx) * (y - my) for x, y in zip(xs, losses))
    corr = cov / (math.sqrt(sum((x - mx) ** 2 for x in xs)) * math.sqrt(sum((y - my) ** 2 for y in losses)))
    assert r.corr == pytest.approx(corr)
    assert r.best_value == 1e-5 and r.best_loss == 0.7343
    expect = "continue" if abs(corr) <= 0.7 and abs(corr) >= 0.3 else r.action
    assert r.action == expect
    if r.action == "continue":
        lo = (math.log10(5e-6) + math.log10(1e-5)) / 2
        hi = (math.log10(1e-5) + math.log10(3e-5)) / 2
        assert r.next_values == pytest.approx([10 ** lo, 1e-5, 10 ** hi])


def test_skeleton_long_log(spark):
    lines = [f"line {i}" for i in range(1, 300)]
    lines[150] = "loss: 1.5"
    df = _lines(spark, lines)
    out = [r.line for r in L.skeleton(df, max_lines=10).orderBy("seq").collect()]
    assert out[:5] == ["line 1", "line 2", "line 3", "line 4", "line 5"]
    assert "...[truncated]..." in out and len(out) == 11


def test_jvm_kernels_match_python(spark):
    from kiln.functions import jvm
    assert jvm.register(spark)
    rnd = random.Random(11)
    alpha = "ab cé\U00010000\t　x"
    rows = [("".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 400))),
             "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 400)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").selectExpr(
        "a", "b", "kiln_levenshtein(a, b) as d", "kiln_word_levenshtein(a, b) as w").collect()
    for r in got:
        assert r.d == levenshtein_bits(r.a, r.b) == (dp(r.a, r.b) if len(r.a) * len(r.b) < 20000 else r.d)
        assert r.w == token_levenshtein(r.a.split(), r.b.split())


def test_jvm_banded_kernel_on_similar_strings(spark):
    """The banded path (few edits, long strings, several 64-bit blocks) and
    the widening path (many edits) against the plain dynamic programme."""
    from kiln.functions import jvm
    assert jvm.register(spark)
    rnd = random.Random(23)
    alpha = "abcde é\U00010000"
    rows = []
    for _ in range(120):
        base = "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 600)))
        s = list(base)
        for _ in range(rnd.randint(0, max(1, len(s) // rnd.choice([4, 15, 60])))):
            op, i = rnd.random(), rnd.randint(0, max(0, len(s) - 1))
            if op < 0.33 and s:
                s.pop(i)
            elif op < 0.66:
                s.insert(i, rnd.choice(alpha))
            elif s:
                s[i] = rnd.choice(alpha)
        rows.append((base, "".join(s)))
    got = spark.createDataFrame(rows, "a string, b string").selectExpr("a", "b", "kiln_levenshtein(a, b) as d").collect()
    assert all(r.d == dp(r.a, r.b) for r in got)


def test_infer_schema_and_format_vote(spark):
    from kiln.operators import clean
    lines = spark.createDataFrame([
        (1, '{"a": "x", "b": [1, 2, 3], "c": {"k": 1}}'), (2, "not json"),
        (3, '{"a": 5, "d": 2.5, "e": [], "f": null, "g": true}'),
        (4, '{"messages": [{"role": "user", "content": "hi"}]}')], "pos long, line string")
    sch = {r.key: (r.type, r.example) for r in clean.infer_schema(lines, n=None).collect()}
    assert sch["a"] == ("str", "x") and sch["b"][0] == "list[int]" and sch["c"][0] == "dict"
    assert sch["d"][0] == "float" and sch["e"][0] == "list[any]" and sch["f"][0] == "NoneType" and sch["g"][0] == "bool"
    assert clean.detect_format(lines).collect()[0].format == "messages"


def test_csv_qa_and_truncation(spark):
    from kiln.operators import convert
    qa = spark.createDataFrame([(" q1 ", "a1", "img.png"), ("  ", "a2", None), ("q3", "", None)],
                               "question string, answer string, image_path string")
    out = convert.csv_qa_to_erniekit(qa).collect()
    assert len(out) == 1 and out[0].text_info[0].text == "q1" and out[0].image_info[0].image_url == "img.png"
    df = spark.createDataFrame([("x" * 30,)], "t string")
    r = df.select(T.truncate_tail("t", 5).alias("a"), T.truncate_head("t", 5).alias("b")).collect()[0]
    assert r.a == "x" * 15 + "\n...[truncated]" and r.b == "...[earlier content truncated]...\n" + "x" * 15


def test_traceback_and_stderr_tail(spark):
    tb = ["Traceback (most recent call last):", '  File "a.py", line 1, in main', "ValueError: outer",
          '  File "b.py", line 2, in f', '  File "c.py", line 3, in g', '  File "d.py", line 4, in h',
          "KeyError: 'x'", "RuntimeError: last"]
    df = _lines(spark, tb)
    r = L.traceback_summary(df).collect()[0]
    # walking back: the 3rd frame from the end is b.py; the earliest error line after it wins
    assert (r.error_type, r.message) == ("KeyError", "'x'")
    assert list(r.key_frames) == ["h (d.py:4)", "g (c.py:3)", "f (b.py:2)"] and r.file == "b.py" and r.line == "2"
    tail = [x.line for x in L.stderr_tail(df).orderBy("line_no").collect()]
    assert tail == tb  # from the last "Traceback" line, at most 15 lines
    plain = _lines(spark, [f"l{i}" for i in range(30)])
    assert [x.line for x in L.stderr_tail(plain).orderBy("line_no").collect()] == [f"l{i}" for i in range(20, 30)]


def test_diagnosis_and_status(spark):
    e = spark.createDataFrame([("CUDA out of memory, loss nan",), ("loss went NaN",), ("NCCL error",),
                               ("json.decoder.JSONDecodeError",), ("failed to load checkpoint",), ("fatal crash",)], "message string")
    got = [r.error_type for r in L.diagnose(e).collect()]
    assert got == ["oom", "nan", "nccl", "data_format", "checkpoint", "unknown"]
    t1 = [r.error_type for r in L.diagnose_tier1(e).collect()]
    assert t1 == ["oom", "nan", "nccl", "data_format", None, None]
    fin = spark.createDataFrame([("a", 95, 100), ("b", 80, 100), ("c", 5, 0), ("d", 0, 0)],
                                "log_id string, final_step long, max_steps long")
    ex = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 0)], "log_id string, exit_code int")
    st = {r.log_id: r.status for r in L.run_status(fin, ex).collect()}
    assert st == {"a": "completed", "b": "failed", "c": "completed", "d": "completed"}


def test_best_per_factor_falsy_loss(spark):
    ex = spark.createDataFrame([("e1", 1, "lr", 1.0, "completed", 0.9, 0.0), ("e2", 2, "lr", 2.0, "completed", 0.5, None),
                                ("e3", 3, "lr", 3.0, "completed", 0.7, 0.6), ("e4", 4, "lr", 4.0, "failed", 0.1, 0.1)],
                               "id string, seq long, factor string, value double, status string, final_loss double, eval_loss double")
    r = E.best_per_factor(ex).collect()[0]
    # e1: eval 0.0 falls through to final 0.9; e2: final 0.5 wins; e4 is not completed
    assert r.best_value == 2.0 and r.best_loss == 0.5


def test_mixture_upsamples_and_saturation_nests(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 100 + i) for i in range(20)], "ds string, k long")
    ratios = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "ds string, ratio double")
    m = S.mix_by_ratio(df, "k", "ds", ratios, total=10, seed=1)
    c = {r.ds: r["count"] for r in m.groupBy("ds").count().collect()}
    assert c == {"a": 7, "b": 3}  # a has 3 rows: copies 0..2, quota 7 = 3 + 3 + 1
    a_keys = [r.k for r in m.where("ds = 'a'").collect()]
    assert sorted(set(a_keys)) == [0, 1, 2] and max(a_keys.count(k) for k in range(3)) == 3
    sat = S.saturation(spark.range(100).withColumnRenamed("id", "k"), "k", seed=5)
    sets = {f: {r.k for r in sat.where(F.col("fraction") == f).collect()} for f in (0.25, 0.5, 0.75, 1.0)}
    assert [len(sets[f]) for f in (0.25, 0.5, 0.75, 1.0)] == [25, 50, 75, 100]
    assert sets[0.25] <= sets[0.5] <= sets[0.75] <= sets[1.0]
