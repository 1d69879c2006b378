"""The reference's own unit-test cases, run against the Spark operators."""

import math

from pyspark.sql import functions as F

from kiln.operators import experiments as E
from kiln.operators import logs as L
from kiln.operators import sampling as S


def _one(spark, line):
    rows = L.parse_metrics(spark.createDataFrame([("l", 1, line)], "log_id string, line_no long, line string")).collect()
    return rows[0] if rows else None


def test_parse_cases(spark):
    m = _one(spark, "eval_loss: 1.234, eval_ppl: 3.435")
    assert m.eval_loss == 1.234 and m.eval_ppl == 3.435
    m = _one(spark, "eval_loss: 0.5, eval_accuracy: 0.92, eval_bleu: 45.6, global_step: 100")
    assert dict(m.extra) == {"eval_accuracy": 0.92, "eval_bleu": 45.6}
    assert _one(spark, "some random log line") is None
    assert _one(spark, "global_step: 50, loss: nan").has_nan
    assert _one(spark, "global_step: 50, loss: inf").has_nan
    assert _one(spark, "loss: nan").has_nan


def _vec(spark, col):
    return spark.range(1).select(col.alias("r")).collect()[0].r


def test_ratio_cases(spark):
    eq = _vec(spark, S.equal_ratios_col(F.lit(3)))
    assert len(eq) == 3 and abs(sum(eq) - 1.0) < 0.001
    prop = _vec(spark, S.proportional_ratios_col(F.array(F.lit(10000), F.lit(5000), F.lit(1000)).cast("array<bigint>")))
    assert abs(sum(prop) - 1.0) < 0.001 and prop[0] > prop[1] > prop[2]
    loo = _vec(spark, S.leave_one_out_col(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))))
    assert len(loo) == 3 and loo[0].excluded_idx == 0 and loo[0].ratios[0] == 0.0
    assert abs(sum(loo[0].ratios) - 1.0) < 0.001
    for top in (2, 3):
        sweep = S.ratio_sweep(top)
        assert len(sweep) >= 5 and all(len(c) == top and abs(sum(c) - 1.0) < 0.001 for c in sweep)
    assert S.SATURATION == [0.25, 0.50, 0.75, 1.00]


def test_score_cases(spark):
    res = spark.createDataFrame([(0.5, 1200.0, False), (0.5, 1200.0, True)], "eval_loss double, throughput double, has_nan boolean")
    s = [r.score for r in E.composite_score(res, {"eval_loss": 1.0, "throughput": 1000}).collect()]
    assert s[0] > 1.0 and s[1] < s[0]


def test_importance_cases(spark):
    loo = spark.createDataFrame([("ds1", 0.7), ("ds2", 0.95), ("ds3", 1.05)], "dataset string, score double")
    r = sorted(E.dataset_importance(loo, 1.0).collect(), key=lambda x: x["rank"])
    assert r[0].dataset == "ds1" and r[0].verdict == "important" and r[-1].dataset == "ds3"
    loo2 = spark.createDataFrame([("ds1", 0.5), ("ds2", 1.1)], "dataset string, score double")
    v = {x.dataset: x.verdict for x in E.dataset_importance(loo2, 1.0).collect()}
    assert v["ds2"] == "noise"
    assert math.isclose(1.0 - 0.95, 0.05)


def test_queue_and_phase_cleanup_cases(spark):
    from kiln.operators import runs as R
    exps = spark.createDataFrame([("e1", "r", 1, "ablation_hyper", "completed"), ("e2", "r", 2, "ablation_hyper", "completed"),
                                  ("e3", "r", 3, "ablation_ratio", "pending"), ("e4", "r", 4, "ablation_ratio", "pending")],
                                 "id string, run_id string, seq long, phase string, status string")
    q = {r.phase: r for r in R.queue_status(exps).collect()}
    assert q[None].total == 4 and q[None].completed == 2 and q[None].pending == 2
    assert q["ablation_hyper"].completed == 2 and q["ablation_ratio"].total == 2
    assert R.next_pending(exps).collect()[0].id == "e3"
    ck = spark.createDataFrame([("r", "e1", "/c/e1/checkpoint-500", 500, 0.1), ("r", "e3", "/c/e3/checkpoint-500", 500, 0.2)],
                               "run_id string, experiment_id string, path string, step long, loss double")
    drop = [r.experiment_id for r in R.phase_checkpoints_to_drop(ck, exps, phase="ablation_hyper").collect()]
    assert drop == ["e1"]
    assert R.phase_checkpoints_to_drop(ck, exps.withColumn("status", F.lit("failed"))).count() == 0
