"""Experiment analytics (E01-E30): efficiency of a training history,
rankings, best values per factor, trend verdicts, next values, plans, scores
and chart data.

Tables
* history: ``(experiment_id, idx, step, train_loss)`` with ``idx`` 0..n-1,
  and eval points ``(experiment_id, eidx, eval_loss)`` with ``eidx`` 0..m-1.
* experiments: ``id, seq, factor, value, status, final_loss, eval_loss``.

Everything per experiment or per factor is a ``groupBy`` with partial
aggregation (``min_by``/``max_by``/sums); scalars (baselines, means) attach
as scalar subqueries; ranks use ``ordered_rank`` (no single-task window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.ranking import ordered_rank

# ------------------------------------------------------------ E01 - E07


def _stride(n: Column, m: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / m)).cast("bigint")


def efficiency(hist: DataFrame, evals: DataFrame, times: DataFrame | None = None,
               exp: str = "experiment_id") -> DataFrame:
    """E01-E06 per experiment: best_step, loss_reduction_rate (8 dp),
    overfitting_gap (6 dp), training_time_per_step (4 dp), convergence_speed.

    best_step: first minimum eval loss, mapped to the train step at index
    eidx * max(1, n div m); the train loss decides when there are no evals.
    convergence: first step whose loss crosses 90% of the first-to-last
    change (the last step if none does); 0 when n = 1 or first = last."""
    h = hist.groupBy(exp).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("train_loss", "idx").alias("first_loss"), F.max_by("train_loss", "idx").alias("last_loss"),
        F.min_by("step", "idx").alias("first_step"), F.max_by("step", "idx").alias("last_step"),
        F.min_by("step", F.struct("train_loss", "idx")).alias("best_train_step"))
    e = evals.groupBy(exp).agg(F.count(F.lit(1)).alias("m"),
                               F.min_by("eidx", F.struct("eval_loss", "eidx")).alias("best_eidx"),
                               F.max_by("eval_loss", "eidx").alias("last_eval"))
    s = h.join(e, exp, "left").withColumn("m", F.coalesce("m", F.lit(0)))
    # eval index -> aligned train index; the step there (a join on exact index)
    s = s.withColumn("_bi", F.when((F.col("m") > 0) & (F.col("n") >= F.col("m")),
                                   F.col("best_eidx") * _stride(F.col("n"), F.col("m")))
                              .when(F.col("m") > 0, F.col("best_eidx")))
    at = hist.select(exp, F.col("idx").alias("_bi"), F.col("step").alias("_best_eval_step"))
    s = s.join(at, [exp, "_bi"], "left")
    # convergence: target from first/last, then the first crossing
    tgt = s.select(exp, "first_loss", "last_loss", "n",
                   (F.col("first_loss") - F.lit(0.9) * (F.col("first_loss") - F.col("last_loss"))).alias("_t"))
    dec = F.col("first_loss") > F.col("last_loss")
    cross = hist.join(tgt, exp).where(F.when(dec, F.col("train_loss") <= F.col("_t"))
                                       .otherwise(F.col("train_loss") >= F.col("_t")))
    conv = cross.groupBy(exp).agg(F.min_by("step", "idx").alias("_conv_step"))
    s = s.join(conv, exp, "left")
    if times is not None:
        s = s.join(times, exp, "left")
    else:
        s = s.withColumn("total_time_seconds", F.lit(0.0))
    span = F.when(F.col("n") > 1, F.col("last_step") - F.col("first_step") + 1).otherwise(F.lit(1))
    conv_speed = (F.when((F.col("n") > 1) & (F.col("first_loss") != F.col("last_loss")),
                         F.coalesce(F.col("_conv_step"), F.col("last_step")))
                   .otherwise(F.lit(0)))
    return s.select(
        exp,
        F.when(F.col("m") > 0, F.col("_best_eval_step")).otherwise(F.col("best_train_step")).alias("best_step"),
        F.bround((F.col("first_loss") - F.col("last_loss")) / span, 8).alias("loss_reduction_rate"),
        F.bround(F.when(F.col("m") > 0, F.col("last_loss") - F.col("last_eval")).otherwise(F.lit(0.0)), 6)
         .alias("overfitting_gap"),
        F.bround(F.when(F.col("last_step") > 0, F.col("total_time_seconds") / F.col("last_step"))
                  .otherwise(F.lit(0.0)), 4).alias("training_time_per_step"),
        conv_speed.cast("bigint").alias("convergence_speed"))


def overfit_regions(hist: DataFrame, evals: DataFrame, exp: str = "experiment_id") -> DataFrame:
    """Eval points whose aligned train loss (index min(i*stride, n-1))
    is below the eval loss, with the step interval from the previous eval
    point. Needs n >= m, as the chart does."""
    nm = (hist.groupBy(exp).agg(F.count(F.lit(1)).alias("n"))
              .join(evals.groupBy(exp).agg(F.count(F.lit(1)).alias("m")), exp)
              .where(F.col("n") >= F.col("m")))
    e = evals.join(nm, exp).withColumn("_st", _stride(F.col("n"), F.col("m")))
    e = e.withColumn("_ti", F.least(F.col("eidx") * F.col("_st"), F.col("n") - 1)) \
         .withColumn("_si", F.col("eidx") * F.col("_st")) \
         .withColumn("_pi", F.greatest(F.col("eidx") - 1, F.lit(0)) * F.col("_st"))
    t = hist.select(exp, F.col("idx").alias("_ti"), F.col("train_loss").alias("aligned_train"))
    s1 = hist.select(exp, F.col("idx").alias("_si"), F.col("step").alias("end_step"))
    s0 = hist.select(exp, F.col("idx").alias("_pi"), F.col("step").alias("start_step"))
    j = e.join(t, [exp, "_ti"]).join(s1, [exp, "_si"]).join(s0, [exp, "_pi"])
    return j.where(F.col("aligned_train") < F.col("eval_loss")).select(
        exp, "eidx", "start_step", "end_step", "aligned_train", "eval_loss")


# ------------------------------------------------------------ E08 - E12

def _falsy_loss(c: str) -> Column:
    """``x or ...``: null and 0.0 both fall through (NaN is truthy)."""
    return F.when(F.col(c) != 0, F.col(c))


def rank_experiments(exps: DataFrame, seq: str = "seq") -> DataFrame:
    """best_loss = eval_loss, else final_loss (null test); rows with
    neither dropped; ranked by best_loss, ties in input order."""
    x = exps.withColumn("best_loss", F.coalesce("eval_loss", "final_loss")).where(F.col("best_loss").isNotNull())
    return ordered_rank(x, "best_loss", [seq])


def compare_experiments(results: DataFrame, seq: str = "seq") -> DataFrame:
    """Ranking by eval_loss (missing = +inf) with best/worst flags."""
    x = results.withColumn("loss", F.coalesce(F.col("eval_loss"), F.lit(float("inf"))))
    r = ordered_rank(x, "loss", [seq], count_col="_n")
    return r.withColumn("is_best", F.col("rank") == 1).withColumn("is_worst", F.col("rank") == F.col("_n")).drop("_n")


def best_per_factor(exps: DataFrame, factor: str = "factor", value: str = "value", seq: str = "seq") -> DataFrame:
    """Per factor the value of the completed experiment with the lowest
    ``eval_loss or final_loss or inf`` (0.0 falls through); ties keep the
    first in ``seq`` order."""
    loss = F.coalesce(_falsy_loss("eval_loss"), _falsy_loss("final_loss"), F.lit(float("inf")))
    c = exps.where(F.col("status") == "completed").withColumn("_loss", loss)
    return c.groupBy(factor).agg(F.min_by(F.col(value), F.struct("_loss", seq)).alias("best_value"),
                                 F.min("_loss").alias("best_loss"))


def best_combo(exps: DataFrame, diff: str = "config_diff", seq: str = "seq") -> DataFrame:
    """Like E10 over every key of a ``config_diff`` map."""
    x = exps.select("*", F.explode(diff).alias("factor", "value"))
    return best_per_factor(x, "factor", "value", seq)


def best_ratio(exps: DataFrame, seq: str = "seq") -> DataFrame:
    """The completed experiment with the lowest loss (falsy fall-through)."""
    loss = F.coalesce(_falsy_loss("eval_loss"), _falsy_loss("final_loss"), F.lit(float("inf")))
    c = exps.where(F.col("status") == "completed").withColumn("_loss", loss)
    return c.agg(F.min_by("id", F.struct("_loss", seq)).alias("id"), F.min("_loss").alias("loss"))


# ------------------------------------------------------------ E13 - E17

def _x_of(value: Column, scale: Column) -> Column:
    return F.when(scale == "log", F.log10(F.greatest(value, F.lit(1e-12)))).otherwise(value)


def _moments(x: str, y: str) -> list[Column]:
    """``_cov``, ``_sx``, ``_sy``: centred sums of products and root sums of squares."""
    n = F.count(F.lit(1)).cast("double")
    return [(F.covar_pop(x, y) * n).alias("_cov"), (F.stddev_pop(x) * F.sqrt(n)).alias("_sx"),
            (F.stddev_pop(y) * F.sqrt(n)).alias("_sy")]


def factor_corr(valid: DataFrame, factor: str = "factor", value: str = "value", loss: str = "final_loss",
                scale: Column | None = None) -> DataFrame:
    """Pearson correlation per factor of x (log10 when scale is log,
    floored at 1e-12) and loss; 0 when n < 2 or a spread is below 1e-12.
    One aggregation: covariance and deviations merge from partial moments, so
    no row is joined back to its factor."""
    sc = scale if scale is not None else F.lit("linear")
    x = valid.withColumn("_x", _x_of(F.col(value).cast("double"), sc)).withColumn("_y", F.col(loss))
    s = x.groupBy(factor).agg(F.count(F.lit(1)).alias("n"), *_moments("_x", "_y"))
    corr = (F.when((F.col("n") < 2) | (F.col("_sx") < 1e-12) | (F.col("_sy") < 1e-12), F.lit(0.0))
             .otherwise(F.col("_cov") / (F.col("_sx") * F.col("_sy"))))
    return s.select(factor, "n", corr.alias("corr"))


def _clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, v))


def _finish(vals: Column, lo: Column, hi: Column, discrete: Column) -> Column:
    """Clamp, round half-even when discrete, de-duplicate on 10 decimals,
    sort ascending."""
    c = F.transform(vals, lambda v: _clamp(v, lo, hi))
    c = F.transform(c, lambda v: F.when(discrete, F.bround(v, 0)).otherwise(v))
    dedup = F.filter(c, lambda v, i: ~F.exists(F.slice(c, 1, i), lambda u: F.bround(u, 10) == F.bround(v, 10)))
    return F.array_sort(dedup)


def narrow_values(best: Column, left: Column, right: Column, scale: Column, lo: Column, hi: Column,
                  discrete: Column) -> Column:
    """[mid(left, best), best, mid(best, right)], midpoints in log10
    space for log scale (a non-positive left is replaced by the minimum)."""
    lg = lambda v: F.log10(F.greatest(v, F.lit(1e-12)))
    left_l = F.when(left <= 0, lo).otherwise(left)
    logv = F.array(F.pow(F.lit(10.0), (lg(left_l) + lg(best)) / 2), F.pow(F.lit(10.0), lg(best)),
                   F.pow(F.lit(10.0), (lg(best) + lg(right)) / 2))
    linv = F.array((left + best) / 2, best, (best + right) / 2)
    return _finish(F.when(scale == "log", logv).otherwise(linv), lo, hi, discrete)


def expand_values(vmin: Column, vmax: Column, scale: Column, lo: Column, hi: Column, discrete: Column,
                  direction: str = "up") -> Column:
    """Three values 25/50/75% into the extension beyond the tested
    range (x3 in log space, one span in linear space); empty at the boundary."""
    lg = lambda v: F.log10(F.greatest(v, F.lit(1e-12)))
    fr = [0.25, 0.5, 0.75]
    if direction == "up":
        new = F.when(scale == "log", F.least(F.pow(F.lit(10.0), lg(vmax) + 0.5), hi)) \
               .otherwise(F.least(vmax + (vmax - vmin), hi))
        logv = F.array(*[F.pow(F.lit(10.0), lg(vmax) + (lg(new) - lg(vmax)) * f) for f in fr])
        linv = F.array(*[vmax + (new - vmax) * f for f in fr])
        empty = new <= vmax
    else:
        new = F.when(scale == "log", F.greatest(F.pow(F.lit(10.0), lg(vmin) - 0.5), lo)) \
               .otherwise(F.greatest(vmin - (vmax - vmin), lo))
        logv = F.array(*[F.pow(F.lit(10.0), lg(new) + (lg(vmin) - lg(new)) * f) for f in fr])
        linv = F.array(*[new + (vmin - new) * f for f in fr])
        empty = new >= vmin
    return F.when(empty, F.array().cast("array<double>")).otherwise(
        _finish(F.when(scale == "log", logv).otherwise(linv), lo, hi, discrete))


#: Accuracy of the sketch that finds the middle of a factor's experiments: ranks are off by 1 / MIDDLE of them at most.
MIDDLE = 10_000


def factor_trend(exps: DataFrame, factors: DataFrame, round_number: int, factor: str = "factor",
                 value: str = "value", seq: str = "seq") -> DataFrame:
    """The next step for each factor.

    ``factors``: ``factor, scale, discrete, min_value, max_value,
    max_rounds, default_value``. Valid experiments are completed with a
    finite final_loss, in ``seq`` order. Verdicts in order: no valid ->
    default; one valid; round cap; converged (round >= 1, n >= 4, best of the
    second half within 5% of the first half's); |corr| < .3 plateau; corr >
    .7 rising; corr < -.7 expand upward; else narrow around the best.

    The halves are exact without ranking all experiments: a sketch bounds the
    middle, best losses outside those bounds are plain minima, and only the
    rows between them are written in order and ranked (``seq`` is a number,
    distinct per factor)."""
    v = exps.where((F.col("status") == "completed") & F.col("final_loss").isNotNull()
                   & ~F.isnan("final_loss") & (F.abs(F.col("final_loss")) != float("inf")))
    # the factor configuration is one row per factor: a bounded broadcast
    v = v.join(F.broadcast(factors.select(factor, "scale")), factor) \
         .withColumn("_x", _x_of(F.col(value).cast("double"), F.col("scale"))).withColumn("_y", F.col("final_loss"))
    # pass 1: per-factor best, range and moments, and a narrow stretch of seq around the middle
    agg = v.groupBy(factor).agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.min_by(F.col(value).cast("double"), F.struct("final_loss", seq)).alias("best_value"),
        F.min("final_loss").alias("best_loss"),
        F.min(F.col(value).cast("double")).alias("vmin"), F.max(F.col(value).cast("double")).alias("vmax"),
        F.percentile_approx(seq, [0.5 - 2 / MIDDLE, 0.5 + 2 / MIDDLE], MIDDLE).alias("_mid"), *_moments("_x", "_y"))
    # pass 2: the best value's neighbours in sorted order, and the best losses before and after that stretch; one row
    # per configured factor is broadcast, as above
    known = F.broadcast(agg.select(factor, "best_value", "n_valid", F.col("_mid")[0].alias("_lo"), F.col("_mid")[1].alias("_hi")))
    d = v.join(known, factor)
    s2 = d.groupBy(factor).agg(
        F.max(F.when(F.col(value) < F.col("best_value"), F.col(value))).alias("_left"),
        F.min(F.when(F.col(value) > F.col("best_value"), F.col(value))).alias("_right"),
        F.count_if(F.col(value) == F.col("best_value")).alias("_dups"),
        F.min(F.when(F.col(seq) < F.col("_lo"), F.col("final_loss"))).alias("_before"),
        F.min(F.when(F.col(seq) > F.col("_hi"), F.col("final_loss"))).alias("_after"),
        F.count_if(F.col(seq) < F.col("_lo")).alias("_n_before"))
    # the stretch alone, 4 / MIDDLE of the rows, is ranked
    mid = ordered_rank(d.where(F.col(seq).between(F.col("_lo"), F.col("_hi"))).select(factor, seq, "final_loss", "n_valid"), seq, by=[factor])
    in_first = F.col("rank") + F.col("_n_before") <= F.floor(F.col("n_valid") / 2)
    parts = mid.join(F.broadcast(s2.select(factor, "_n_before")), factor).groupBy(factor).agg(
        F.min(F.when(in_first, F.col("final_loss"))).alias("_mid_first"),
        F.min(F.when(~in_first, F.col("final_loss"))).alias("_mid_second"))
    s2 = s2.join(parts, factor).withColumns({"first_half_best": F.least("_before", "_mid_first"),
                                             "second_half_best": F.least("_after", "_mid_second")})
    corr = s2.join(agg.select(factor, "n_valid", "_cov", "_sx", "_sy"), factor).select(
        factor, "_left", "_right", "_dups", "first_half_best", "second_half_best",
        F.when((F.col("n_valid") < 2) | (F.col("_sx") < 1e-12) | (F.col("_sy") < 1e-12), F.lit(0.0))
         .otherwise(F.col("_cov") / (F.col("_sx") * F.col("_sy"))).alias("corr"))
    nb = corr
    j = factors.join(agg.drop("_cov", "_sx", "_sy", "_mid"), factor, "left").join(nb, factor, "left")
    lo, hi, disc, sc = F.col("min_value"), F.col("max_value"), F.col("discrete"), F.col("scale")
    left = F.coalesce(F.col("_left"), lo)
    right = F.when(F.col("_dups") >= 2, F.col("best_value")).otherwise(F.coalesce(F.col("_right"), hi))
    narrow = narrow_values(F.col("best_value"), left, right, sc, lo, hi, disc)
    expand = expand_values(F.col("vmin"), F.col("vmax"), sc, lo, hi, disc, "up")
    n = F.coalesce(F.col("n_valid"), F.lit(0))
    rnd = F.lit(round_number)
    converged = ((rnd >= 1) & (n >= 4) & (F.col("first_half_best") > 0)
                 & ((F.col("first_half_best") - F.col("second_half_best")) / F.col("first_half_best") < 0.05))
    reason = (F.when(n == 0, "no_valid").when(n < 2, "single").when(rnd >= F.col("max_rounds") - 1, "round_cap")
               .when(converged, "converged").when(F.abs("corr") < 0.3, "plateau").when(F.col("corr") > 0.7, "rising")
               .when(F.col("corr") < -0.7, F.when(F.size(expand) == 0, "boundary").otherwise("expand"))
               .otherwise(F.when(F.size(narrow) == 0, "cannot_narrow").otherwise("narrow")))
    action = F.when(reason == "expand", "expand").when(reason == "narrow", "continue").otherwise("done")
    nxt = F.when(reason == "expand", expand).when(reason == "narrow", narrow).otherwise(F.array().cast("array<double>"))
    return j.select(factor, action.alias("action"), reason.alias("reason"),
                    F.when(n == 0, F.col("default_value")).otherwise(F.col("best_value")).alias("best_value"),
                    F.when(n == 0, F.lit(float("inf"))).otherwise(F.col("best_loss")).alias("best_loss"),
                    F.when(n >= 2, F.coalesce(F.col("corr"), F.lit(0.0))).alias("corr"),
                    nxt.alias("next_values"))


# ------------------------------------------------------------ E18 - E22

def ablation_plan(factors: DataFrame, factor: str = "factor", values: str = "values",
                  order: str = "factor_order") -> DataFrame:
    """One experiment per (factor, value), numbered abl-001.. in factor
    then value order. The plan is as large as its config (factors x values)."""
    x = factors.select(order, factor, F.posexplode(values).alias("vpos", "value"))
    w = Window.orderBy(order, "vpos")  # config-sized: factors x listed values
    return x.withColumn("n", F.row_number().over(w)).select(
        F.format_string("abl-%03d", F.col("n")).alias("id"), factor, "value")


def factor_grid(factors: DataFrame, factor: str = "factor", values: str = "values",
                order: str = "factor_order") -> DataFrame:
    """Every combination of factor values (the product of the value
    lists), one row per combination with a ``config`` map. Built by exploding
    one factor at a time from a single config row, not by joins."""
    spec = factors.agg(F.array_sort(F.collect_list(F.struct(order, factor, values))).alias("_f"))
    out = spec.select(F.col("_f"), F.array().cast("array<struct<k:string,v:double>>").alias("_c"),
                      F.lit(0).alias("_i"))
    n = factors.count()
    for i in range(n):
        out = out.select("_f", F.explode(F.element_at("_f", i + 1)[values]).alias("_v"), "_c") \
                 .select("_f", F.concat("_c", F.array(F.struct(F.element_at("_f", i + 1)[factor].alias("k"),
                                                                F.col("_v").cast("double").alias("v")))).alias("_c"))
    return out.select(F.map_from_entries("_c").alias("config"))


def untested_factors(all_factors: DataFrame, exps: DataFrame, diff: str = "config_diff",
                     factor: str = "factor") -> DataFrame:
    """Factors (last dotted part) not in any experiment's config diff:
    a left anti join."""
    tested = exps.select(F.explode(F.map_keys(diff)).alias("_k")).select(
        F.element_at(F.split("_k", r"\."), -1).alias(factor)).distinct()
    return all_factors.join(tested, factor, "left_anti")


# The weights of the composite score.
W_LOSS, W_STABILITY, W_SPEED = 0.7, 0.2, 0.1


def composite_score(results: DataFrame, baseline: dict) -> DataFrame:
    """0.7 * baseline_loss / loss (loss <= 0 -> 1e-8, missing -> inf)
    + 0.2 * stability (0.5 with NaN) + 0.1 * throughput / baseline throughput
    (1.0 when the baseline's is not positive). ``baseline`` holds eval_loss
    and throughput (defaults 1.0 and 1)."""
    b_loss = float(baseline.get("eval_loss", 1.0))
    b_speed = float(baseline.get("throughput", 1))
    loss = F.coalesce(F.col("eval_loss"), F.lit(float("inf")))
    loss = F.when(loss <= 0, F.lit(1e-8)).otherwise(loss)
    speed = F.coalesce(F.col("throughput"), F.lit(0.0))
    speed_score = (speed / F.lit(b_speed)) if b_speed > 0 else F.lit(1.0)
    stab = F.when(F.coalesce(F.col("has_nan"), F.lit(False)), 0.5).otherwise(1.0)
    return results.withColumn("score", W_LOSS * (F.lit(b_loss) / loss) + W_STABILITY * stab + W_SPEED * speed_score)


def dataset_importance(loo: DataFrame, baseline_score: float | Column, name: str = "dataset") -> DataFrame:
    """delta = baseline - leave-one-out score; > .05 important, > -.05
    neutral, else noise; ranked by delta descending (ties in name order)."""
    b = baseline_score if isinstance(baseline_score, Column) else F.lit(float(baseline_score))
    x = loo.withColumn("delta", b - F.col("score"))
    x = x.withColumn("verdict", F.when(F.col("delta") > 0.05, "important")
                               .when(F.col("delta") > -0.05, "neutral").otherwise("noise"))
    return ordered_rank(x, "delta", [name], desc=True)


# ------------------------------------------------------------ E24 - E30

# Radar axes (label, metric path, inverted).
RADAR_AXES = [("NED", "text_recognition.ned", True), ("CER", "text_recognition.cer", True),
              ("WER", "text_recognition.wer", True), ("Exact Match", "text_recognition.exact_match", False),
              ("TEDS", "table_recognition.teds", False), ("Layout mAP", "layout_analysis.map", False)]


def radar(metrics_long: DataFrame, exp: str = "experiment_id") -> DataFrame:
    """E24 on long metrics ``(experiment_id, key, value)``: error rates
    become max(0, 1 - x); others pass; keys outside the axes are dropped."""
    m = F.create_map(*[x for lbl, path, _ in RADAR_AXES for x in (F.lit(path), F.lit(lbl))])
    inv = [p for _, p, i in RADAR_AXES if i]
    x = metrics_long.withColumn("label", m[F.col("key")]).where(F.col("label").isNotNull())
    return x.select(exp, "label", F.when(F.col("key").isin(*inv), F.greatest(F.lit(0.0), 1 - F.col("value")))
                    .otherwise(F.col("value")).alias("value"))


def heatmap(metrics_long: DataFrame, keys: list[str], exp: str = "experiment_id") -> DataFrame:
    """E25/E26 in long form: every (metric in ``keys``, experiment) cell,
    missing = 0.0, and ``outlier`` = |v - mean| > population std of all cells.
    Cells come from exploding the key list per experiment (no join of
    experiments with metrics); mean and std are scalar subqueries."""
    exps = metrics_long.select(exp).distinct()
    cells = exps.select(exp, F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    vals = metrics_long.where(F.col("key").isin(*keys)).groupBy(exp, "key").agg(F.max("value").alias("value"))
    grid = cells.join(vals, [exp, "key"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    mean = grid.select(F.avg("value")).scalar()
    std = grid.select(F.stddev_pop("value")).scalar()
    return grid.withColumn("outlier", F.abs(F.col("value") - mean) > std)


def bars(metrics_long: DataFrame, exp: str = "experiment_id", best: str = "max") -> DataFrame:
    """Per metric key the bar values with the best flagged (max, or
    min for losses). The per-key extreme is an aggregate joined back."""
    ext = F.max("value") if best == "max" else F.min("value")
    e = metrics_long.groupBy("key").agg(ext.alias("_best"))
    return metrics_long.join(e, "key").withColumn("is_best", F.col("value") == F.col("_best")).drop("_best")


def loss_bars(exps: DataFrame, loss: str = "final_loss") -> DataFrame:
    """One bar per experiment, the lowest loss flagged (the minimum is a
    scalar subquery)."""
    best = exps.select(F.min(loss)).scalar()
    return exps.withColumn("is_best", F.col(loss) == best)


def available_metrics(metrics_long: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that at least one experiment has (non-null)."""
    return (metrics_long.where(F.col("key").isin(*keys) & F.col("value").isNotNull())
                        .select("key").distinct())


def flatten_metrics(df: DataFrame, col: str, exp: str = "experiment_id") -> DataFrame:
    """Numeric leaves of a nested struct column as dotted keys, long
    form ``(experiment_id, key, value)``. The struct is walked at plan time
    (its schema), the rows are unpivoted with ``stack``-like explode."""
    from pyspark.sql.types import NumericType, StructType

    leaves: list[tuple[str, Column]] = []

    def walk(dt, path, c):
        if isinstance(dt, StructType):
            for f in dt.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, c[f.name])
        elif isinstance(dt, NumericType):
            leaves.append((path, c.cast("double")))

    walk(df.schema[col].dataType, "", F.col(col))
    kv = F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in leaves])
    return df.select(exp, F.explode(kv).alias("kv")).select(exp, "kv.key", "kv.value").where(F.col("value").isNotNull())
