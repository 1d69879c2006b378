"""Experiment-analytics queries over tables derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import experiments as E
from kiln.operators import logs as L
from kiln.plans.catalog import query
from kiln.plans.logs import _PARSE
from kiln.plans.views import table, v_experiments, v_log

# ------------------------------------------------------------ histories


def _histories(spark, sf):
    """Per log: train history (step rows, missing loss 0.0) and eval points
    (rows with an eval loss), each numbered from 0 in line order; run time
    = span of the user's event timestamps."""
    from kiln.functions.ranking import ordered_rank
    m = L.parse_metrics(v_log(spark, sf))
    hist = (ordered_rank(m.where(F.col("step").isNotNull()), "line_no", by=["log_id"], rank_col="_r")
            .select(F.col("log_id").alias("experiment_id"), (F.col("_r") - 1).alias("idx"), "step",
                    F.coalesce("loss", F.lit(0.0)).alias("train_loss")))
    ev = (ordered_rank(m.where(F.col("eval_loss").isNotNull()), "line_no", by=["log_id"], rank_col="_r")
          .select(F.col("log_id").alias("experiment_id"), (F.col("_r") - 1).alias("eidx"), "eval_loss"))
    e = table(spark, sf, "events")
    times = e.groupBy(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("experiment_id")).agg(
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).cast("double")
        .__truediv__(1e6).alias("total_time_seconds"))
    return hist, ev, times


_HIST_SQL = f"""with {_PARSE},
hist as (select log_id as experiment_id, row_number() over (partition by log_id order by line_no) - 1 as idx, step,
                coalesce(loss, 0.0) as train_loss from parsed where step is not null),
ev as (select log_id as experiment_id, row_number() over (partition by log_id order by line_no) - 1 as eidx, eval_loss
       from parsed where eval_loss is not null),
times as (select concat('run-', cast(user_id as varchar)) as experiment_id,
                 (epoch_us(max(ts)) - epoch_us(min(ts)))::double / 1e6 as total_time_seconds from events group by user_id)"""


@query("E06_efficiency", _HIST_SQL + """,
h as (select experiment_id, count(*) as n, arg_min(train_loss, idx) as first_loss, arg_max(train_loss, idx) as last_loss,
             arg_min(step, idx) as first_step, arg_max(step, idx) as last_step,
             arg_min(step, {'l': train_loss, 'i': idx}) as best_train_step from hist group by experiment_id),
e as (select experiment_id, count(*) as m, arg_min(eidx, {'l': eval_loss, 'i': eidx}) as best_eidx,
             arg_max(eval_loss, eidx) as last_eval from ev group by experiment_id),
s as (select h.*, coalesce(e.m, 0) as m, e.best_eidx, e.last_eval,
             case when coalesce(e.m, 0) > 0 and h.n >= e.m then e.best_eidx * greatest(1, h.n // e.m)
                  when coalesce(e.m, 0) > 0 then e.best_eidx end as bi from h left join e using (experiment_id)),
s2 as (select s.*, hh.step as best_eval_step, (s.first_loss - 0.9 * (s.first_loss - s.last_loss)) as t
       from s left join hist hh on hh.experiment_id = s.experiment_id and hh.idx = s.bi),
cv as (select s2.experiment_id, arg_min(hist.step, hist.idx) as conv_step from s2 join hist using (experiment_id)
       where case when s2.first_loss > s2.last_loss then hist.train_loss <= s2.t else hist.train_loss >= s2.t end
       group by s2.experiment_id)
select s2.experiment_id,
  case when m > 0 then best_eval_step else best_train_step end as best_step,
  round_even((first_loss - last_loss) / (case when n > 1 then last_step - first_step + 1 else 1 end), 8) as loss_reduction_rate,
  round_even(case when m > 0 then last_loss - last_eval else 0.0 end, 6) as overfitting_gap,
  round_even(case when last_step > 0 then total_time_seconds / last_step else 0.0 end, 4) as training_time_per_step,
  (case when n > 1 and first_loss <> last_loss then coalesce(conv_step, last_step) else 0 end)::bigint as convergence_speed
from s2 left join cv using (experiment_id) left join times using (experiment_id)""", views=("v_log",))
def e06(spark, sf):
    hist, ev, times = _histories(spark, sf)
    return E.efficiency(hist, ev, times)


@query("E07_overfit_regions", _HIST_SQL + """,
nm as (select h.experiment_id, h.n, e.m from (select experiment_id, count(*) n from hist group by 1) h
       join (select experiment_id, count(*) m from ev group by 1) e using (experiment_id) where h.n >= e.m),
x as (select ev.*, nm.n, greatest(1, nm.n // nm.m) as st from ev join nm using (experiment_id))
select x.experiment_id, x.eidx, s0.step as start_step, s1.step as end_step, t.train_loss as aligned_train, x.eval_loss
from x join hist t on t.experiment_id = x.experiment_id and t.idx = least(x.eidx * x.st, x.n - 1)
join hist s1 on s1.experiment_id = x.experiment_id and s1.idx = x.eidx * x.st
join hist s0 on s0.experiment_id = x.experiment_id and s0.idx = greatest(x.eidx - 1, 0) * x.st
where t.train_loss < x.eval_loss""", views=("v_log",))
def e07(spark, sf):
    hist, ev, _ = _histories(spark, sf)
    return E.overfit_regions(hist, ev)


# ------------------------------------------------------------ experiments


def _exps(spark, sf):
    return v_experiments(spark, sf).withColumnRenamed("factor_value", "value")


@query("E08_rank_experiments", """
select id, best_loss, row_number() over (order by best_loss, seq)::bigint as rank
from (select id, seq, coalesce(eval_loss, final_loss) as best_loss from v_experiments) t
where best_loss is not null""", views=("v_experiments",))
def e08(spark, sf):
    return E.rank_experiments(_exps(spark, sf)).select("id", "best_loss", "rank")


@query("E09_compare_experiments", """
select id, loss, rk::bigint as rank, rk = 1 as is_best, rk = n as is_worst from (
  select id, loss, row_number() over (order by loss, seq) as rk, count(*) over () as n
  from (select id, seq, coalesce(eval_loss, 'inf'::double) as loss from v_experiments where status = 'completed') t) u""",
       views=("v_experiments",))
def e09(spark, sf):
    r = _exps(spark, sf).where(F.col("status") == "completed")
    return E.compare_experiments(r).select("id", "loss", "rank", "is_best", "is_worst")


_LOSS = "coalesce(nullif(eval_loss, 0), nullif(final_loss, 0), 'inf'::double)"


@query("E10_best_per_factor", f"""
select factor, arg_min(factor_value, {{'l': {_LOSS}, 's': seq}}) as best_value, min({_LOSS}) as best_loss
from v_experiments where status = 'completed' group by factor""", views=("v_experiments",))
def e10(spark, sf):
    return E.best_per_factor(_exps(spark, sf))


@query("E11_best_combo", f"""
select factor, arg_min(factor_value, {{'l': {_LOSS}, 's': seq}}) as best_value, min({_LOSS}) as best_loss
from v_experiments where status = 'completed' group by factor""", views=("v_experiments",))
def e11(spark, sf):
    x = _exps(spark, sf).withColumn("config_diff", F.create_map(F.col("factor"), F.col("value")))
    return E.best_combo(x.drop("factor", "value"))


@query("E12_best_ratio", f"""
select arg_min(id, {{'l': {_LOSS}, 's': seq}}) as id, min({_LOSS}) as loss
from v_experiments where status = 'completed'""", views=("v_experiments",))
def e12(spark, sf):
    return E.best_ratio(_exps(spark, sf))


_VALID = """valid as (select * from v_experiments where status = 'completed' and final_loss is not null
  and not isnan(final_loss) and abs(final_loss) <> 'inf'::double),
sc as (select unnest(['click','view','purchase','signup','error']) as factor,
              unnest(['log','log','linear','linear','linear']) as scale),
xv as (select v.*, case when sc.scale = 'log' then log10(greatest(factor_value, 1e-12)) else factor_value end as x
       from valid v join sc using (factor)),
mu as (select factor, avg(x) as mx, avg(final_loss) as my, count(*) as n from xv group by factor),
cr as (select factor, any_value(n) as n, sum((x - mx) * (final_loss - my)) as cov, sqrt(sum((x - mx) ^ 2)) as sx,
              sqrt(sum((final_loss - my) ^ 2)) as sy from xv join mu using (factor) group by factor),
corr as (select factor, n, case when n < 2 or sx < 1e-12 or sy < 1e-12 then 0.0 else cov / (sx * sy) end as corr from cr)"""


def _factors(spark):
    rows = [("click", "log", False), ("view", "log", False), ("purchase", "linear", True),
            ("signup", "linear", False), ("error", "linear", False)]
    return spark.createDataFrame(rows, "factor string, scale string, discrete boolean").select(
        "*", F.lit(1.0).alias("min_value"), F.lit(9.0).alias("max_value"), F.lit(5).alias("max_rounds"),
        F.lit(5.0).alias("default_value"))


@query("E13_factor_corr", f"""with {_VALID}
select factor, n::bigint as n, corr from corr""", views=("v_experiments",))
def e13(spark, sf):
    x = _exps(spark, sf)
    v = x.where((F.col("status") == "completed") & F.col("final_loss").isNotNull() & ~F.isnan("final_loss")
                & (F.abs("final_loss") != float("inf")))
    v = v.join(F.broadcast(_factors(spark).select("factor", "scale")), "factor")
    return E.factor_corr(v, scale=F.col("scale")).withColumn("n", F.col("n").cast("bigint"))


@query("E14_factor_trend", f"""select *, case reason when 'expand' then 'expand' when 'narrow' then 'continue' else 'done' end as action from (
with {_VALID},
r as (select *, row_number() over (partition by factor order by seq) as rk, count(*) over (partition by factor) as nn from valid),
a as (select factor, count(*) as n, arg_min(factor_value, {{'l': final_loss, 's': seq}}) as best_value, min(final_loss) as best_loss,
             min(final_loss) filter (where rk <= nn // 2) as fh, min(final_loss) filter (where rk > nn // 2) as sh from r group by factor)
select a.factor, case when a.n = 0 then 'no_valid' when a.n < 2 then 'single' when 1 >= 5 - 1 then 'round_cap'
  when a.n >= 4 and fh > 0 and (fh - sh) / fh < 0.05 then 'converged' when abs(corr) < 0.3 then 'plateau'
  when corr > 0.7 then 'rising' when corr < -0.7 then 'expand' else 'narrow' end as reason,
  best_value, best_loss, corr.corr as corr
from a join corr using (factor)) t""", views=("v_experiments",))
def e14(spark, sf):
    t = E.factor_trend(_exps(spark, sf), _factors(spark), round_number=1)
    return t.select("factor", "reason", "best_value", "best_loss", "corr", "action")


@query("E18_ablation_plan", """with f as (select factor, min(seq) as o, list(distinct factor_value order by factor_value) as vals
  from v_experiments group by factor),
x as (select factor, o, unnest(vals) as value, generate_subscripts(vals, 1) as vpos from f)
select format('abl-{:03d}', row_number() over (order by o, vpos)::int) as id, factor, value from x""",
       views=("v_experiments",))
def e18(spark, sf):
    f = (_exps(spark, sf).groupBy("factor")
         .agg(F.min("seq").alias("factor_order"), F.array_sort(F.collect_set("value")).alias("values")))
    return E.ablation_plan(f)


@query("E19_factor_grid", """with f as (select factor, list(distinct factor_value order by factor_value) as vals
  from v_experiments group by factor),
u as (select factor, unnest(vals) as v from f),
g as (select * from (select v as click from u where factor = 'click'), (select v as error from u where factor = 'error'),
  (select v as purchase from u where factor = 'purchase'), (select v as signup from u where factor = 'signup'),
  (select v as view from u where factor = 'view'))
select 'click=' || click || ',error=' || error || ',purchase=' || purchase || ',signup=' || signup || ',view=' || view as config
from g""", views=("v_experiments",))
def e19(spark, sf):
    f = (_exps(spark, sf).groupBy("factor")
         .agg(F.min("seq").alias("factor_order"), F.array_sort(F.collect_set("value")).alias("values")))
    g = E.factor_grid(f)
    kv = F.array_sort(F.map_entries("config"))
    return g.select(F.array_join(F.transform(kv, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
                    .alias("config"))


@query("E20_untested_factors", """with a as (select unnest(['learning_rate', 'lora_rank', 'per_device_train_batch_size',
  'gradient_accumulation_steps', 'view', 'click']) as factor)
select factor from a where factor not in (select distinct factor from v_experiments)""", views=("v_experiments",))
def e20(spark, sf):
    allf = spark.createDataFrame([(f,) for f in ["learning_rate", "lora_rank", "per_device_train_batch_size",
                                                 "gradient_accumulation_steps", "view", "click"]], "factor string")
    x = _exps(spark, sf).withColumn("config_diff", F.create_map(F.concat(F.lit("finetuning."), F.col("factor")),
                                                                F.col("value")))
    return E.untested_factors(allf, x)


def _scored(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
                                          F.col("value").alias("throughput"), (F.col("event_id") % 17 == 0).alias("has_nan"))
    return _exps(spark, sf).join(e, "id")


_SCORE_SQL = """s as (select x.id, x.factor, 0.7 * (1.0 / (case when coalesce(x.eval_loss, 'inf'::double) <= 0 then 1e-8
      else coalesce(x.eval_loss, 'inf'::double) end)) + 0.2 * (case when e.event_id % 17 = 0 then 0.5 else 1.0 end)
      + 0.1 * (coalesce(e.value, 0.0) / 10.0) as score
  from v_experiments x join events e on x.id = concat('e', cast(e.event_id as varchar)))"""


@query("E21_composite_score", f"""with {_SCORE_SQL} select id, score from s""", views=("v_experiments",))
def e21(spark, sf):
    return E.composite_score(_scored(spark, sf), {"eval_loss": 1.0, "throughput": 10.0}).select("id", "score")


@query("E22_dataset_importance", f"""with {_SCORE_SQL},
loo as (select factor as dataset, avg(score) as score from s group by factor),
b as (select avg(score) as b from s),
d as (select dataset, score, b - score as delta from loo, b)
select dataset, delta, case when delta > 0.05 then 'important' when delta > -0.05 then 'neutral' else 'noise' end as verdict,
       row_number() over (order by delta desc, dataset)::bigint as rank from d""", views=("v_experiments",))
def e22(spark, sf):
    s = E.composite_score(_scored(spark, sf), {"eval_loss": 1.0, "throughput": 10.0})
    loo = s.groupBy(F.col("factor").alias("dataset")).agg(F.avg("score").alias("score"))
    base = s.select(F.avg("score")).scalar()
    return E.dataset_importance(loo, base).select("dataset", "delta", "verdict", "rank")


def _metrics_long(spark, sf):
    x = _exps(spark, sf)
    per = x.groupBy(F.col("run_id").alias("experiment_id")).agg(
        (F.avg("final_loss") / 10).alias("ned"), (F.avg("eval_loss") / 10).alias("cer"),
        F.avg((F.col("status") == "completed").cast("double")).alias("em"), F.min("final_loss").alias("fl"))
    kv = F.array(F.struct(F.lit("text_recognition.ned").alias("key"), F.col("ned").alias("value")),
                 F.struct(F.lit("text_recognition.cer").alias("key"), F.col("cer").alias("value")),
                 F.struct(F.lit("text_recognition.exact_match").alias("key"), F.col("em").alias("value")),
                 F.struct(F.lit("training.final_loss").alias("key"), F.col("fl").alias("value")))
    return per.select("experiment_id", F.explode(kv).alias("kv")).select("experiment_id", "kv.key", "kv.value")


_ML = """ml as (select experiment_id, unnest(['text_recognition.ned', 'text_recognition.cer', 'text_recognition.exact_match',
  'training.final_loss']) as key, unnest([ned, cer, em, fl]) as value from (
  select run_id as experiment_id, avg(final_loss) / 10 as ned, avg(eval_loss) / 10 as cer,
         avg(case when status = 'completed' then 1.0 else 0.0 end) as em, min(final_loss) as fl from v_experiments group by run_id))"""


@query("E24_radar", f"""with {_ML}
select experiment_id, case key when 'text_recognition.ned' then 'NED' when 'text_recognition.cer' then 'CER'
  when 'text_recognition.exact_match' then 'Exact Match' end as label,
  case when key in ('text_recognition.ned', 'text_recognition.cer') then greatest(0.0, 1 - value) else value end as value
from ml where key in ('text_recognition.ned', 'text_recognition.cer', 'text_recognition.exact_match')""",
       views=("v_experiments",))
def e24(spark, sf):
    return E.radar(_metrics_long(spark, sf))


@query("E25_heatmap", f"""with {_ML},
g as (select experiment_id, key, coalesce(value, 0.0) as value from ml where key in ('text_recognition.ned', 'training.final_loss')),
st as (select avg(value) as mu, stddev_pop(value) as sd from g)
select experiment_id, key, value, abs(value - mu) > sd as outlier from g, st""", views=("v_experiments",))
def e25(spark, sf):
    return E.heatmap(_metrics_long(spark, sf), ["text_recognition.ned", "training.final_loss"])


@query("E27_bars", f"""with {_ML}
select experiment_id, key, value, value = max(value) over (partition by key) as is_best from ml""",
       views=("v_experiments",))
def e27(spark, sf):
    return E.bars(_metrics_long(spark, sf)).select("experiment_id", "key", "value", "is_best")


@query("E28_loss_bars", """
select id, final_loss, final_loss = min(final_loss) over () as is_best from v_experiments where status = 'completed'""",
       views=("v_experiments",))
def e28(spark, sf):
    x = _exps(spark, sf).where(F.col("status") == "completed")
    return E.loss_bars(x).select("id", "final_loss", "is_best")


@query("E29_available_metrics", f"""with {_ML}
select distinct key from ml where value is not null and key in ('text_recognition.ned', 'text_recognition.cer', 'table_recognition.teds')""",
       views=("v_experiments",))
def e29(spark, sf):
    return E.available_metrics(_metrics_long(spark, sf),
                               ["text_recognition.ned", "text_recognition.cer", "table_recognition.teds"])


@query("E30_flatten_metrics", """select * from (select id as experiment_id,
  unnest(['training.final_loss', 'training.eval_loss', 'factor.value']) as key,
  unnest([final_loss, eval_loss, factor_value]) as value from v_experiments) t where value is not null""",
       views=("v_experiments",))
def e30(spark, sf):
    x = _exps(spark, sf)
    nested = x.select(F.col("id").alias("experiment_id"),
                      F.struct(F.struct(F.col("final_loss").alias("final_loss"), F.col("eval_loss").alias("eval_loss"))
                               .alias("training"),
                               F.struct(F.col("value").alias("value"), F.col("factor").alias("name")).alias("factor"))
                      .alias("metrics"))
    return E.flatten_metrics(nested, "metrics")


# ------------------------------------------------------------ single-metric views of E06 and trend parts

def _eff(spark, sf):
    hist, ev, times = _histories(spark, sf)
    return E.efficiency(hist, ev, times)


def _one(col):
    def run(spark, sf):
        return _eff(spark, sf).select("experiment_id", col)
    return run


for _id, _col in [("E01_best_step", "best_step"), ("E02_loss_reduction_rate", "loss_reduction_rate"),
                  ("E03_overfitting_gap", "overfitting_gap"), ("E04_time_per_step", "training_time_per_step"),
                  ("E05_convergence_speed", "convergence_speed")]:
    from kiln.plans.catalog import _ORACLE as _O
    query(_id, f"select experiment_id, {_col} from (\n{_O['E06_efficiency']}\n) t")(_one(_col))


@query("E15_convergence_check", f"""with {_VALID},
r as (select *, row_number() over (partition by factor order by seq) as rk, count(*) over (partition by factor) as nn from valid),
a as (select factor, count(*) as n, min(final_loss) filter (where rk <= nn // 2) as fh,
             min(final_loss) filter (where rk > nn // 2) as sh from r group by factor)
select factor, n >= 4 and fh > 0 and (fh - sh) / fh < 0.05 as converged from a""", views=("v_experiments",))
def e15(spark, sf):
    x = _exps(spark, sf)
    v = x.where((F.col("status") == "completed") & F.col("final_loss").isNotNull() & ~F.isnan("final_loss"))
    from kiln.functions.ranking import ordered_rank
    r = ordered_rank(v, "seq", by=["factor"], count_col="_n")
    a = r.groupBy("factor").agg(F.count(F.lit(1)).alias("n"),
                                F.min(F.when(F.col("rank") <= F.floor(F.col("_n") / 2), F.col("final_loss"))).alias("fh"),
                                F.min(F.when(F.col("rank") > F.floor(F.col("_n") / 2), F.col("final_loss"))).alias("sh"))
    return a.select("factor", ((F.col("n") >= 4) & (F.col("fh") > 0) & ((F.col("fh") - F.col("sh")) / F.col("fh") < 0.05))
                    .alias("converged"))


def _valid(spark, sf):
    x = _exps(spark, sf)
    return x.where((F.col("status") == "completed") & F.col("final_loss").isNotNull() & ~F.isnan("final_loss")
                   & (F.abs("final_loss") != float("inf")))


_FACTOR_SQL = """fc as (select * from (values ('click', 'log', false), ('view', 'log', false), ('purchase', 'linear', true),
  ('signup', 'linear', false), ('error', 'linear', false)) t(factor, scale, discrete))"""


def _finish_sql(vals: str) -> str:
    """Clamp to [lo, hi], half-even rounding when discrete, first-wins dedup
    on 10 decimals, ascending (DuckDB form of ``experiments._finish``)."""
    c = f"list_transform({vals}, lambda v: case when discrete then round_even(greatest(lo, least(hi, v)), 0) else greatest(lo, least(hi, v)) end)"
    return (f"list_sort(list_filter({c}, lambda v, i: i = 1 or not list_bool_or(list_transform(list_slice({c}, 1, i - 1), "
            f"lambda u: round_even(u, 10) = round_even(v, 10)))))")


def _flat(df, col):
    return df.select("factor", F.posexplode(col).alias("pos", "value"))


@query("E16_narrow_values", f"""with {_VALID.split(',' + chr(10) + 'sc as')[0]}, {_FACTOR_SQL},
b as (select factor, arg_min(factor_value, {{'l': final_loss, 's': seq}}) as best from valid group by factor),
nb as (select v.factor, any_value(b.best) as best, max(case when v.factor_value < b.best then v.factor_value end) as lft,
              min(case when v.factor_value > b.best then v.factor_value end) as rgt,
              count(*) filter (where v.factor_value = b.best) as dups from valid v join b using (factor) group by v.factor),
p as (select nb.*, fc.scale, fc.discrete, 1.0 as lo, 9.0 as hi,
             coalesce(lft, 1.0) as l, case when dups >= 2 then best else coalesce(rgt, 9.0) end as r from nb join fc using (factor)),
q as (select *, case when scale = 'log' then
        [pow(10.0, (log10(greatest(case when l <= 0 then lo else l end, 1e-12)) + log10(greatest(best, 1e-12))) / 2),
         pow(10.0, log10(greatest(best, 1e-12))),
         pow(10.0, (log10(greatest(best, 1e-12)) + log10(greatest(r, 1e-12))) / 2)]
      else [(l + best) / 2, best, (best + r) / 2] end as vals from p),
o as (select factor, {_finish_sql('vals')} as nv from q)
select factor, unnest(range(len(nv))) as pos, unnest(nv) as value from o""", views=("v_experiments",))
def e16(spark, sf):
    v = _valid(spark, sf)
    agg = v.groupBy("factor").agg(F.min_by("value", F.struct("final_loss", "seq")).alias("best"))
    nb = v.join(agg, "factor").groupBy("factor", "best").agg(
        F.max(F.when(F.col("value") < F.col("best"), F.col("value"))).alias("left"),
        F.min(F.when(F.col("value") > F.col("best"), F.col("value"))).alias("right"),
        F.count_if(F.col("value") == F.col("best")).alias("dups"))
    j = nb.join(F.broadcast(_factors(spark)), "factor")
    right = F.when(F.col("dups") >= 2, F.col("best")).otherwise(F.coalesce("right", "max_value"))
    nv = E.narrow_values(F.col("best"), F.coalesce("left", "min_value"), right,
                         F.col("scale"), F.col("min_value"), F.col("max_value"), F.col("discrete"))
    return _flat(j.select("factor", nv.alias("nv")), "nv")


def _expand_sql(direction: str) -> str:
    fr = "[0.25, 0.5, 0.75]"
    lg = lambda v: f"log10(greatest({v}, 1e-12))"
    if direction == "up":
        new = f"case when scale = 'log' then least(pow(10.0, {lg('vmax')} + 0.5), hi) else least(vmax + (vmax - vmin), hi) end"
        logv = f"list_transform({fr}, lambda f: pow(10.0, {lg('vmax')} + ({lg('nw')} - {lg('vmax')}) * f))"
        linv = f"list_transform({fr}, lambda f: vmax + (nw - vmax) * f)"
        empty = "nw <= vmax"
    else:
        new = f"case when scale = 'log' then greatest(pow(10.0, {lg('vmin')} - 0.5), lo) else greatest(vmin - (vmax - vmin), lo) end"
        logv = f"list_transform({fr}, lambda f: pow(10.0, {lg('nw')} + ({lg('vmin')} - {lg('nw')}) * f))"
        linv = f"list_transform({fr}, lambda f: nw + (vmin - nw) * f)"
        empty = "nw >= vmin"
    return f"""with {_VALID.split(',' + chr(10) + 'sc as')[0]}, {_FACTOR_SQL},
a as (select factor, min(factor_value) as vmin, max(factor_value) as vmax from valid group by factor),
p as (select a.*, fc.scale, fc.discrete, {'1.0' if direction == 'up' else '0.1'} as lo, 30.0 as hi from a join fc using (factor)),
n as (select *, {new} as nw from p),
q as (select *, case when {empty} then []::double[] else case when scale = 'log' then {logv} else {linv} end end as vals from n),
o as (select factor, case when len(vals) = 0 then []::double[] else {_finish_sql('vals')} end as nv from q)
select factor, unnest(range(len(nv))) as pos, unnest(nv) as value from o"""


def _expand(spark, sf, direction):
    v = _valid(spark, sf)
    x = v.groupBy("factor").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    f = _factors(spark).withColumn("max_value", F.lit(30.0))
    if direction == "down":
        f = f.withColumn("min_value", F.lit(0.1))
    j = x.join(F.broadcast(f), "factor")
    args = (F.col("vmin"), F.col("vmax"), F.col("scale"), F.col("min_value"), F.col("max_value"), F.col("discrete"))
    return _flat(j.select("factor", E.expand_values(*args, direction).alias("nv")), "nv")


@query("E17_expand_values", _expand_sql("up"), views=("v_experiments",))
def e17(spark, sf):
    return _expand(spark, sf, "up")


@query("E17_expand_values_down", _expand_sql("down"), views=("v_experiments",))
def e17d(spark, sf):
    return _expand(spark, sf, "down")


@query("E23_loss_trend_label", """with x as (select log_id, line_no,
  try_cast(nullif(regexp_extract(line, '(?i)loss[:\\s]+(\\d+\\.?\\d*)', 1), '') as double) as loss from v_log)
select log_id, case when arg_max(loss, line_no) filter (where loss is not null) < arg_min(loss, line_no) filter (where loss is not null)
  then 'decreasing' else 'increasing' end as loss_trend from x group by log_id having count(loss) > 0""", views=("v_log",))
def e23(spark, sf):
    return L.log_trend(v_log(spark, sf)).where(F.col("loss_trend").isNotNull()).select("log_id", "loss_trend")


@query("E26_heatmap_outliers", f"""with {_ML},
g as (select experiment_id, key, coalesce(value, 0.0) as value from ml where key in ('text_recognition.ned', 'training.final_loss')),
st as (select avg(value) as mu, stddev_pop(value) as sd from g)
select experiment_id, key from g, st where abs(value - mu) > sd""", views=("v_experiments",))
def e26(spark, sf):
    h = E.heatmap(_metrics_long(spark, sf), ["text_recognition.ned", "training.final_loss"])
    return h.where("outlier").select("experiment_id", "key")
