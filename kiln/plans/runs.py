"""Run / phase / experiment / checkpoint queries over event-derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import logs as L
from kiln.operators import runs as R
from kiln.plans.catalog import query
from kiln.plans.views import table, v_checkpoints, v_experiments, v_log, v_phase_events


def v_runs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.max_by(F.col("event_id") % 7, "event_id").alias("current_phase"))


_RUNS = """runs as (select concat('run-', cast(user_id as varchar)) as run_id, min(ts) as created_at, max(ts) as updated_at,
  arg_max(event_id % 7, event_id) as current_phase from events group by user_id)"""


@query("R01_latest_run", f"""with {_RUNS}
select * from runs order by updated_at desc, run_id desc limit 1""")
def r01(spark, sf):
    return R.latest_run(v_runs(spark, sf))


@query("R02_phase_events", """
select id, run_id, phase, status, ts, row_number() over (partition by run_id order by id)::bigint as seq
from v_phase_events""", views=("v_phase_events",))
def r02(spark, sf):
    return R.phase_events(v_phase_events(spark, sf))


_STATE = f"""{_RUNS},
last as (select run_id, phase, arg_max({{'status': status, 'ts': ts}}, id) as l from v_phase_events group by run_id, phase),
grid as (select run_id, unnest(range(0, 7)) as phase from runs),
state as (select g.run_id, g.phase, coalesce(l.l.status, 'pending') as status, l.l.ts as ts
          from grid g left join last l on g.run_id = l.run_id and g.phase = l.phase)"""


@query("R03_phase_state", f"""with {_STATE}
select run_id, phase, status, ts, status = 'completed' as completed from state""", views=("v_phase_events",))
def r03(spark, sf):
    return R.phase_state(v_phase_events(spark, sf), v_runs(spark, sf))


@query("R04_phase_completed", f"""with {_STATE}
select run_id, phase from state where status = 'completed'""", views=("v_phase_events",))
def r04(spark, sf):
    return R.phase_state(v_phase_events(spark, sf), v_runs(spark, sf)).where("completed").select("run_id", "phase")


@query("R05_progress", f"""with {_RUNS},
c as (select run_id, count(distinct phase) as c from v_phase_events where status = 'completed' group by run_id)
select runs.run_id, coalesce(c.c, 0)::bigint as completed_phases, 7 as total_phases,
       round_even(coalesce(c.c, 0) / 7 * 100, 1) as progress_pct
from runs left join c on runs.run_id = c.run_id""", views=("v_phase_events",))
def r05(spark, sf):
    return R.progress(v_phase_events(spark, sf), v_runs(spark, sf))


@query("R06_experiments", """
select x.id, x.run_id, x.status, cast(json_extract(e.props, '$.k') as bigint) as k
from v_experiments x join events e on x.id = concat('e', cast(e.event_id as varchar))""", views=("v_experiments",))
def r06(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
                                          F.col("props").alias("config_json"))
    x = R.experiments(v_experiments(spark, sf).join(e, "id"), {"config_json": "k bigint"})
    return x.select("id", "run_id", "status", F.col("config_json.k").alias("k"))


@query("R07_queue_status", """
select factor as phase, count(*)::bigint as total, count(*) filter (where status = 'completed')::bigint as completed,
  count(*) filter (where status = 'failed')::bigint as failed, count(*) filter (where status = 'pending')::bigint as pending,
  count(*) filter (where status = 'running')::bigint as running
from v_experiments group by rollup(factor)""", views=("v_experiments",))
def r07(spark, sf):
    return R.queue_status(v_experiments(spark, sf).withColumnRenamed("factor", "phase"))


@query("R08_next_pending", """
select arg_min(id, seq) as id, min(seq) as seq from v_experiments where status = 'pending'""", views=("v_experiments",))
def r08(spark, sf):
    return R.next_pending(v_experiments(spark, sf))


@query("R09_latest_checkpoint", """
select run_id, experiment_id, arg_max(path, step) as path, max(step) as step, arg_max(loss, step) as loss
from v_checkpoints group by run_id, experiment_id""", views=("v_checkpoints",))
def r09(spark, sf):
    return R.latest_checkpoint(v_checkpoints(spark, sf), ["run_id", "experiment_id"])


@query("R10_latest_checkpoint_path", """
select run_id, arg_max(path, s) as latest, max(s) as step from (
  select run_id, path, try_cast(split_part(path[11:], '-', 2) as bigint) as s from v_checkpoints) t
where s is not null group by run_id""", views=("v_checkpoints",))
def r10(spark, sf):
    return R.latest_checkpoint_from_paths(v_checkpoints(spark, sf), ["run_id"])


@query("R11_checkpoints_to_drop", """with c as (select *, cast(split_part(path[11:], '-', 2) as bigint) as s from v_checkpoints),
n as (select run_id, experiment_id, count(*) as n from c group by all),
k as (select run_id, experiment_id, s from (select *, row_number() over (partition by run_id, experiment_id order by s desc) r from c) where r <= 1
      union select run_id, experiment_id, s from (select *, row_number() over (partition by run_id, experiment_id order by loss, s) r from c where loss is not null) where r <= 1)
select c.run_id, c.experiment_id, c.path, c.step, c.loss from c join n using (run_id, experiment_id)
where n.n > 2 and not exists (select 1 from k where k.run_id = c.run_id and k.experiment_id = c.experiment_id and k.s = c.s)""",
       views=("v_checkpoints",))
def r11(spark, sf):
    return R.checkpoints_to_drop(v_checkpoints(spark, sf), ["run_id", "experiment_id"], keep_best=1, keep_last=1)


@query("R12_keep_last_checkpoints", """with c as (select *, cast(split_part(path[11:], '-', 2) as bigint) as s from v_checkpoints),
n as (select run_id, experiment_id, count(*) as n from c group by all),
k as (select run_id, experiment_id, s from (select *, row_number() over (partition by run_id, experiment_id order by s desc) r from c) where r <= 3)
select c.run_id, c.experiment_id, c.path, c.step, c.loss from c join n using (run_id, experiment_id)
where n.n > 3 and not exists (select 1 from k where k.run_id = c.run_id and k.experiment_id = c.experiment_id and k.s = c.s)""",
       views=("v_checkpoints",))
def r12(spark, sf):
    return R.checkpoints_to_drop(v_checkpoints(spark, sf), ["run_id", "experiment_id"], keep_best=0, keep_last=3)


@query("R13_phase_checkpoints_to_drop", """
select c.run_id, 'e' || cast(c.step as varchar) as experiment_id, c.path, c.step, c.loss from v_checkpoints c
where exists (select 1 from v_experiments x where x.status = 'completed'
  and x.factor = 'click' and x.run_id = c.run_id and x.id = 'e' || cast(c.step as varchar))""",
       views=("v_checkpoints", "v_experiments"))
def r13(spark, sf):
    c = v_checkpoints(spark, sf).withColumn("experiment_id", F.concat(F.lit("e"), F.col("step").cast("string")))
    x = v_experiments(spark, sf).withColumnRenamed("factor", "phase")
    return R.phase_checkpoints_to_drop(c, x, phase="click").withColumn(
        "experiment_id", F.col("experiment_id"))


@query("R14_snapshot", f"""with {_RUNS},
ev as (select run_id, count(*) as n_events, arg_max(status, id) as last_status from v_phase_events group by run_id),
ex as (select run_id, count(*) as n_experiments, count(*) filter (where status = 'completed') as n_completed
       from v_experiments group by run_id),
c as (select run_id, count(distinct phase) as c from v_phase_events where status = 'completed' group by run_id)
select runs.run_id, ev.n_events::bigint as n_events, ev.last_status, ex.n_experiments::bigint as n_experiments,
       ex.n_completed::bigint as n_completed, round_even(coalesce(c.c, 0) / 7 * 100, 1) as progress_pct
from runs left join ev using (run_id) left join ex using (run_id) left join c using (run_id)""",
       views=("v_phase_events", "v_experiments"))
def r14(spark, sf):
    s = R.snapshot(v_runs(spark, sf), v_phase_events(spark, sf), v_experiments(spark, sf))
    return s.select("run_id", F.col("n_events").cast("bigint").alias("n_events"),
                    F.col("last_event.status").alias("last_status"),
                    F.col("n_experiments").cast("bigint").alias("n_experiments"),
                    F.col("n_completed").cast("bigint").alias("n_completed"), "progress_pct")


@query("R15_status_table", """
select id, status, seq from v_experiments order by seq desc limit 20""", views=("v_experiments",))
def r15(spark, sf):
    return R.status_table(v_experiments(spark, sf)).select("id", "status", "seq")


@query("R16_report", """
select count(*)::bigint as total, count(*) filter (where status = 'completed')::bigint as completed,
  count(*) filter (where status = 'failed')::bigint as failed,
  arg_min(id, {'l': eval_loss, 's': seq}) filter (where eval_loss is not null) as best_id, min(eval_loss) as best_eval_loss
from v_experiments""", views=("v_experiments",))
def r16(spark, sf):
    return R.report(v_experiments(spark, sf)).select(
        F.col("total").cast("bigint").alias("total"), F.col("completed").cast("bigint").alias("completed"),
        F.col("failed").cast("bigint").alias("failed"), "best_id", "best_eval_loss")


def _cfg(spark, sf, first: bool):
    e = table(spark, sf, "events")
    pick = F.min_by if first else F.max_by
    g = e.groupBy(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id")).agg(
        pick(F.get_json_object("props", "$.k"), "event_id").alias("k"), pick("event_type", "event_id").alias("t"))
    kv = F.array(F.struct(F.lit("k").alias("key"), F.col("k").alias("value")),
                 F.struct(F.lit("event_type").alias("key"), F.col("t").alias("value")))
    return g.select("run_id", F.lit("finetuning").alias("section"), F.explode(kv).alias("kv")).select(
        "run_id", "section", "kv.key", "kv.value")


@query("R17_config_diff", """with f as (select concat('run-', cast(user_id as varchar)) as run_id,
  arg_min(json_extract_string(props, '$.k'), event_id) as bk, arg_min(event_type, event_id) as bt,
  arg_max(json_extract_string(props, '$.k'), event_id) as nk, arg_max(event_type, event_id) as nt from events group by user_id),
l as (select run_id, 'finetuning' as section, 'k' as key, nk as value, bk as base_value from f
      union all select run_id, 'finetuning', 'event_type', nt, bt from f)
select * from l where value is distinct from base_value""")
def r17(spark, sf):
    return R.config_diff(_cfg(spark, sf, True), _cfg(spark, sf, False), by=["run_id"])


@query("R18_phases_by_status", f"""with {_STATE}
select run_id, phase, status from state where status in ('pending', 'failed')""", views=("v_phase_events",))
def r18(spark, sf):
    return R.phases_by_status(R.phase_state(v_phase_events(spark, sf), v_runs(spark, sf)))


def _r19_sql():
    from kiln.plans.catalog import _ORACLE as O
    return f"""select f.*, case when coalesce(f.final_step, 0) > 0 and (coalesce(f.max_steps, 0) <= 0
    or f.final_step >= f.max_steps * 0.9) then 'completed' else 'failed' end as status,
  coalesce(e.n, 0)::bigint as n_errors, coalesce(h.n, 0)::bigint as history_len
from ({O['L06_final_metrics']}) f
left join (select log_id, count(*) as n from ({O['L07_error_summary']}) x group by log_id) e on f.log_id = e.log_id
left join (select log_id, count(*) as n from ({O['L08_history']}) y group by log_id) h on f.log_id = h.log_id"""


@query("R19_results", _r19_sql())
def r19(spark, sf):
    v = v_log(spark, sf)
    fm = L.final_metrics(v)
    errs = L.error_summary(v)
    hist = L.history(L.parse_metrics(v))
    exits = v.select("log_id").distinct().select("log_id", F.lit(1).alias("exit_code"))
    st = L.run_status(fm, exits)
    return R.results(fm, errs, hist, st)
