"""Log-analytics queries over ``v_log`` (one training log per user)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import logs as L
from kiln.plans.catalog import query
from kiln.plans.views import duck_strip, v_log


def duck_re(p: str) -> str:
    """Java pattern -> RE2 (DuckDB): drop the Unicode-class flag (in RE2
    ``U`` means ungreedy) and escape quotes for a SQL literal."""
    return p.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


def _x(col: str, p: str, grp: int = 1) -> str:
    return f"nullif(regexp_extract({col}, '{duck_re(p)}', {grp}), '')"


_PARSE = f"""m0 as (select log_id, line_no, line, {duck_strip('line')} as s from v_log),
m1 as (select *, regexp_extract_all(s, '{duck_re(L.EVAL_KV_RE)}', 1) as kk,
              regexp_extract_all(s, '{duck_re(L.EVAL_KV_RE)}', 2) as vv from m0),
m2 as (select *, list_filter(list_transform(range(1, len(kk) + 1), lambda i: {{'k': kk[i], 'v': try_cast(vv[i] as double)}}),
                             lambda e: e.v is not null) as kv from m1),
pm as (select log_id, line_no, line,
  try_cast({_x('s', L.STEP_RE)} as bigint) as step,
  try_cast({_x('s', L.LOSS_RE)} as double) as loss,
  try_cast({_x('s', L.LR_RE)} as double) as lr,
  try_cast({_x('s', L.MEM_RE)} as double) as memory_mb,
  try_cast({_x('s', L.SPEED_RE)} as double) as throughput,
  coalesce(try_cast({_x('s', L.EVAL_RE)} as double), list_filter(kv, lambda e: e.k = 'loss')[1].v) as eval_loss,
  try_cast({_x('s', L.EPOCH_RE)} as bigint) as epoch,
  try_cast({_x('s', L.GRAD_NORM_RE)} as double) as grad_norm,
  list_filter(kv, lambda e: e.k = 'ppl')[-1].v as eval_ppl,
  list_filter(kv, lambda e: e.k = 'accuracy')[-1].v as eval_accuracy,
  len(list_distinct(list_transform(list_filter(kv, lambda e: e.k not in ('loss', 'ppl')), lambda e: e.k))) as n_extra,
  regexp_matches(s, '{duck_re(L.NAN_LOSS_RE)}') as has_nan, s
from m2),
parsed as (select * from pm where s <> '' and (step is not null or loss is not null or eval_loss is not null
                                             or n_extra > 0 or has_nan))"""


def _parsed(spark, sf):
    return L.parse_metrics(v_log(spark, sf))


@query("L01_parse_metrics", f"""with {_PARSE}
select log_id, line_no, step, loss, lr, memory_mb, throughput, eval_loss, epoch, grad_norm, eval_ppl,
       eval_accuracy, n_extra::int as n_extra, has_nan from parsed""", views=("v_log",))
def l01(spark, sf):
    p = _parsed(spark, sf)
    return p.select("log_id", "line_no", "step", "loss", "lr", "memory_mb", "throughput", "eval_loss", "epoch",
                    "grad_norm", "eval_ppl", F.col("extra")["eval_accuracy"].alias("eval_accuracy"),
                    F.size("extra").alias("n_extra"), "has_nan")


_ETYPE = f"""case when regexp_matches(line, '{duck_re(L.OOM_RES[0])}') or regexp_matches(line, '{duck_re(L.OOM_RES[1])}') then 'OOM'
  when regexp_matches(line, '{duck_re(L.FATAL_RE)}') then 'FATAL'
  when regexp_matches(line, '{duck_re(L.NAN_RE)}') then 'NaN'
  when regexp_matches(line, '{duck_re(L.NCCL_RE)}') then 'NCCL'
  when regexp_matches(line, '{duck_re(L.ERROR_RE)}') then 'ERROR'
  when regexp_matches(line, '{duck_re(L.WARNING_RE)}') and not regexp_matches(line, '{L.WARNING_NOISE_RE}') then 'WARNING' end"""
_SEV = "case when t in ('OOM', 'FATAL') then 'fatal' when t = 'WARNING' then 'warning' else 'error' end"


@query("L04_classify_errors", f"""
select log_id, line_no, t as error_type, {_SEV} as severity, {duck_strip('line')} as message
from (select *, {_ETYPE} as t from v_log) x where t is not null""", views=("v_log",))
def l04(spark, sf):
    return L.classify_errors(v_log(spark, sf)).select("log_id", "line_no", "error_type", "severity", "message")


@query("L05_extract_metrics", f"""with {_PARSE}
select log_id, count(*)::bigint as n_metrics, count(step)::bigint as n_steps, count(eval_loss)::bigint as n_eval
from parsed group by log_id""", views=("v_log",))
def l05(spark, sf):
    p = _parsed(spark, sf)
    return p.groupBy("log_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_metrics"),
                                   F.count("step").cast("bigint").alias("n_steps"),
                                   F.count("eval_loss").cast("bigint").alias("n_eval"))


@query("L06_final_metrics", f"""with {_PARSE},
a as (select log_id, arg_max({{'loss': loss, 'step': step, 'eval_loss': eval_loss, 'throughput': throughput}}, line_no) as l,
             arg_max({{'step': step, 'loss': loss}}, line_no) filter (where step is not null) as w,
             count(eval_loss)::bigint as n_eval_losses, min(eval_loss) as best_eval_loss
      from parsed group by log_id),
h as (select log_id, arg_min(try_cast(replace(regexp_extract(line, '{duck_re(L.MAX_STEPS_RE)}', 1), ',', '') as bigint), line_no) as max_steps
      from v_log where regexp_matches(line, '{duck_re(L.MAX_STEPS_RE)}') group by log_id)
select a.log_id, coalesce(h.max_steps, 0)::bigint as max_steps,
  case when l.loss is not null and l.step is null then l.loss when w.loss is not null then w.loss end as final_loss,
  w.step as final_step, l.eval_loss as final_eval_loss, l.throughput as throughput, n_eval_losses, best_eval_loss
from a left join h on a.log_id = h.log_id""", views=("v_log",))
def l06(spark, sf):
    return L.final_metrics(v_log(spark, sf))


@query("L06_eval_losses", f"""with {_PARSE}
select log_id, line_no, eval_loss from parsed where eval_loss is not null""", views=("v_log",))
def l06_eval(spark, sf):
    return L.eval_losses(v_log(spark, sf))


@query("L07_error_summary", f"""
select log_id, line_no as line_num, t as error_type, {duck_strip('line')} as message, {_SEV} as severity
from (select *, {_ETYPE} as t from v_log) x
where t is not null and t <> 'WARNING'""", views=("v_log",))
def l07(spark, sf):
    return L.error_summary(v_log(spark, sf))


@query("L08_history", f"""with {_PARSE}
select log_id, line_no, step, coalesce(loss, 0.0) as train_loss, coalesce(eval_loss, 0.0) as eval_loss,
       coalesce(lr, 0.0) as lr from parsed where step is not null""", views=("v_log",))
def l08(spark, sf):
    return L.history(_parsed(spark, sf))


@query("L09_parse_eval_output", f"""
select log_id,
  arg_min(try_cast({_x('line', L.EVAL_OUT_RES['eval_loss'])} as double), line_no) filter (where regexp_matches(line, '{duck_re(L.EVAL_OUT_RES['eval_loss'])}')) as eval_loss,
  arg_min(try_cast({_x('line', L.EVAL_OUT_RES['eval_accuracy'])} as double), line_no) filter (where regexp_matches(line, '{duck_re(L.EVAL_OUT_RES['eval_accuracy'])}')) as eval_accuracy,
  arg_min(try_cast({_x('line', L.EVAL_OUT_RES['eval_perplexity'])} as double), line_no) filter (where regexp_matches(line, '{duck_re(L.EVAL_OUT_RES['eval_perplexity'])}')) as eval_perplexity
from v_log group by log_id""", views=("v_log",))
def l09(spark, sf):
    return L.parse_eval_output(v_log(spark, sf))


@query("L10_key_lines", f"""
select log_id, count(*) filter (where regexp_matches(line, '{duck_re(L.KEY_LINE_RE)}'))::bigint as key_lines,
       count(*)::bigint as lines from v_log group by log_id""", views=("v_log",))
def l10(spark, sf):
    v = v_log(spark, sf)
    return v.groupBy("log_id").agg(F.count_if(L.is_key_line("line")).cast("bigint").alias("key_lines"),
                                   F.count(F.lit(1)).cast("bigint").alias("lines"))


@query("L11_skeleton", f"""with n as (select log_id, count(*) as n, max(line_no) as last from v_log group by log_id),
x as (select v.*, n.n, n.last from v_log v join n using (log_id)),
short as (select log_id, line_no::double as seq, line from x where n <= 20),
c as (select log_id, line, line_no, case when line_no <= 5 then 0 when regexp_matches(line, '{duck_re(L.KEY_LINE_RE)}') then 1
        when line_no > last - 5 then 2 end as seg from x where n > 20),
f as (select log_id, line, min({{'s': seg, 'p': line_no}}) as k from c where seg is not null group by log_id, line),
r as (select *, row_number() over (partition by log_id order by k) as ra, row_number() over (partition by log_id order by k desc) as rd,
             count(*) over (partition by log_id) as m from f),
body as (select log_id, (case when m > 20 and rd <= 10 then ra + 1 else ra end)::double as seq, line from r
         where m <= 20 or ra <= 10 or rd <= 10),
marker as (select distinct log_id, 11.0::double as seq, '...[truncated]...' as line from r where m > 20)
select * from short union all select * from body union all select * from marker""", views=("v_log",))
def l11(spark, sf):
    return L.skeleton(v_log(spark, sf), max_lines=20)


@query("L13_log_trend", f"""with x as (select log_id, line_no,
  try_cast({_x('line', L.TREND_RES['loss'])} as double) as loss, try_cast({_x('line', L.TREND_RES['step'])} as bigint) as step,
  try_cast({_x('line', L.TREND_RES['lr'])} as double) as lr, try_cast({_x('line', L.TREND_RES['eval'])} as double) as ev from v_log),
a as (select log_id, arg_min(loss, line_no) filter (where loss is not null) as first_loss,
             arg_max(loss, line_no) filter (where loss is not null) as latest_loss,
             arg_max(step, line_no) filter (where step is not null) as latest_step,
             arg_max(lr, line_no) filter (where lr is not null) as latest_lr,
             arg_max(ev, line_no) filter (where ev is not null) as latest_eval_loss from x group by log_id)
select log_id, latest_loss, case when latest_loss is not null then
  (case when latest_loss < first_loss then 'decreasing' else 'increasing' end) end as loss_trend,
  latest_step, latest_lr, latest_eval_loss, latest_eval_loss - latest_loss as overfit_gap, loss_values
from a left join (select log_id, list(loss order by line_no) as loss_values
                  from (select *, row_number() over (partition by log_id order by line_no desc) as r from x where loss is not null) t
                  where r <= 20 group by log_id) v using (log_id)""", views=("v_log",))
def l13(spark, sf):
    return L.log_trend(v_log(spark, sf))


@query("L15_stderr_tail", """with b as (select log_id, max(line_no) as last,
  max(case when contains(line, 'Traceback') then line_no end) as tb from v_log group by log_id)
select v.log_id, v.line_no, v.line from v_log v join b using (log_id)
where case when tb is not null then line_no >= tb and line_no > last - 15 else line_no > last - 10 end""", views=("v_log",))
def l15(spark, sf):
    return L.stderr_tail(v_log(spark, sf))


def _quoted(x) -> str:
    return "null" if x is None else repr(x) if isinstance(x, float) else "'" + str(x).replace("'", "''") + "'"


_RULES = ", ".join(f"({_quoted(r[0])}, {', '.join(_quoted(x) for x in r[2:5])}, {float(r[5])!r}::double, {_quoted('|'.join(r[6]))})"
                   for r in L.DIAGNOSIS_RULES + [L.DIAGNOSIS_UNKNOWN])
_TIER1 = ", ".join(f"({_quoted(n)}, {_quoted(c)}, {_quoted(a)}, {_quoted(f)}::double, {_quoted(r)})"
                   for n, _, c, a, r, f in L.TIER1_RULES)


@query("L16_diagnose", f"""with e as (select log_id, line_no, {duck_strip('line')} as message, lower({duck_strip('line')}) as low
  from (select *, {_ETYPE} as t from v_log) x where t is not null),
t as (select log_id, line_no, case when regexp_matches(low, 'out of memory|oom|resourceexhaustederror') then 'oom'
  when regexp_matches(low, 'loss.*nan|nan.*loss|nanloss') then 'nan' when regexp_matches(low, 'nccl') then 'nccl'
  when regexp_matches(low, 'jsondecodeerror|json.*decode|keyerror|unexpected.*format') then 'data_format'
  when regexp_matches(low, 'checkpoint.*error|checkpoint.*corrupt|failed.*load') then 'checkpoint' else 'unknown' end as error_type
from e)
select t.*, category, root_cause, severity, confidence, fix_steps, case error_type
  when 'oom' then 'finetuning.gradient_checkpointing=true'
  when 'nan' then 'finetuning.learning_rate=1.0E-5;finetuning.max_grad_norm=1.0' else '' end as config_changes
from t join (values {_RULES}) r(error_type, category, root_cause, severity, confidence, fix_steps) using (error_type)""",
       views=("v_log",))
def l16(spark, sf):
    e = L.classify_errors(v_log(spark, sf)).select("log_id", "line_no", "message")
    changes = F.array_join(F.array_sort(F.transform(F.map_entries("config_changes"), lambda x: F.concat_ws(
        "=", x["key"], x["value"]))), ";")
    return L.diagnose(e).select("log_id", "line_no", "error_type", "category", "root_cause", "severity", "confidence",
                                F.array_join("fix_steps", "|").alias("fix_steps"), changes.alias("config_changes"))


@query("L17_diagnose_tier1", f"""with e as (select log_id, line_no, {duck_strip('line')} as message
  from (select *, {_ETYPE} as t from v_log) x where t is not null),
t as (select log_id, line_no, case when regexp_matches(message, '(?i)Out of memory|CUDA out of memory|OOM|ResourceExhaustedError') then 'oom'
  when regexp_matches(message, '(?i)loss.*nan|NaN loss|gradient.*inf') then 'nan'
  when regexp_matches(message, '(?i)NCCL.*error|NCCL.*timeout|nccl.*abort') then 'nccl'
  when regexp_matches(message, '(?i)json\\.decode|JSONDecodeError|KeyError.*messages') then 'data_format' end as error_type
from e)
select t.*, category, fix_action, factor, reason, case when error_type is not null then 0.9::double end as confidence
from t left join (values {_TIER1}) r(error_type, category, fix_action, factor, reason) using (error_type)""", views=("v_log",))
def l17(spark, sf):
    e = L.classify_errors(v_log(spark, sf)).select("log_id", "line_no", "message")
    return L.diagnose_tier1(e).drop("message")


@query("L18_run_status", """with last as (select log_id, max(line_no) as mx from v_log group by log_id),
st as (select log_id, arg_max(try_cast(nullif(regexp_extract(line, 'global_step[:\\s]+(\\d+)', 1), '') as bigint), line_no)
         filter (where regexp_matches(line, 'global_step[:\\s]+(\\d+)')) as final_step from v_log group by log_id),
ex as (select log_id, case when try_cast(substr(log_id, 5) as bigint) % 3 = 0 then 0 else 1 end as exit_code from last)
select st.log_id, case when exit_code = 0 or (coalesce(final_step, 0) > 0) then 'completed' else 'failed' end as status
from st left join ex on st.log_id = ex.log_id""", views=("v_log",))
def l18(spark, sf):
    v = v_log(spark, sf)
    fm = L.final_metrics(v)
    exits = (v.select("log_id").distinct()
              .select("log_id", F.when(F.substring("log_id", 5, 20).cast("bigint") % 3 == 0, 0).otherwise(1).alias("exit_code")))
    return L.run_status(fm, exits).select("log_id", "status")


@query("L02_eval_kv", f"""with {_PARSE},
e as (select p.log_id, p.line_no, unnest(list_transform(range(1, len(m2.kv) + 1), lambda i: {{'k': m2.kv[i].k, 'v': m2.kv[i].v, 'i': i}})) as e
      from parsed p join m2 on p.log_id = m2.log_id and p.line_no = m2.line_no)
select log_id, line_no, 'eval_' || e.k as key, arg_max(e.v, e.i) as value from e where e.k not in ('loss', 'ppl')
group by log_id, line_no, e.k""", views=("v_log",))
def l02(spark, sf):
    return _parsed(spark, sf).select("log_id", "line_no", F.explode("extra").alias("key", "value"))


@query("L03_nan_loss", f"""with {_PARSE}
select log_id, line_no from parsed where has_nan""", views=("v_log",))
def l03(spark, sf):
    return _parsed(spark, sf).where("has_nan").select("log_id", "line_no")


def _skeleton_sql(src: str, max_lines: int, edge: int = 5) -> str:
    """DuckDB form of ``skeleton`` over a CTE ``src`` (log_id, line_no, line)."""
    half = max_lines // 2
    return f"""sn as (select log_id, count(*) as n, max(line_no) as last from {src} group by log_id),
sx as (select v.*, sn.n, sn.last from {src} v join sn using (log_id)),
sshort as (select log_id, line_no::double as seq, line from sx where n <= {max_lines}),
sc as (select log_id, line, line_no, case when line_no <= {edge} then 0 when regexp_matches(line, '{duck_re(L.KEY_LINE_RE)}') then 1
        when line_no > last - {edge} then 2 end as seg from sx where n > {max_lines}),
sf as (select log_id, line, min({{'s': seg, 'p': line_no}}) as k from sc where seg is not null group by log_id, line),
sr as (select *, row_number() over (partition by log_id order by k) as ra, row_number() over (partition by log_id order by k desc) as rd,
             count(*) over (partition by log_id) as m from sf),
sbody as (select log_id, (case when m > {max_lines} and rd <= {half} then ra + 1 else ra end)::double as seq, line from sr
         where m <= {max_lines} or ra <= {half} or rd <= {half}),
smarker as (select distinct log_id, {half + 1}.0::double as seq, '...[truncated]...' as line from sr where m > {max_lines})
select * from sshort union all select * from sbody union all select * from smarker"""


@query("L12_summarize_log", """with d0 as (select source as log_id, doc_id, string_split(text, chr(10)) as parts from documents),
d as (select log_id, doc_id, unnest(parts) as line, unnest(range(len(parts))) as k from d0),
l as (select log_id, row_number() over (partition by log_id order by doc_id, k) as line_no, line from d),
o as (select *, sum(length(line) + 1) over (partition by log_id order by line_no rows between unbounded preceding and current row) as e from l),
x as (select *, e - (length(line) + 1) as st, max(e) over (partition by log_id) as tot from o),
small as (select log_id, line_no, line from x where tot < 50000),
h as (select * from x where tot >= 50000 and st < 5000),
nh as (select log_id, count(*) as nh from h group by log_id),
ft as (select log_id, min(line_no) as ft from x where tot >= 50000 and e > tot - 5000 group by log_id),
head as (select log_id, line_no, case when e > 5000 then substring(line, 1, (5000 - st)::int) else line end as line from h),
marker as (select log_id, nh + 1 as line_no, '...[file truncated]...' as line from nh),
tail as (select x.log_id, nh.nh + 2 + x.line_no - ft.ft as line_no,
               case when x.st < x.tot - 5000 then substring(x.line, (x.tot - 5000 - x.st + 1)::int) else x.line end as line
         from x join nh on x.log_id = nh.log_id join ft on x.log_id = ft.log_id where x.tot >= 50000 and x.e > x.tot - 5000),
cut as (select * from small union all select * from head union all select * from marker union all select * from tail),
""" + _skeleton_sql("cut", 40))
def l12(spark, sf):
    """The cut report: logs above 50,000 characters by their two ends."""
    return L.summarize_log(_source_logs(spark, sf), max_chars=50_000, edge_chars=5_000, max_lines=40)


def _source_logs(spark, sf):
    """Each source's documents as one long log, one line per document paragraph."""
    from kiln.functions.ranking import ordered_rank
    from kiln.plans.views import table
    lines = table(spark, sf, "documents").select(F.col("source").alias("log_id"), "doc_id",
                                                 F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return ordered_rank(lines, "doc_id", ["k"], by=["log_id"], rank_col="line_no").select("log_id", "line_no", "line")


@query("L12_summarize_whole", """with d as (select source as log_id, doc_id, unnest(string_split(text, chr(10))) as line,
  generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
l as (select log_id, row_number() over (partition by log_id order by doc_id, k) as line_no, line from d),
""" + _skeleton_sql("l", 200))
def l12_whole(spark, sf):
    """The skeleton of whole logs, with the operator's defaults."""
    return L.summarize_log(_source_logs(spark, sf))


def v_tracebacks(spark, sf):
    from kiln.plans.views import table
    e = table(spark, sf, "events")
    eid = F.col("event_id").cast("string")
    line = (F.when(F.col("event_type") == "error", F.lit("Traceback (most recent call last):"))
             .when(F.col("event_type") == "click", F.concat(F.lit('  File "/app/train.py", line '),
                                                             (F.col("event_id") % 500).cast("string"), F.lit(", in step_"),
                                                             (F.col("user_id") % 7).cast("string")))
             .when(F.col("event_type") == "view", F.concat(F.lit("ValueError: bad value "), eid))
             .when(F.col("event_type") == "purchase", F.concat(F.lit("RuntimeError: retry "), eid))
             .otherwise(F.concat(F.lit("output "), eid)))
    from pyspark.sql import Window
    return e.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("log_id"),
                    F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("line_no"), line.alias("line"))


@query("L14_traceback_summary", f"""with t as (select concat('run-', cast(user_id as varchar)) as log_id,
  row_number() over (partition by user_id order by event_id) as line_no,
  case event_type when 'error' then 'Traceback (most recent call last):'
    when 'click' then '  File "/app/train.py", line ' || (event_id % 500) || ', in step_' || (user_id % 7)
    when 'view' then 'ValueError: bad value ' || event_id when 'purchase' then 'RuntimeError: retry ' || event_id
    else 'output ' || event_id end as line from events),
s as (select log_id, line_no, {duck_strip('line')} as s from t),
x as (select *, regexp_matches(s, '^(\\w+(?:Error|Exception)):\\s*(.+)$') as is_err from s
      where not (starts_with(s, 'Traceback') or starts_with(s, '...'))),
f as (select *, row_number() over (partition by log_id order by line_no desc) as r from x
      where not is_err and regexp_matches(s, '^File "([^"]+)", line (\\d+), in (\\S+)')),
st as (select log_id, max(case when r = 3 then line_no end) as stop,
  string_agg(regexp_extract(s, '^File "([^"]+)", line (\\d+), in (\\S+)', 3) || ' (' || regexp_extract(s, '^File "([^"]+)", line (\\d+), in (\\S+)', 1)
             || ':' || regexp_extract(s, '^File "([^"]+)", line (\\d+), in (\\S+)', 2) || ')', ' -> ' order by r) as frames,
  arg_max(regexp_extract(s, '^File "([^"]+)", line (\\d+), in (\\S+)', 2), r) as ln from f where r <= 3 group by log_id),
er as (select x.log_id, arg_min(regexp_extract(x.s, '^(\\w+(?:Error|Exception)):\\s*(.+)$', 1), x.line_no) as et,
  arg_min(regexp_extract(x.s, '^(\\w+(?:Error|Exception)):\\s*(.+)$', 2), x.line_no) as em
  from x left join st on x.log_id = st.log_id where x.is_err and (st.stop is null or x.line_no > st.stop) group by x.log_id),
ids as (select distinct log_id from t)
select ids.log_id, coalesce(et, 'UnknownError') as error_type, coalesce(em, '') as message, coalesce(ln, '') as line,
  coalesce(frames, '') as key_frames
from ids left join st on ids.log_id = st.log_id left join er on ids.log_id = er.log_id""")
def l14(spark, sf):
    t = L.traceback_summary(v_tracebacks(spark, sf))
    return t.select("log_id", "error_type", "message", "line", F.array_join("key_frames", " -> ").alias("key_frames"))
