"""GPU telemetry and health verdicts (H01-H12, batch side).

Samples: ``(ts, gpu, mem_total_mb, mem_used_mb, util, temp, ...)``.
Snapshots (one health poll): ``(run_id, ts, process_alive,
last_log_age_seconds, disk_used_pct, disk_free_gb, gpu_util array<double>,
gpu_mem_used_pct array<double>, gpu_temp array<double>)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NA = "[N/A]"
GPU_FIELDS = ["index", "name", "memory_total_mb", "memory_used_mb", "utilization_gpu", "utilization_memory",
              "temperature", "power_draw", "power_limit"]


def parse_gpu_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Comma-separated poll rows; fewer than 9 fields dropped, [N/A]
    numbers read as 0, a non-integer index drops the row."""
    parts = F.transform(F.split(F.col(line), ","), lambda p: F.trim(p))
    x = lines.withColumn("_p", parts).where(F.size("_p") >= 9)
    num = lambda i: F.when(F.col("_p")[i] == NA, F.lit(0.0)).otherwise(F.col("_p")[i].try_cast("double"))
    out = x.select("*", F.col("_p")[0].try_cast("int").alias("index"), F.col("_p")[1].alias("name"),
                   *[num(i).alias(GPU_FIELDS[i]) for i in range(2, 9)]).drop("_p")
    return out.where(F.col("index").isNotNull())


def mem_pct(total: Column, used: Column) -> Column:
    """Used / total * 100, 0 when total is 0."""
    return F.when(total > 0, used / total * 100).otherwise(F.lit(0.0))


def fleet_summary(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per poll: GPU count, total/used memory in GB, mean utilisation,
    max temperature."""
    by = by or ["ts"]
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("gpu_count"),
        (F.sum("mem_total_mb") / 1024).alias("total_memory_gb"),
        (F.sum("mem_used_mb") / 1024).alias("used_memory_gb"),
        F.avg("util").alias("avg_utilization"),
        F.max("temp").alias("max_temperature"))


def oom_risk(samples: DataFrame, threshold_pct: float = 95.0) -> DataFrame:
    """Samples whose memory use is above ``threshold_pct``."""
    return samples.where(mem_pct(F.col("mem_total_mb"), F.col("mem_used_mb")) > threshold_pct)


def thermal_risk(samples: DataFrame, threshold_c: float = 85.0) -> DataFrame:
    """Samples hotter than ``threshold_c`` (90 in the health check)."""
    return samples.where(F.col("temp") > threshold_c)


def _first_index(arr: Column, pred) -> Column:
    """0-based index of the first element satisfying ``pred`` (null if none)."""
    pos = F.array_position(F.transform(arr, lambda v: pred(v)), F.lit(True))
    return F.when(pos > 0, pos - 1)


def classify_health(snaps: DataFrame, run: str = "run_id", ts: str = "ts", grace_s: float = 30.0,
                    hang_s: float = 300.0, low_util_polls: int = 12) -> DataFrame:
    """The anomaly of each poll, in precedence order: start grace
    (none), process_dead, hang_detected, disk_full, disk_low,
    oom_risk_gpu<i>, thermal_risk_gpu<i>, low_gpu_utilization (all GPUs under
    5% for more than ``low_util_polls`` consecutive polls that reach that
    check; any other poll reaching it resets the count).

    The low-utilisation count is gaps-and-islands over each run's polls:
    count = low polls so far - low polls at the last reset, both exact
    running aggregates over time-ordered parts (``ordered_parts``, made once
    for both); polls of a run are assumed to have distinct timestamps."""
    from kiln.functions.ranking import PART, ordered_parts, prefix_sum
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    starts = snaps.groupBy(run).agg(F.min(t).alias("_start"))
    grace = t - F.col("_start") < grace_s
    mem_i = _first_index(F.coalesce(F.col("gpu_mem_used_pct"), F.array().cast("array<double>")), lambda v: v > 95)
    tmp_i = _first_index(F.coalesce(F.col("gpu_temp"), F.array().cast("array<double>")), lambda v: v > 90)
    early = (F.when(grace, F.lit("grace"))
              .when(~F.col("process_alive"), "process_dead")
              .when(F.col("last_log_age_seconds") > hang_s, "hang_detected")
              .when(F.col("disk_used_pct") > 95, "disk_full")
              .when((F.col("disk_free_gb") < 10) & (F.col("disk_free_gb") > 0), "disk_low")
              .when(mem_i.isNotNull(), F.concat(F.lit("oom_risk_gpu"), mem_i.cast("string")))
              .when(tmp_i.isNotNull(), F.concat(F.lit("thermal_risk_gpu"), tmp_i.cast("string"))))
    util = F.coalesce(F.col("gpu_util"), F.array().cast("array<double>"))
    low = (F.size(util) > 0) & F.forall(util, lambda u: u < 5.0)
    x = snaps.join(starts, run).withColumn("_early", early).withColumn("_reach", F.col("_early").isNull()) \
             .withColumn("_low", F.col("_reach") & low).withColumn("_t", t).drop("_start")
    # running counts per run, part by part (a run's polls are never sorted in one task)
    x = ordered_parts(x.withColumn("_li", F.col("_low").cast("int")), "_t", by=[run])
    x = prefix_sum(x, "_li", "_t", by=[run], out="_cum_low", parts=True)
    x = x.withColumn("_rv", F.when(F.col("_reach") & ~F.col("_low"), F.col("_cum_low")))
    x = prefix_sum(x, "_rv", "_t", by=[run], out="_base", op="max", parts=True) \
        .withColumn("_base", F.coalesce("_base", F.lit(0))).drop(PART)
    counter = F.col("_cum_low") - F.col("_base")
    anomaly = (F.when(F.col("_early") == "grace", F.lit(None).cast("string"))
                .when(F.col("_early").isNotNull(), F.col("_early"))
                .when(F.col("_low") & (counter > low_util_polls), "low_gpu_utilization"))
    return x.withColumn("low_util_count", F.when(F.col("_reach"), counter)).withColumn("anomaly", anomaly) \
            .drop("_early", "_reach", "_low", "_cum_low", "_base", "_li", "_rv", "_t")


def hang_from_logs(lines: DataFrame, log: str = "log_id", ts: str = "ts", hang_s: float = 300.0) -> DataFrame:
    """H07 (batch): gaps in a log's output longer than ``hang_s`` seconds:
    each line's time minus the previous line's (a bucketed ``lag``, so one
    huge log is not sorted in one task)."""
    from kiln.functions.ranking import bucketed_lag
    x = lines.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    x = bucketed_lag(x, "_t", "_t", [log], out="_prev")
    return x.withColumn("gap_s", F.col("_t") - F.col("_prev")).where(F.col("gap_s") > hang_s).drop("_t", "_prev")


ACTION_SCHEMA = "run_id string, ts timestamp, anomaly string, count long"


def gate_actions(pdf: pd.DataFrame, min_count: int = 2, cooldown_s: float = 300.0,
                 state: tuple | None = None) -> tuple[pd.DataFrame, tuple]:
    """H09 state machine over one run's polls in time order.

    Counters per anomaly grow by one per anomalous poll; a healthy poll
    clears them, process_dead clears them before counting itself. An action
    fires when the counter reaches ``min_count`` and ``cooldown_s`` passed
    since the last action. ``state`` = (counters dict, last action epoch s)."""
    counters, last = (dict(state[0]), state[1]) if state else ({}, 0.0)
    out = []
    for row in pdf.sort_values("ts").itertuples(index=False):
        a = row.anomaly
        t = pd.Timestamp(row.ts).timestamp()
        if a is None or (isinstance(a, float) and pd.isna(a)):
            if not row.in_grace:
                counters.clear()
            continue
        if a == "process_dead":
            counters.clear()
        counters[a] = counters.get(a, 0) + 1
        if counters[a] < min_count or t - last < cooldown_s:
            continue
        last = t
        out.append((row.run_id, row.ts, a, counters[a]))
    return pd.DataFrame(out, columns=["run_id", "ts", "anomaly", "count"]), (counters, last)


def actions(verdicts: DataFrame, run: str = "run_id", ts: str = "ts", min_count: int = 2,
            cooldown_s: float = 300.0, grace_s: float = 30.0) -> DataFrame:
    """H09 (batch): the polls at which an auto-action fires, per run; what
    ``gate_actions`` does poll by poll, over many tasks for one run.

    Counts are exact running aggregates over time-ordered parts: a healthy poll
    outside the start grace, or a dead process, begins a new span, and an
    anomaly's count is its rank in the span. What can fire is then a set of
    times, and actions are a chain through it: from an action to the first such
    poll a cooldown later. Each part of a run is a function from the last
    action before it to the last action in it. Only entries within a cooldown
    of the part's start can occur, so it is a short table, made in the task
    that holds the part; a fold over these tables gives each part its entry,
    and each part walks on from there. Polls of a run are assumed to have
    distinct timestamps."""
    from kiln.functions.ranking import PART, ordered_parts, prefix_sum
    v = verdicts.select(F.col(run).alias("run_id"), F.col(ts).cast("timestamp").alias("ts"), "anomaly")
    x = ordered_parts(v.withColumn("_t", F.unix_micros("ts")), "_t", by=["run_id"])
    starts = x.groupBy("run_id").agg(F.min("_t").alias("_start"))
    grace, cooldown = int(grace_s * 1_000_000), int(cooldown_s * 1_000_000)
    healthy = F.col("anomaly").isNull() & (F.col("_t") - F.col("_start") >= grace)
    resets = (healthy | (F.coalesce("anomaly", F.lit("")) == "process_dead")).cast("int")
    x = x.join(starts, "run_id").withColumns({"_reset": resets, "_one": F.lit(1)}).drop("_start")
    x = prefix_sum(x, "_reset", "_t", by=["run_id"], out="_span", parts=True).where(F.col("anomaly").isNotNull())
    x = prefix_sum(x, "_one", "_t", by=["run_id", "_span", "anomaly"], out="count", parts=True)
    may = x.where((F.col("count") >= min_count) & (F.col("_t") >= cooldown)).select("run_id", PART, "_t", "ts", "anomaly", "count")
    times = may.groupBy("run_id", PART).agg(F.sort_array(F.collect_list("_t")).alias("times"))
    tables = times.mapInPandas(_part_tables(cooldown), f"run_id string, {PART} int, entries array<bigint>, exits array<bigint>")
    entry = (tables.repartition("run_id").sortWithinPartitions("run_id", PART)
             .mapInPandas(_part_entries(cooldown), f"run_id string, {PART} int, _entry bigint"))
    walked = may.join(entry, ["run_id", PART]).repartition("run_id", PART).sortWithinPartitions("run_id", PART, "_t")
    return walked.select("run_id", PART, "_t", "_entry", "ts", "anomaly", F.col("count").cast("bigint").alias("count")).mapInPandas(
        _walk(cooldown), ACTION_SCHEMA)


def _part_tables(cooldown: int):
    """Times at which a part may fire -> for each entry that can occur, the last action of the chain from it."""
    def run(batches):
        for pdf in batches:
            entries, exits = [], []
            for times in pdf["times"]:
                t = np.asarray(times, dtype=np.int64)
                following = np.searchsorted(t, t + cooldown)
                last = np.where(following < len(t), following, np.arange(len(t)))
                while (last[last] != last).any():
                    last = last[last]
                n = np.searchsorted(t, t[0] + cooldown) + 1
                entries.append(t[:n])
                exits.append(t[last[:n]])
            yield pdf.drop(columns="times").assign(entries=entries, exits=exits)
    return run


def _part_entries(cooldown: int):
    """The tables of a run's parts in order -> the first action of every part that has one."""
    def run(batches):
        now, last = None, 0
        for pdf in batches:
            rows = []
            for run_id, part, entries, exits in pdf.itertuples(index=False):
                if now is None or now[0] != run_id:
                    now, last = (run_id,), 0
                i = np.searchsorted(entries, last + cooldown)
                if i < len(entries):
                    rows.append((run_id, part, entries[i]))
                    last = int(exits[i])
            yield pd.DataFrame(rows, columns=[*pdf.columns[:2], "_entry"])
    return run


def _walk(cooldown: int):
    """The polls of a part that fire: its entry, then each first one a cooldown after the one before."""
    def run(batches):
        now, due = None, 0
        for pdf in batches:
            fired = []
            for key, polls in pdf.groupby(list(pdf.columns[:2]), sort=False, dropna=False):
                t = polls["_t"].to_numpy()
                if now != key:
                    now, due = key, int(polls["_entry"].iloc[0])
                while (i := np.searchsorted(t, due)) < len(t):
                    fired.append(polls.index[i])
                    due = int(t[i]) + cooldown
            yield pdf.loc[fired, ["run_id", "ts", "anomaly", "count"]]
    return run


# Notification texts per anomaly (first key contained wins).
HEALTH_MESSAGES = [
    ("process_dead", "Training process died unexpectedly!"),
    ("hang_detected", "Training hung >%.0fs — watchdog will kill"),
    ("low_gpu_utilization", "GPU utilization sustained <5%%."),
    ("disk_full", "Disk usage >95%%!%s"),
    ("disk_low", "Disk low: %.1fGB free%s"),
    ("process_killed_by_watchdog", "Training process killed by watchdog (hung)."),
]


def notifications(verdicts: DataFrame) -> DataFrame:
    """Anomaly polls -> (level, message) rows for the notification log."""
    a = F.coalesce(F.col("anomaly"), F.lit(""))
    disk = F.when(F.col("disk_free_gb") > 0, F.format_string(" disk_free=%.1fGB", F.col("disk_free_gb"))).otherwise("")
    msg = F.lit(None).cast("string")
    for key, text in reversed(HEALTH_MESSAGES):
        if key == "hang_detected":
            m = F.format_string(text, F.col("last_log_age_seconds"))
        elif key == "disk_full":
            m = F.format_string(text, disk)
        elif key == "disk_low":
            m = F.format_string(text, F.col("disk_free_gb"), disk)
        else:
            m = F.format_string(text)
        msg = F.when(a.contains(key), m).otherwise(msg)
    return verdicts.where(F.col("anomaly").isNotNull()).select("*", F.lit("WARN").alias("level"),
                                                               msg.alias("message")).where(F.col("message").isNotNull())


# What the action handler reports (first key contained wins).
ACTION_MESSAGES = [
    ("hang_detected", "ACTION", "Watchdog auto-killing hung training process"),
    ("oom_risk", "WARN", "GPU OOM risk: %s"),
    ("disk_full", "CRITICAL", "Disk space critical: %.1fGB free"),
    ("disk_low", "CRITICAL", "Disk space critical: %.1fGB free"),
]


def action_notifications(fired: DataFrame) -> DataFrame:
    """Polls at which an action fires (``anomaly``, ``disk_free_gb``) ->
    (level, message) rows; anomalies without an action are dropped."""
    a = F.coalesce(F.col("anomaly"), F.lit(""))
    level = msg = F.lit(None).cast("string")
    for key, lvl, text in reversed(ACTION_MESSAGES):
        m = F.format_string(text, F.col("disk_free_gb") if lvl == "CRITICAL" else a) if "%" in text else F.lit(text)
        level, msg = F.when(a.contains(key), lvl).otherwise(level), F.when(a.contains(key), m).otherwise(msg)
    return fired.select("*", level.alias("level"), msg.alias("message")).where(F.col("level").isNotNull())
