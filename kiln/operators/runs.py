"""Run, phase-event, experiment and checkpoint tables.

Tables: runs ``(run_id, created_at, updated_at, current_phase)``, phase
events ``(id, run_id, phase, status, ts)``, experiments ``(id, run_id, seq,
phase, status, ...)``, checkpoints ``(run_id, experiment_id, path, step,
loss)``. Per-run results are ``groupBy`` aggregates (``max_by`` for "latest");
top-k per group uses ``row_number() <= k`` which Spark plans as a
``WindowGroupLimit`` (a partial top-k before the shuffle, so a huge group
sends at most k rows per map task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.ranking import ordered_rank

N_PHASES = 7


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the latest ``updated_at`` (ties: larger run_id)."""
    return runs.orderBy(F.col("updated_at").desc(), F.col("run_id").desc()).limit(1)


def phase_events(events: DataFrame) -> DataFrame:
    """Each run's events numbered in id order (``seq``)."""
    return ordered_rank(events, "id", by=["run_id"], rank_col="seq")


def phase_state(events: DataFrame, runs: DataFrame, n_phases: int = N_PHASES) -> DataFrame:
    """Per (run, phase) the latest event's status (by id), 'pending'
    when the phase has no event; ``completed`` flag."""
    last = events.groupBy("run_id", "phase").agg(F.max_by(F.struct("status", "ts"), "id").alias("_l"))
    grid = runs.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(n_phases - 1))).alias("phase"))
    j = grid.join(last, ["run_id", "phase"], "left")
    status = F.coalesce(F.col("_l.status"), F.lit("pending"))
    return j.select("run_id", "phase", status.alias("status"), F.col("_l.ts").alias("ts"),
                    (status == "completed").alias("completed"))


def progress(events: DataFrame, runs: DataFrame, n_phases: int = N_PHASES) -> DataFrame:
    """Distinct phases with any completed event; percent of 7, half-even
    to one decimal."""
    c = (events.where(F.col("status") == "completed").groupBy("run_id")
               .agg(F.count_distinct("phase").alias("completed_phases")))
    j = runs.select("run_id").join(c, "run_id", "left").fillna(0, ["completed_phases"])
    return j.select("run_id", F.col("completed_phases").cast("bigint").alias("completed_phases"),
                    F.lit(n_phases).alias("total_phases"),
                    F.bround(F.col("completed_phases") / n_phases * 100, 1).alias("progress_pct"))


def experiments(exps: DataFrame, json_cols: dict[str, str] | None = None, phase: str | None = None) -> DataFrame:
    """Experiments of a run (optionally one phase) with JSON text
    columns parsed by the given schemas."""
    x = exps if phase is None else exps.where(F.col("phase") == phase)
    for c, schema in (json_cols or {}).items():
        x = x.withColumn(c, F.from_json(F.col(c), schema))
    return x


def queue_status(exps: DataFrame, phase: str = "phase") -> DataFrame:
    """Totals per phase and overall (the rollup row has phase null):
    total, completed, failed, pending, running."""
    return exps.rollup(phase).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "running").alias("running"))


def next_pending(exps: DataFrame, seq: str = "seq") -> DataFrame:
    """The first pending experiment in insert order."""
    return exps.where(F.col("status") == "pending").agg(F.min_by("id", seq).alias("id"), F.min(seq).alias(seq))


def latest_checkpoint(ckpts: DataFrame, by: list[str]) -> DataFrame:
    """Latest checkpoint per group by step."""
    return ckpts.groupBy(*by).agg(F.max_by(F.struct("path", "step", "loss"), "step").alias("_c")).select(
        *by, "_c.path", "_c.step", "_c.loss")


def checkpoint_step(path: Column) -> Column:
    """N of a ``checkpoint-N`` directory name (last path segment);
    null when the name does not start with ``checkpoint-`` or N is no int."""
    name = F.element_at(F.split(path, "/"), -1)
    part = F.element_at(F.split(name, "-"), 2)
    return F.when(name.startswith("checkpoint-"), part.try_cast("bigint"))


def latest_checkpoint_from_paths(paths: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """The ``checkpoint-N`` path with the largest N per group."""
    x = paths.withColumn("_s", checkpoint_step(F.col(path))).where(F.col("_s").isNotNull())
    return x.groupBy(*by).agg(F.max_by(path, "_s").alias("latest"), F.max("_s").alias("step"))


def checkpoints_to_drop(ckpts: DataFrame, by: list[str], keep_best: int = 1, keep_last: int = 1,
                        loss: str = "loss") -> DataFrame:
    """Keep the last ``keep_last`` by step and the best ``keep_best``
    by loss (ties by step); groups with at most keep_best + keep_last
    checkpoints keep all. Returns the checkpoints to delete.

    The kept sets are per-group top-k (WindowGroupLimit); the drop list is an
    anti join against them, so no group is ever sorted whole."""
    x = ckpts.withColumn("_s", checkpoint_step(F.col("path"))).where(F.col("_s").isNotNull())
    n = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    last = x.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_s").desc()))) \
            .where(F.col("_r") <= keep_last).select(*by, "_s")
    kept = last
    if keep_best > 0:
        best = x.where(F.col(loss).isNotNull()).withColumn(
            "_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(loss), F.col("_s")))) \
            .where(F.col("_r") <= keep_best).select(*by, "_s")
        kept = kept.unionByName(best)
    cand = x.join(n.where(F.col("_n") > keep_best + keep_last), by)
    return cand.join(kept, [*by, "_s"], "left_anti").drop("_s", "_n")


def phase_checkpoints_to_drop(ckpts: DataFrame, exps: DataFrame, phase_col: str = "phase",
                              phase: str | None = None) -> DataFrame:
    """Checkpoints of completed experiments (of one phase): left semi join."""
    done = exps.where(F.col("status") == "completed")
    if phase is not None:
        done = done.where(F.col(phase_col) == phase)
    return ckpts.join(done.select(F.col("id").alias("experiment_id"), "run_id"),
                      ["run_id", "experiment_id"], "left_semi")


def snapshot(runs: DataFrame, events: DataFrame, exps: DataFrame, n_phases: int = N_PHASES) -> DataFrame:
    """One row per run: the run, its event and experiment counts, the
    latest event and the progress (per-run aggregates joined on run_id)."""
    ev = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"),
                                      F.max_by(F.struct("phase", "status"), "id").alias("last_event"))
    ex = exps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_experiments"),
                                    F.count_if(F.col("status") == "completed").alias("n_completed"))
    pr = progress(events, runs, n_phases).select("run_id", "progress_pct")
    return (runs.join(ev, "run_id", "left").join(ex, "run_id", "left").join(pr, "run_id", "left"))


def status_table(exps: DataFrame, n: int = 20, seq: str = "seq") -> DataFrame:
    """The last ``n`` experiments (ordered top-k)."""
    return exps.orderBy(F.col(seq).desc()).limit(n)


def report(exps: DataFrame, seq: str = "seq") -> DataFrame:
    """Totals and the best experiment by eval_loss."""
    return exps.agg(F.count(F.lit(1)).alias("total"),
                    F.count_if(F.col("status") == "completed").alias("completed"),
                    F.count_if(F.col("status") == "failed").alias("failed"),
                    F.min_by("id", F.when(F.col("eval_loss").isNotNull(), F.struct(F.col("eval_loss"), F.col(seq))))
                     .alias("best_id"),
                    F.min("eval_loss").alias("best_eval_loss"))


def config_diff(base: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Keys of ``new`` (``section, key, value``) that are new or whose
    value differs from ``base`` (left join + IS DISTINCT FROM)."""
    keys = [*(by or []), "section", "key"]
    j = new.alias("n").join(base.alias("b"), keys, "left")
    return j.where(~F.col("n.value").eqNullSafe(F.col("b.value")) | F.col("b.value").isNull()).select(
        *keys, F.col("n.value").alias("value"), F.col("b.value").alias("base_value"))


def phases_by_status(state: DataFrame, statuses: tuple[str, ...] = ("pending", "failed")) -> DataFrame:
    """Phases of each run whose latest state is in ``statuses``."""
    return state.where(F.col("status").isin(*statuses)).select("run_id", "phase", "status")


def results(final: DataFrame, errors: DataFrame, hist: DataFrame, status: DataFrame, log: str = "log_id") -> DataFrame:
    """One training-result row per log: final metrics, error count,
    history length and status."""
    e = errors.groupBy(log).agg(F.count(F.lit(1)).alias("n_errors"))
    h = hist.groupBy(log).agg(F.count(F.lit(1)).alias("history_len"))
    return (final.join(status.select(log, "status"), log, "left").join(e, log, "left").join(h, log, "left")
                 .fillna(0, ["n_errors", "history_len"]))
