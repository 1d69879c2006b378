"""Live training-log streams.

A directory of log files is read with ``readStream.text``; each new file is
one log (``log_id`` = file name). Arrival order is ``(ingest_ts, split
start, position in the task)``; the position is numbered in file order by a
``mapInArrow`` counter because streams reject ``monotonically_increasing_id``.

The transformations are plain DataFrame functions, so the batch queries run
the very same code on static tables. What needs state (the action gate, the
hang timer, latest metrics) is a ``StatefulProcessor`` per run or log on the
RocksDB state store: state variables, timers, and a time to live. Time is the
cluster's clock, or with ``event_time`` the rows' own, so that a replay of
stored files gives the same rows however they fall into micro-batches.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from kiln.operators import logs as L
from kiln.operators.telemetry import gate_actions
from kiln.sources.sinks import write_batch


def _number(batches):
    """Row position inside the task: the text reader emits a split's lines
    in file order, so a running counter over the task's batches orders them."""
    n = 0
    for batch in batches:
        places = pa.array(np.arange(n, n + len(batch)))
        n += len(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns, places], names=[*batch.schema.names, "pos"])


def stream_logs(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Lines as they arrive: ``log_id, line, ingest_ts`` and an arrival
    order key ``(ingest_ts, block, pos)`` (``pos``: file order inside the
    split, numbered per task with ``mapInArrow``; streams forbid
    ``monotonically_increasing_id``)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = r.load(path)
    x = df.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("log_id"),
                  F.col("_metadata.file_block_start").alias("block"),
                  F.col("value").alias("line"), F.current_timestamp().alias("ingest_ts"))
    return x.mapInArrow(_number, "log_id string, block long, line string, ingest_ts timestamp, pos long")


def stream_errors_transform(lines: DataFrame) -> DataFrame:
    """Error lines with type and severity (stateless, append mode)."""
    return L.classify_errors(lines)


def stream_metrics_transform(lines: DataFrame) -> DataFrame:
    """Metric lines (stateless, append mode)."""
    return L.parse_metrics(lines)


def latest_metrics_transform(metrics: DataFrame, order: str = "line_no") -> DataFrame:
    """Per log the latest parsed metric line (all its fields)."""
    last = F.max_by(F.struct("step", "loss", "eval_loss", "lr", "throughput"), order)
    return metrics.groupBy("log_id").agg(last.alias("_l")).select(
        "log_id", "_l.step", "_l.loss", "_l.eval_loss", "_l.lr", "_l.throughput")


def latest_metrics_stream(lines: DataFrame) -> DataFrame:
    """H11 on a stream: the latest metrics per log by arrival (update mode).
    Arrival order inside a micro-batch is the ingest time then the row id."""
    m = L.parse_metrics(lines)
    last = F.max_by(F.struct("step", "loss", "eval_loss", "lr", "throughput"), F.struct("ingest_ts", "block", "pos"))
    return m.groupBy("log_id").agg(last.alias("_l")).select(
        "log_id", "_l.step", "_l.loss", "_l.eval_loss", "_l.lr", "_l.throughput")


def notify_sink(path: str, query: str = "notifications"):
    """A ``foreachBatch`` callback that keeps each batch of ``query`` in a notification log exactly once:
    a batch that is retried replaces its own rows (``sinks.write_batch``)."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        write_batch(batch, path, query, epoch_id)
    return write


# ---------------------------------------------------------------- state

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str,
               output_mode: str = "Append") -> DataFrame:
    """``rows`` through ``processor``, one instance of its state per key; such processors need the RocksDB store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, output_mode, time_mode)


def _micros(times: pd.Series) -> np.ndarray:
    return pd.to_datetime(times).astype("datetime64[us]").astype("int64").to_numpy()


class _Timed(StatefulProcessor):
    """Keeps one timer a key, moved on with every row: by the rows' time (``event``), or by the clock."""

    def __init__(self, wait_s: float | None, event: bool):
        self.wait_s, self.event = wait_s, event

    def init(self, handle) -> None:
        self.handle = handle

    def _due(self, last_micros: int) -> int:
        """When the timer of the rows' time goes off."""
        return last_micros // 1000 + int(self.wait_s * 1000) + 1

    def _wait_from(self, last_micros: int, timer_values, known: bool = True) -> None:
        """``known``: whether the key may have a timer already."""
        if self.wait_s is None:
            return
        for t in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(t)
        now = last_micros if self.event else timer_values.getCurrentProcessingTimeInMs() * 1000
        self.handle.registerTimer(self._due(now))

    def close(self) -> None:
        pass


def _mode(wait_s: float | None, event: bool) -> str:
    return "none" if wait_s is None else "eventTime" if event else "processingTime"


# ---------------------------------------------------------------- H09 live

OUT_SCHEMA = "run_id string, ts timestamp, anomaly string, count long"


class _Gate(_Timed):
    """The counters of a run's anomalies and the time of its last action; a quiet run's state goes with its timer."""

    def init(self, handle) -> None:
        super().init(handle)
        self.counters = handle.getMapState("counters", "anomaly string", "n bigint")
        self.last = handle.getValueState("last_action", "at double")

    def handleInputRows(self, key, rows, timerValues):
        # the chunks of one run in a micro-batch are one sequence: ordered together
        polls = pd.concat([p for p in rows], ignore_index=True)
        counters = {k[0]: v[0] for k, v in self.counters.iterator()} if self.counters.exists() else {}
        out, (after, last) = gate_actions(polls, state=(counters, self.last.get()[0] if self.last.exists() else 0.0))
        for k in counters.keys() - after.keys():
            self.counters.removeKey((k,))
        for k, n in after.items():
            if counters.get(k) != n:
                self.counters.updateValue((k,), (n,))
        self.last.update((float(last),))
        self._wait_from(int(_micros(polls["ts"]).max()), timerValues)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.counters.clear()
        self.last.clear()
        return iter([])


def actions_stream(verdicts: DataFrame, retire_after_s: float | None = 86_400.0, event_time: bool = False) -> DataFrame:
    """H09 live: the action gate per run. Counters and last action survive
    micro-batches and restarts through the checkpoint, and go when a run is
    silent for ``retire_after_s`` seconds (None: never). A micro-batch holds a
    run's polls since the last one. Columns: run_id, ts, anomaly, in_grace;
    with ``event_time`` the caller sets the watermark on ``ts``."""
    return _processed(verdicts, "run_id", _Gate(retire_after_s, event_time), OUT_SCHEMA, _mode(retire_after_s, event_time))


# ---------------------------------------------------------------- H07 live

HANG_SCHEMA = "log_id string, last_seen timestamp, silent_s double, anomaly string"


class _Hang(_Timed):
    """The time of a log's last line, and whether its silence since is told already."""

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "seen bigint, told boolean")

    def _rows(self, key, seen, silent_s) -> pd.DataFrame:
        return pd.DataFrame({"log_id": [key[0]] * len(seen), "last_seen": np.asarray(seen).astype("datetime64[us]"),
                             "silent_s": np.asarray(silent_s, dtype=float), "anomaly": "hang_detected"})

    def handleInputRows(self, key, rows, timerValues):
        times = np.sort(np.concatenate([_micros(p["ts"]) for p in rows]))
        before = self.last.get()  # calls of the state store are what a log costs: as few as will do
        if before:
            seen, told = before
            times = times[times >= seen]
            line = np.concatenate([[seen], times])
        else:
            told, line = False, times
        if self.event:  # silences that lie between lines, unless a timer told the first
            gaps = np.diff(line)
            found = gaps > self.wait_s * 1e6
            if told and len(found):
                found[0] = False
            if found.any():
                yield self._rows(key, line[:-1][found], gaps[found] / 1e6)
        if len(times):
            self.last.update((int(line[-1]), False))
            if before and self.event:  # its one timer is that of its last line, and gone once told
                if not told:
                    self.handle.deleteTimer(self._due(seen))
                before = None
            self._wait_from(int(line[-1]), timerValues, known=before is not None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen, _ = self.last.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.event:
            self.last.update((seen, True))
        else:
            self.last.clear()
        yield self._rows(key, [seen], [now / 1000 - seen / 1e6])


def hang_stream(lines: DataFrame, hang_s: float = 300.0, event_time: str | None = None) -> DataFrame:
    """H07 live: one row per log and silence of more than ``hang_s`` seconds.
    By the clock (the default) a timer runs from a log's last line on; its
    state is one row per active log and goes when the timer fires. With
    ``event_time``, a column with a watermark, silences are those between the
    lines' own times, told once each, as soon as the watermark passes them."""
    event = event_time is not None
    rows = lines.select("log_id", F.col(event_time or "ingest_ts").alias("ts"))
    return _processed(rows, "log_id", _Hang(hang_s, event), HANG_SCHEMA, _mode(hang_s, event))


# ---------------------------------------------------------------- H11 with retirement

LATEST_SCHEMA = "log_id string, step long, loss double, eval_loss double, lr double, throughput double"
_FIELDS = ["step", "loss", "eval_loss", "lr", "throughput"]


class _Latest(StatefulProcessor):
    """The latest metric line of a log; with a time to live, that of an active log only."""

    def __init__(self, retire_s: float | None):
        self.retire_s = retire_s

    def init(self, handle) -> None:
        schema = "step bigint, loss double, eval_loss double, lr double, throughput double, at bigint, block bigint, pos bigint"
        self.best = handle.getValueState("latest", schema, *([int(self.retire_s * 1000)] if self.retire_s else []))

    def handleInputRows(self, key, rows, timerValues):
        best = self.best.get()
        for pdf in rows:
            places = [_micros(pdf["ingest_ts"]), pdf["block"].to_numpy(), pdf["pos"].to_numpy()]
            i = np.lexsort(places[::-1])[-1]
            place = tuple(int(c[i]) for c in places)
            if best is None or place >= tuple(best[5:]):
                values = [pdf[f].iat[i] for f in _FIELDS]
                best = tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in values) + place
        best = (None if best[0] is None else int(best[0]), *best[1:])
        self.best.update(tuple(best))
        yield pd.DataFrame({"log_id": [key[0]], "step": pd.array([best[0]], dtype="Int64"),
                            **{f: np.array([v], dtype=float) for f, v in zip(_FIELDS[1:], best[1:5])}})

    def close(self) -> None:
        pass


def latest_metrics_stream_retiring(lines: DataFrame, retire_after_s: float | None = 3600.0,
                                   output_mode: str = "Update") -> DataFrame:
    """H11 live with bounded state: the latest metric line of every log that a
    micro-batch has lines of (``output_mode``: that of the query it is in). The state of a log that is silent for
    ``retire_after_s`` seconds (by the clock; None: never) expires by its time
    to live, so state holds active logs only."""
    # a micro-batch is a few files, and so a few tasks; parsing its lines is the work, and goes to all
    spread = lines.repartition("log_id", "block", "pos")
    m = L.parse_metrics(spread).select("log_id", *_FIELDS, "ingest_ts", "block", "pos")
    return _processed(m, "log_id", _Latest(retire_after_s), LATEST_SCHEMA, _mode(retire_after_s, False), output_mode)


def run_available(df: DataFrame, sink_name: str, mode: str = "append", checkpoint: str | None = None,
                  timeout_s: float = 300) -> None:
    """Drive a stream over everything available now into a memory table
    (``availableNow`` trigger; used by tests and batch back-fills). Timers by
    the clock would keep such a query alive: it ends with the first batch that
    has no input, which comes when all input is taken."""
    w = df.writeStream.format("memory").queryName(sink_name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    deadline = time.time() + timeout_s
    while q.isActive and time.time() < deadline:
        q.awaitTermination(1)
        last = q.lastProgress
        if last and last["numInputRows"] == 0:
            break
    if q.isActive:
        q.stop()
    if q.exception():
        raise q.exception()
