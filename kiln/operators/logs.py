"""Training-log analytics.

Input is a line table ``(log_id, line_no, line)`` (``sources.read_logs``
produces it from text files). Extraction is ``regexp_extract`` projections;
per-log results are aggregations keyed by ``log_id``.

Scale: whole logs are read by default; ``tail``, ``header``, ``max_line`` and
the like are optional. "Last k lines of a log" is a per-log top-k
(``WindowGroupLimit``): each task forwards at most k lines of a log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.text import ustrip

# Metric patterns (Java syntax; (?U) gives Python's Unicode
# \d \s \w classes).
STEP_RE = r"(?U)global_step[:\s]+(\d+)"
LOSS_RE = r"(?U)loss[:\s]+(\d+\.\d+)"
LR_RE = r"(?U)(?:learning_rate|lr)[:\s]+([\d.eE+-]+)"
MEM_RE = r"(?U)(?:allocated_memory|memory)[:\s]+([\d.]+)\s*MB"
SPEED_RE = r"(?U)(?:throughput|speed)[:\s]+([\d.]+)\s*tokens/s"
EVAL_RE = r"(?U)eval[_\s].*?loss[:\s]+(\d+\.\d+)"
EPOCH_RE = r"(?U)epoch[:\s]+(\d+)"
GRAD_NORM_RE = r"(?U)grad_norm[=:]\s*([\d.]+(?:[eE][+-]?\d+)?)"
EVAL_KV_RE = r"(?U)eval_(\w+)[:\s]+([\d.eE+-]+)"
NAN_LOSS_RE = r"(?iU)loss[:\s]+(?:nan|inf)"
MAX_STEPS_RE = r"(?U)Total optimization steps\s*=\s*([\d,]+)"

# Error patterns, in precedence order.
OOM_RES = [r"(?iU)(?:CUDA|GPU)\s*(?:out\s*of\s*memory|OOM)", r"(?i)ResourceExhaustedError"]
FATAL_RE = r"(?i)(?:FATAL|Fatal error|CRITICAL)"
NAN_RE = r"(?i)loss.*(?:NaN|nan|inf)"
NCCL_RE = r"(?i)NCCL.*(?:error|timeout|abort)"
ERROR_RE = r"(?U)(?:^|\s)ERROR"
WARNING_RE = r"(?iU)(?:^|\s)WARNING"
WARNING_NOISE_RE = r"NCCL|LAUNCH|RAS"


def _ext(line: Column, pattern: str) -> Column:
    """First match's group 1, or null."""
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def _num(line: Column, pattern: str) -> Column:
    return _ext(line, pattern).try_cast("double")


def _int(line: Column, pattern: str) -> Column:
    return _ext(line, pattern).try_cast("bigint")


def parse_metrics(lines: DataFrame, line: str = "line", keep_empty: bool = False) -> DataFrame:
    """Per line step, loss, lr, memory_mb, throughput, eval_loss,
    epoch, grad_norm, eval_ppl, ``extra`` (map eval_<key> -> value, last wins)
    and has_nan. Lines yielding none of step/loss/eval_loss/extra/has_nan are
    dropped (``keep_empty`` keeps them)."""
    x = lines.withColumn("_s", ustrip(F.col(line)))
    if not keep_empty:  # cheap test first: every kept line holds one of these words
        low = F.lower(F.col("_s"))
        x = x.where(low.contains("loss") | F.col("_s").contains("global_step") | F.col("_s").contains("eval_"))
    # one pass over the eval_<key> pairs; only lines that have one
    pairs = F.when(F.col("_s").contains("eval_"), F.regexp_extract_all("_s", F.lit(EVAL_KV_RE), 0)).otherwise(
        F.array().cast("array<string>"))
    kv = F.transform(pairs, lambda e: F.struct(F.regexp_extract(e, EVAL_KV_RE, 1).alias("k"),
                                               F.regexp_extract(e, EVAL_KV_RE, 2).try_cast("double").alias("v")))
    x = x.withColumn("_kv", F.filter(kv, lambda e: e["v"].isNotNull()))
    kv_loss = F.filter("_kv", lambda e: e["k"] == "loss")
    kv_ppl = F.filter("_kv", lambda e: e["k"] == "ppl")
    others = F.filter("_kv", lambda e: ~e["k"].isin("loss", "ppl"))
    keys = F.array_distinct(F.transform(others, lambda e: F.concat(F.lit("eval_"), e["k"])))
    last_val = lambda k: F.element_at(F.filter(others, lambda e: F.concat(F.lit("eval_"), e["k"]) == k), -1)["v"]
    x = (x.withColumn("step", _int(F.col("_s"), STEP_RE))
          .withColumn("loss", _num(F.col("_s"), LOSS_RE))
          .withColumn("lr", _num(F.col("_s"), LR_RE))
          .withColumn("memory_mb", _num(F.col("_s"), MEM_RE))
          .withColumn("throughput", _num(F.col("_s"), SPEED_RE))
          .withColumn("eval_loss", F.coalesce(_num(F.col("_s"), EVAL_RE),
                                              F.when(F.size(kv_loss) > 0, kv_loss[0]["v"])))
          .withColumn("epoch", _int(F.col("_s"), EPOCH_RE))
          .withColumn("grad_norm", _num(F.col("_s"), GRAD_NORM_RE))
          .withColumn("eval_ppl", F.when(F.size(kv_ppl) > 0, F.element_at(kv_ppl, -1)["v"]))
          .withColumn("extra", F.map_from_arrays(keys, F.transform(keys, last_val)))
          .withColumn("has_nan", F.col("_s").rlike(NAN_LOSS_RE))
          .drop("_kv"))
    if not keep_empty:
        x = x.where((F.col("_s") != "") & (F.col("step").isNotNull() | F.col("loss").isNotNull()
                                            | F.col("eval_loss").isNotNull() | (F.size("extra") > 0)
                                            | F.col("has_nan")))
    return x.drop("_s")


def error_type(line: Column) -> Column:
    """OOM > FATAL > NaN > NCCL > ERROR > WARNING (noise excluded)."""
    return (F.when(line.rlike(OOM_RES[0]) | line.rlike(OOM_RES[1]), "OOM")
             .when(line.rlike(FATAL_RE), "FATAL")
             .when(line.rlike(NAN_RE), "NaN")
             .when(line.rlike(NCCL_RE), "NCCL")
             .when(line.rlike(ERROR_RE), "ERROR")
             .when(line.rlike(WARNING_RE) & ~line.rlike(WARNING_NOISE_RE), "WARNING"))


def severity_of(etype: Column) -> Column:
    """fatal for OOM/FATAL, warning for WARNING, else error."""
    return (F.when(etype.isin("OOM", "FATAL"), "fatal").when(etype == "WARNING", "warning")
             .when(etype.isNotNull(), "error"))


def classify_errors(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with an error type, ``severity`` and stripped ``message``."""
    t = error_type(F.col(line))
    return (lines.withColumn("error_type", t).where(F.col("error_type").isNotNull())
                 .withColumn("severity", severity_of(F.col("error_type")))
                 .withColumn("message", ustrip(F.col(line))))


def _tail(lines: DataFrame, k: int, log: str, pos: str) -> DataFrame:
    """The last ``k`` lines of each log."""
    w = Window.partitionBy(log).orderBy(F.col(pos).desc())
    return lines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def final_metrics(lines: DataFrame, log: str = "log_id", pos: str = "line_no", line: str = "line",
                  tail: int | None = None, header: int | None = None) -> DataFrame:
    """Per log max_steps (first header match, commas dropped, 0 if none;
    ``header``: in that many first lines only), and from its metrics
    (``tail``: of that many last lines only): final_loss (a trailing summary loss without step wins,
    else the loss of the last line with a step), final_step, final_eval_loss
    and throughput of the last metric line, eval-loss count and best."""
    first = lines if header is None else lines.where(F.col(pos) <= header)
    hdr = (first.where(F.col(line).contains("Total optimization steps") & F.col(line).rlike(MAX_STEPS_RE))
                .groupBy(log).agg(F.min_by(F.regexp_replace(F.regexp_extract(line, MAX_STEPS_RE, 1), ",", "")
                                           .try_cast("bigint"), F.col(pos)).alias("max_steps")))
    m = parse_metrics(lines if tail is None else _tail(lines, tail, log, pos), line)
    o = F.col(pos)
    agg = m.groupBy(log).agg(
        F.max_by(F.struct("loss", "step", "eval_loss", "throughput"), o).alias("last"),
        F.max_by(F.struct("step", "loss"), F.when(F.col("step").isNotNull(), o)).alias("lws"),
        F.count("eval_loss").cast("bigint").alias("n_eval_losses"),
        F.min("eval_loss").alias("best_eval_loss"))
    out = agg.join(hdr, log, "left")
    final_loss = (F.when(F.col("last.loss").isNotNull() & F.col("last.step").isNull(), F.col("last.loss"))
                   .when(F.col("lws.loss").isNotNull(), F.col("lws.loss")))
    return out.select(log, F.coalesce("max_steps", F.lit(0)).cast("bigint").alias("max_steps"),
                      final_loss.alias("final_loss"), F.col("lws.step").alias("final_step"),
                      F.col("last.eval_loss").alias("final_eval_loss"), F.col("last.throughput").alias("throughput"),
                      "n_eval_losses", "best_eval_loss")


def eval_losses(lines: DataFrame, log: str = "log_id", pos: str = "line_no", line: str = "line") -> DataFrame:
    """The eval losses of each log, one row each (``pos`` gives their order)."""
    return parse_metrics(lines, line).where(F.col("eval_loss").isNotNull()).select(log, pos, "eval_loss")


def error_summary(lines: DataFrame, log: str = "log_id", pos: str = "line_no", line: str = "line",
                  max_line: int | None = None, max_chars: int | None = None) -> DataFrame:
    """error/fatal lines (``max_line``: among that many first lines
    only) with their whole message (``max_chars``: its first characters)."""
    e = classify_errors(lines if max_line is None else lines.where(F.col(pos) <= max_line), line)
    message = F.col("message") if max_chars is None else F.substring("message", 1, max_chars)
    return e.where(F.col("severity").isin("error", "fatal")).select(
        log, F.col(pos).alias("line_num"), "error_type", message.alias("message"), "severity")


def history(metrics: DataFrame, log: str = "log_id", pos: str = "line_no", zero_fill: bool = True) -> DataFrame:
    """One row per metric line with a step; missing values are 0.0 when
    ``zero_fill`` (as the run history stores them) else null."""
    z = (lambda c: F.coalesce(F.col(c), F.lit(0.0))) if zero_fill else F.col
    return metrics.where(F.col("step").isNotNull()).select(
        log, pos, "step", z("loss").alias("train_loss"), z("eval_loss").alias("eval_loss"), z("lr").alias("lr"))


# Patterns of the eval output.
EVAL_OUT_RES = {
    "eval_loss": r"(?iU)eval[_\s].*?loss[:\s]+(\d+\.?\d*)",
    "eval_accuracy": r"(?iU)(?:eval[_\s].*?accuracy|acc)[:\s]+(\d+\.?\d*)",
    "eval_perplexity": r"(?iU)eval[_\s].*?perplexity[:\s]+(\d+\.?\d*)",
}


def parse_eval_output(lines: DataFrame, log: str = "log_id", pos: str = "line_no", line: str = "line") -> DataFrame:
    """First match of each eval metric in a log's output."""
    aggs = [F.min_by(_ext(F.col(line), p).try_cast("double"),
                     F.when(F.col(line).rlike(p), F.col(pos))).alias(k) for k, p in EVAL_OUT_RES.items()]
    return lines.groupBy(log).agg(*aggs)


# The key-line patterns of the log skeleton.
KEY_LINE_RES = [
    r"loss[:\s]+\d+\.?\d*", r"global_step[:\s]+\d+", r"OOM|OutOfMemory|out of memory", r"NaN|nan|NAN",
    r"NCCL|nccl", r"[Cc]heckpoint saved", r"eval[_\s].*loss", r"ERROR|FATAL|Traceback",
    r"throughput[:\s]+[\d.]+\s*tokens/s", r"learning_rate[:\s]+[\d.e-]+",
]
KEY_LINE_RE = "(?iU)" + "|".join(f"(?:{p})" for p in KEY_LINE_RES)


def is_key_line(c) -> Column:
    """L10."""
    x = F.col(c) if isinstance(c, str) else c
    return x.rlike(KEY_LINE_RE)


def skeleton(lines: DataFrame, max_lines: int = 100, log: str = "log_id", pos: str = "line_no",
             line: str = "line", edge: int = 5) -> DataFrame:
    """Logs longer than ``max_lines``: first/last ``edge`` lines plus key
    lines, de-duplicated by text in that order; over ``max_lines`` the middle
    is replaced by one marker row. Columns ``log_id, seq, line``.

    Of the lines that are neither key lines nor among the first, only the last
    ``max_lines`` of a log can be in its skeleton, and of lines with one text
    the first ``max_lines``: a per-group top-k keeps these where the log is
    read (``WindowGroupLimit``), and only they meet the log's length.
    De-duplication is a ``groupBy(log, text)`` (partially aggregated); the
    final head/tail cut is a per-log top-k again."""
    half = max_lines // 2
    n = lines.groupBy(log).agg(F.count(F.lit(1)).alias("_n"), F.max(pos).alias("_last"))
    rest = (F.col(pos) > edge) & ~is_key_line(F.col(line))
    group = Window.partitionBy(log, F.when(~rest, F.col(line))).orderBy(F.when(rest, -F.col(pos)).otherwise(F.col(pos)))
    kept = lines.withColumn("_r", F.row_number().over(group)).where(F.col("_r") <= max(max_lines, edge)).drop("_r")
    from kiln.session import scratch_path
    path = scratch_path(lines.sparkSession, "log-kept")
    x = kept.join(n, log)
    x.write.parquet(path)  # what follows reads it several times, and the whole logs no more
    x = lines.sparkSession.read.schema(x.schema).parquet(path)
    short = x.where(F.col("_n") <= max_lines).select(log, F.col(pos).cast("double").alias("seq"), line)
    seg = (F.when(F.col(pos) <= edge, 0).when(is_key_line(F.col(line)), 1)
            .when(F.col(pos) > F.col("_last") - edge, 2))
    cand = x.where(F.col("_n") > max_lines).withColumn("_seg", seg).where(F.col("_seg").isNotNull())
    first = cand.groupBy(log, line).agg(F.min(F.struct("_seg", pos)).alias("_k"))
    cnt = first.groupBy(log).agg(F.count(F.lit(1)).alias("_m"))
    asc = Window.partitionBy(log).orderBy("_k")
    desc = Window.partitionBy(log).orderBy(F.col("_k").desc())
    # de-duplicated lists of at most max_lines: all of them, in order
    fits = (first.join(cnt.where(F.col("_m") <= max_lines), log)
                 .select(log, F.row_number().over(asc).cast("double").alias("seq"), line))
    # longer lists: per-log top-k from each end (WindowGroupLimit: each map
    # task forwards at most ``half`` rows per log)
    big = cnt.where(F.col("_m") > max_lines)
    head = (first.withColumn("_r", F.row_number().over(asc)).where(F.col("_r") <= half)
                 .join(big, log).select(log, F.col("_r").cast("double").alias("seq"), line))
    tail = (first.withColumn("_r", F.row_number().over(desc)).where(F.col("_r") <= half)
                 .join(big, log).select(log, (F.col("_m") - F.col("_r") + 2).cast("double").alias("seq"), line))
    body = fits.unionByName(head).unionByName(tail)
    marker = big.select(log, F.lit(float(half) + 1).alias("seq"), F.lit("...[truncated]...").alias(line))
    return short.unionByName(body).unionByName(marker)


# Patterns of the trend summary.
TREND_RES = {
    "loss": r"(?iU)loss[:\s]+(\d+\.?\d*)",
    "step": r"(?iU)global_step[:\s]+(\d+)",
    "lr": r"(?iU)learning_rate[:\s]+([\d.e-]+)",
    "eval": r"(?iU)eval[_\s].*?loss[:\s]+(\d+\.?\d*)",
}


def log_trend(lines: DataFrame, log: str = "log_id", pos: str = "line_no", line: str = "line",
              last_losses: int = 20) -> DataFrame:
    """Latest loss, step, lr, eval loss; trend "decreasing" when the
    last loss is below the first; overfit gap = last eval - last loss; and,
    as a report, the ``last_losses`` last losses (a per-log top-k on the loss
    lines; every other column reads the whole log)."""
    x = lines.select(log, pos, *[_ext(F.col(line), p).alias(k) for k, p in TREND_RES.items()])
    x = (x.withColumn("loss", F.col("loss").try_cast("double")).withColumn("step", F.col("step").try_cast("bigint"))
          .withColumn("lr", F.col("lr").try_cast("double")).withColumn("eval", F.col("eval").try_cast("double")))
    o = lambda c: F.when(F.col(c).isNotNull(), F.col(pos))
    agg = x.groupBy(log).agg(
        F.min_by("loss", o("loss")).alias("first_loss"), F.max_by("loss", o("loss")).alias("latest_loss"),
        F.max_by("step", o("step")).alias("latest_step"), F.max_by("lr", o("lr")).alias("latest_lr"),
        F.max_by("eval", o("eval")).alias("latest_eval_loss"), F.count("loss").alias("n_losses"))
    w = Window.partitionBy(log).orderBy(F.col(pos).desc())
    lastk = (x.where(F.col("loss").isNotNull()).withColumn("_r", F.row_number().over(w))
              .where(F.col("_r") <= last_losses)
              .groupBy(log).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "loss"))).alias("_l")))
    out = agg.join(lastk, log, "left")
    return out.select(
        log, "latest_loss",
        F.when(F.col("latest_loss").isNotNull(),
               F.when(F.col("latest_loss") < F.col("first_loss"), "decreasing").otherwise("increasing")).alias("loss_trend"),
        F.transform("_l", lambda e: e["loss"]).alias("loss_values"),
        "latest_step", "latest_lr", "latest_eval_loss",
        F.when(F.col("latest_loss").isNotNull(), F.col("latest_eval_loss") - F.col("latest_loss")).alias("overfit_gap"))


# Traceback patterns.
TB_ERROR_RE = r"(?U)^(\w+(?:Error|Exception)):\s*(.+)$"
TB_FRAME_RE = r'^File "([^"]+)", line (\d+), in (\S+)'


def traceback_summary(lines: DataFrame, tb: str = "log_id", pos: str = "line_no", line: str = "line",
                      frames: int = 3) -> DataFrame:
    """Walking a traceback from the end (lines starting with Traceback or
    "..." skipped), stop at the ``frames``-th frame line; the error type and
    message come from the earliest ``Name(Error|Exception): msg`` line seen
    before stopping; frames are listed most recent first."""
    s = ustrip(F.col(line))
    x = (lines.select(tb, pos, s.alias("_s"))
              .where(~(F.col("_s").startswith("Traceback") | F.col("_s").startswith("...")))
              .withColumn("_is_err", F.col("_s").rlike(TB_ERROR_RE))
              .withColumn("_is_frame", ~F.col("_is_err") & (F.regexp_extract("_s", TB_FRAME_RE, 0) != "")))
    fr = x.where("_is_frame")
    w = Window.partitionBy(tb).orderBy(F.col(pos).desc())
    topf = fr.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= frames)
    stop = topf.groupBy(tb).agg(F.max(F.when(F.col("_r") == frames, F.col(pos))).alias("_stop"),
                                F.array_sort(F.collect_list(F.struct(
                                    F.col("_r"), F.format_string("%s (%s:%s)", F.regexp_extract("_s", TB_FRAME_RE, 3),
                                                                 F.regexp_extract("_s", TB_FRAME_RE, 1),
                                                                 F.regexp_extract("_s", TB_FRAME_RE, 2)).alias("f"),
                                    F.regexp_extract("_s", TB_FRAME_RE, 1).alias("file"),
                                    F.regexp_extract("_s", TB_FRAME_RE, 2).alias("ln")))).alias("_fr"))
    ids = lines.select(tb).distinct()
    errs = x.where("_is_err").join(stop, tb, "left").where(F.col("_stop").isNull() | (F.col(pos) > F.col("_stop")))
    err = errs.groupBy(tb).agg(F.min_by(F.struct(F.regexp_extract("_s", TB_ERROR_RE, 1).alias("t"),
                                                 F.regexp_extract("_s", TB_ERROR_RE, 2).alias("m")), F.col(pos)).alias("_e"))
    out = ids.join(stop, tb, "left").join(err, tb, "left")
    etype = F.coalesce(F.col("_e.t"), F.lit("UnknownError"))
    msg = F.coalesce(F.col("_e.m"), F.lit(""))
    return out.select(tb, etype.alias("error_type"), msg.alias("message"),
                      F.coalesce(F.element_at("_fr", -1)["file"], F.lit("")).alias("file"),
                      F.coalesce(F.element_at("_fr", -1)["ln"], F.lit("")).alias("line"),
                      F.coalesce(F.transform("_fr", lambda e: e["f"]), F.array().cast("array<string>")).alias("key_frames"))


def summarize_log(lines: DataFrame, log: str = "log_id", pos: str = "line_no", line: str = "line",
                  max_chars: int | None = None, edge_chars: int = 50_000, max_lines: int = 200) -> DataFrame:
    """The skeleton (L11) of the whole log. With ``max_chars`` a longer
    log is first cut to its first and last ``edge_chars`` characters
    (mid-line, as a byte read does) around a "...[file truncated]..." line.
    Character offsets are exact running sums per log (``prefix_sum``, never
    one task per log) of the line lengths, joined back by position."""
    if max_chars is None:
        return skeleton(lines, max_lines, log, pos, line)
    from kiln.functions.ranking import prefix_sum
    offsets = prefix_sum(lines.select(log, pos, (F.char_length(line) + 1).alias("_len")), "_len", pos, by=[log], out="_end")
    offsets = offsets.withColumn("_start", F.col("_end") - F.col("_len"))
    tot = offsets.groupBy(log).agg(F.max("_end").alias("_tot"))
    x = lines.select(log, pos, line).join(offsets.join(tot, log), [log, pos])
    big = F.col("_tot") >= max_chars
    tail_from = F.col("_tot") - edge_chars
    in_head = F.col("_start") < edge_chars
    in_tail = F.col("_end") > tail_from
    head_txt = F.when(F.col("_end") > edge_chars, F.substring(line, 1, F.lit(edge_chars) - F.col("_start"))).otherwise(F.col(line))
    tail_txt = F.when(F.col("_start") < tail_from, F.expr(f"substring({line}, cast(_tot - {edge_chars} - _start + 1 as int))")
                      ).otherwise(F.col(line))
    small = x.where(~big).select(log, F.col(pos).alias(pos), F.col(line))
    h = x.where(big & in_head)
    nh = h.groupBy(log).agg(F.count(F.lit(1)).alias("_nh"))
    first_tail = x.where(big & in_tail).groupBy(log).agg(F.min(pos).alias("_ft"))
    head = h.select(log, F.col(pos), head_txt.alias(line))
    marker = nh.select(log, (F.col("_nh") + 1).alias(pos), F.lit("...[file truncated]...").alias(line))
    tail = (x.where(big & in_tail).join(nh, log).join(first_tail, log)
             .select(log, (F.col("_nh") + 2 + F.col(pos) - F.col("_ft")).alias(pos), tail_txt.alias(line)))
    cut = small.unionByName(head).unionByName(marker).unionByName(tail)
    from kiln.session import scratch_path
    path = scratch_path(lines.sparkSession, "log-cut")
    cut.write.parquet(path)  # the skeleton reads it several times
    return skeleton(lines.sparkSession.read.schema(cut.schema).parquet(path), max_lines, log, pos, line)


def stderr_tail(lines: DataFrame, log: str = "log_id", pos: str = "line_no", line: str = "line",
                tb_lines: int = 15, plain_lines: int = 10) -> DataFrame:
    """From the last line containing "Traceback", its last ``tb_lines``
    lines; without a traceback, the last ``plain_lines`` lines. One scan: a
    top-k where the log is read, then a window over what is left."""
    is_tb = F.col(line).contains("Traceback")
    newest = Window.partitionBy(log, is_tb).orderBy(F.col(pos).desc())
    # the newest lines with and without the word hold both the last one with it and the last lines of all
    x = lines.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= max(tb_lines, plain_lines)).drop("_r")
    whole = Window.partitionBy(log)
    x = x.withColumns({"_last": F.max(pos).over(whole), "_tb": F.max(F.when(is_tb, F.col(pos))).over(whole)})
    keep = F.when(F.col("_tb").isNotNull(), (F.col(pos) >= F.col("_tb")) & (F.col(pos) > F.col("_last") - tb_lines)) \
            .otherwise(F.col(pos) > F.col("_last") - plain_lines)
    return x.where(keep).drop("_last", "_tb")


# Diagnosis rules, in order (pattern on the lowered text).
DIAGNOSIS_RULES = [
    ("oom", r"out of memory|oom|resourceexhaustederror", "memory",
     "GPU memory exhausted during training", "fatal", 0.95,
     ["Reduce per_device_train_batch_size by 50%", "Enable gradient_checkpointing: true",
      "If still OOM, reduce max_seq_len", "Consider using sharding (stage2)"]),
    ("nan", r"loss.*nan|nan.*loss|nanloss", "numerical",
     "Loss became NaN — likely learning rate too high or bad data", "error", 0.9,
     ["Reduce learning_rate by 10x", "Add max_grad_norm: 1.0", "Check training data for NaN values"]),
    ("nccl", r"nccl", "distributed", "NCCL communication failure between GPUs", "error", 0.85,
     ["Set NCCL_TIMEOUT=1800 in environment", "Check network connectivity between nodes",
      "Try reducing number of GPUs"]),
    ("data_format", r"jsondecodeerror|json.*decode|keyerror|unexpected.*format", "data",
     "Data format doesn't match expected schema", "error", 0.9,
     ["Re-run data preparation in fixed mode for the task and data path",
      "Check that JSONL lines have required fields", "Verify image paths are accessible"]),
    ("checkpoint", r"checkpoint.*error|checkpoint.*corrupt|failed.*load", "checkpoint",
     "Checkpoint file may be corrupted", "error", 0.8,
     ["Resume from the previous checkpoint-N", "Delete corrupted checkpoint directory",
      "Reduce save_steps to have more frequent checkpoints"]),
]
DIAGNOSIS_UNKNOWN = ("unknown", None, "other", "Could not determine root cause from error text", "error", 0.3,
                     ["Review the full training log for context", "Search for similar errors online",
                      "Consider LLM-assisted diagnosis (force_llm=True)"])


def diagnosis_table(spark) -> DataFrame:
    """The fix dimension (6 rows, fixed): joined by broadcast."""
    rows = [(r[0], r[2], r[3], r[4], float(r[5]), r[6]) for r in DIAGNOSIS_RULES + [DIAGNOSIS_UNKNOWN]]
    return spark.createDataFrame(rows, "error_type string, category string, root_cause string, severity string, "
                                       "confidence double, fix_steps array<string>")


def diagnose(errors: DataFrame, text: str = "message", learning_rate: Column | None = None) -> DataFrame:
    """First matching rule on the lower-cased text -> error type, then
    the rule's category, root cause, severity, confidence and fix steps; NaN
    adds config changes (lr x 0.1, max_grad_norm 1.0), OOM gradient
    checkpointing."""
    low = F.lower(F.col(text))
    t = F.lit("unknown")
    for name, pat, *_ in reversed(DIAGNOSIS_RULES):
        t = F.when(low.rlike(pat), name).otherwise(t)
    lr = learning_rate if learning_rate is not None else F.lit(1e-4)
    changes = (F.when(F.col("error_type") == "oom", F.create_map(F.lit("finetuning.gradient_checkpointing"), F.lit("true")))
                .when(F.col("error_type") == "nan",
                      F.create_map(F.lit("finetuning.learning_rate"), (lr * 0.1).cast("string"),
                                   F.lit("finetuning.max_grad_norm"), F.lit("1.0")))
                .otherwise(F.create_map().cast("map<string,string>")))
    dim = F.broadcast(diagnosis_table(errors.sparkSession))
    return errors.withColumn("error_type", t).join(dim, "error_type", "left").withColumn("config_changes", changes)


# Fast-path rules (checked in order, case-insensitive).
TIER1_RULES = [
    ("oom", ["Out of memory", "CUDA out of memory", "OOM", "ResourceExhaustedError"], "memory",
     "reduce_batch_size", "GPU OOM detected", 0.5),
    ("nan", ["loss.*nan", "NaN loss", "gradient.*inf"], "numerical", "reduce_learning_rate", "NaN loss detected", 0.1),
    ("nccl", ["NCCL.*error", "NCCL.*timeout", "nccl.*abort"], "distributed", "increase_nccl_timeout",
     "NCCL communication failure", None),
    ("data_format", [r"json\.decode", "JSONDecodeError", "KeyError.*messages"], "data", "check_data_format",
     "Data format mismatch", None),
]


def diagnose_tier1(errors: DataFrame, text: str = "message") -> DataFrame:
    """The first rule whose pattern matches, with its category, fix
    action, factor and reason; nulls when none does; confidence 0.9."""
    found = F.lit(None).cast("struct<t:string,c:string,a:string,f:double,r:string>")
    for name, pats, category, action, reason, factor in reversed(TIER1_RULES):
        hit = F.col(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in pats))
        rule = F.struct(F.lit(name).alias("t"), F.lit(category).alias("c"), F.lit(action).alias("a"),
                        F.lit(factor).cast("double").alias("f"), F.lit(reason).alias("r"))
        found = F.when(hit, rule).otherwise(found)
    return errors.withColumn("_rule", found).select(
        *errors.columns, F.col("_rule.t").alias("error_type"), F.col("_rule.c").alias("category"),
        F.col("_rule.a").alias("fix_action"), F.col("_rule.f").alias("factor"), F.col("_rule.r").alias("reason"),
        F.when(F.col("_rule").isNotNull(), F.lit(0.9)).alias("confidence"))


def run_status(final: DataFrame, exits: DataFrame, log: str = "log_id") -> DataFrame:
    """Completed when the exit code is 0, or the last step is > 0 and
    either no target is known or it reached 90% of it; else failed."""
    j = final.join(exits, log, "left")
    fs = F.coalesce(F.col("final_step"), F.lit(0))
    ms = F.coalesce(F.col("max_steps"), F.lit(0))
    done = (F.col("exit_code") == 0) | ((fs > 0) & ((ms <= 0) | (fs >= ms * 0.9)))
    return j.withColumn("status", F.when(F.coalesce(done, F.lit(False)), "completed").otherwise("failed"))
