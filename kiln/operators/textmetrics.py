"""Edit-distance metrics and token budgets.

Metrics are aggregates over a pairs table (``pred``, ``ref`` and optional
``by`` columns): one ``groupBy(by).agg`` computes NED, CER, WER and exact
match together, each pair's distances computed once in a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.editdistance import edit_distance, pair_edit_distances, token_edit_distance, word_edit_distance
from kiln.functions.text import usplit


def pair_distances(pairs: DataFrame, pred: str = "pred", ref: str = "ref", method: str = "auto") -> DataFrame:
    """Per pair: ``dist`` (characters), ``max_len``, ``ref_len``, word
    distance ``wdist`` (0 when both sides have no words), ``ref_words``, ``exact``."""
    x = pairs
    if method == "auto":
        x = x.withColumn("_d", pair_edit_distances(pred, ref))
        x = x.withColumn("dist", F.col("_d.dist")).withColumn("wdist", F.col("_d.wdist").cast("bigint")).drop("_d")
    else:
        x = (x.withColumn("dist", edit_distance(pred, ref, method))
              .withColumn("wdist", word_edit_distance(pred, ref).cast("bigint")))
    return (x.withColumn("max_len", F.greatest(F.char_length(pred), F.char_length(ref)))
             .withColumn("ref_len", F.char_length(ref))
             .withColumn("ref_words", F.size(usplit(F.col(ref))))
             .withColumn("exact", F.col(pred) == F.col(ref)))


def _ratio0(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def ned_agg() -> Column:
    """Mean of dist/max_len over pairs with max_len > 0; 0 if none."""
    return F.coalesce(F.avg(F.when(F.col("max_len") > 0, F.col("dist") / F.col("max_len"))), F.lit(0.0))


def cer_agg() -> Column:
    """sum(dist) / sum(ref chars); 0 when there are no ref chars."""
    return _ratio0(F.sum("dist"), F.sum("ref_len"))


def wer_agg() -> Column:
    """sum(word dist) / sum(ref words)."""
    return _ratio0(F.sum("wdist"), F.sum("ref_words"))


def exact_match_agg() -> Column:
    """Share of pairs with pred == ref; 0 for no pairs."""
    return F.coalesce(F.avg(F.col("exact").cast("double")), F.lit(0.0))


def ocr_metrics(pairs: DataFrame, by: list[str] | None = None, pred: str = "pred", ref: str = "ref",
                method: str = "auto", digits: int = 6) -> DataFrame:
    """Ned, cer, wer, exact_match (half-even to ``digits``) and
    num_samples, per ``by`` group, in one aggregation."""
    by = by or []
    d = pair_distances(pairs, pred, ref, method)
    return d.groupBy(*by).agg(
        F.bround(ned_agg(), digits).alias("ned"),
        F.bround(cer_agg(), digits).alias("cer"),
        F.bround(wer_agg(), digits).alias("wer"),
        F.bround(exact_match_agg(), digits).alias("exact_match"),
        F.count(F.lit(1)).cast("bigint").alias("num_samples"))


# Fixed value: the tag pattern of the simplified TEDS.
TAG_PATTERN = r"(?U)<(/?\w+)[^>]*>"


def html_tags(c) -> Column:
    """Tag names (``/``-prefixed for closing tags) of an HTML string, in order."""
    x = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(x, F.lit(TAG_PATTERN), 1)


def teds(pred_html, ref_html, method: str = "auto") -> Column:
    """1 - tagdist / max(tags); with no ref tags 1.0 if no pred tags else 0.0."""
    pt, rt = html_tags(pred_html), html_tags(ref_html)
    ml = F.greatest(F.size(pt), F.size(rt))
    return (F.when(F.size(rt) == 0, F.when(F.size(pt) == 0, 1.0).otherwise(0.0))
             .when(ml == 0, F.lit(1.0))
             .otherwise(F.lit(1.0) - token_edit_distance(pt, rt) / ml))


def teds_mean(pairs: DataFrame, pred: str = "pred_html", ref: str = "ref_html",
              by: list[str] | None = None) -> DataFrame:
    """Mean TEDS per group (0 for an empty input)."""
    by = by or []
    return (pairs.select(*by, teds(pred, ref).alias("teds")).groupBy(*by)
                 .agg(F.coalesce(F.avg("teds"), F.lit(0.0)).alias("teds"), F.count(F.lit(1)).alias("num_samples")))


def align_pairs(pred: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Pair predictions with references by ``key`` (full outer join);
    fails the job if any key lacks its partner (length mismatch)."""
    j = pred.alias("p").join(ref.alias("r"), key, "full_outer")
    # the check is part of both output columns, so no projection prunes it away
    ok = F.col("p.pred").isNotNull() & F.col("r.ref").isNotNull()
    error = F.raise_error(F.lit("Length mismatch between predictions and references")).cast("string")
    return j.select(key, F.when(ok, F.col("p.pred")).otherwise(error).alias("pred"),
                    F.when(ok, F.col("r.ref")).otherwise(error).alias("ref"))


# ---------------------------------------------------------------- tokens

def est_tokens(c, chars_per_token: int = 3) -> Column:
    """max(1, chars // 3) (chars // 4 is the other estimate in use)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.greatest(F.lit(1), F.floor(F.char_length(x) / chars_per_token)).cast("bigint")


def truncate_tail(c, max_tokens: int) -> Column:
    """Keep int(len * max/est) leading chars + "\\n...[truncated]"."""
    x = F.col(c) if isinstance(c, str) else c
    est = est_tokens(x)
    keep = F.floor(F.char_length(x).cast("double") * (F.lit(float(max_tokens)) / est.cast("double"))).cast("int")
    return F.when(est <= max_tokens, x).otherwise(F.concat(F.substring(x, F.lit(1), keep), F.lit("\n...[truncated]")))


def truncate_head(c, max_tokens: int) -> Column:
    """Drop int(len * (1 - max/est)) leading chars, prefix a marker."""
    x = F.col(c) if isinstance(c, str) else c
    est = est_tokens(x)
    drop = F.floor(F.char_length(x).cast("double")
                   * (F.lit(1.0) - F.lit(float(max_tokens)) / est.cast("double"))).cast("int")
    return F.when(est <= max_tokens, x).otherwise(
        F.concat(F.lit("...[earlier content truncated]...\n"), F.substring(x, drop + 1, 1 << 30)))


def fit_conversation(turns: DataFrame, max_tokens: int, conv: str = "conv_id", turn: str = "turn",
                     text: str = "text") -> DataFrame:
    """Drop the oldest turns until the rest fits; the last turn always
    stays. Kept = suffix sum <= budget, or the last turn."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    x = (turns.withColumn("tokens", est_tokens(text))
              .withColumn("_suffix", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_is_last", F.row_number().over(w) == 1))
    return x.where((F.col("_suffix") <= max_tokens) | F.col("_is_last")).drop("_suffix", "_is_last")


def fit_lines(lines: DataFrame, max_tokens: int, group: list[str], pos: str = "line_no",
              line: str = "line") -> DataFrame:
    """Keep the newest lines while the running total (from the end)
    stays within the budget; tokens are >= 1 so the suffix sum is monotone.

    Positions are dense per group, so at most the last ``max_tokens`` lines
    can be kept: they are cut out against the per-group maximum (a partial
    aggregate) before the window, which then sorts at most ``max_tokens``
    rows per group however large one log is."""
    last = lines.groupBy(*group).agg(F.max(pos).alias("_last"))
    tail = lines.join(last, group).where(F.col(pos) > F.col("_last") - max_tokens).drop("_last")
    w = Window.partitionBy(*group).orderBy(F.col(pos).desc())
    x = tail.withColumn("tokens", est_tokens(line)).withColumn(
        "_suffix", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(F.col("_suffix") <= max_tokens).drop("_suffix")
