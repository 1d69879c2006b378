"""Dataset profiling (P01-P11): counts, field coverage, text-length stats,
image counts, flags and recommendations, per dataset via ``by``.

Exact nearest-rank percentiles are computed from a length *histogram*:
``groupBy(by, length).count()`` is partially aggregated on the map side, so
its size is bounded by the number of distinct lengths, not by rows; the
cumulative window then runs over that small table. No group of raw rows is
ever sorted in one task, whatever the skew between datasets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.clean import _has, _vtype, parse_lines


def _len_str(x: Column) -> Column:
    """``len(str(x))`` for a VARIANT value: a string's code points, else the
    length of its JSON rendering ("None" for null)."""
    return (F.when(x.isNull(), F.lit(0))
             .when(_vtype(x) == "STRING", F.char_length(F.variant_get(x, "$", "string")))
             .when(_vtype(x) == "VOID", F.lit(4))
             .otherwise(F.char_length(F.to_json(x))))


def _sum_field_len(v: Column, list_key: str, field: str) -> Column:
    arr = F.try_variant_get(v, f"$.{list_key}", "array<variant>")
    lens = F.transform(F.filter(arr, lambda t: _vtype(t).startswith("OBJECT")),
                       lambda t: _len_str(F.variant_get(t, f"$.{field}", "variant")))
    return F.coalesce(F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0).cast("bigint"))


def text_length_variant(v: Column) -> Column:
    """P03 on a parsed object: summed text length of ``text_info`` (else
    ``messages``), 0 if that is null, empty or not a list; null when neither
    key is present."""
    return (F.when(_has(v, "text_info"), _sum_field_len(v, "text_info", "text"))
             .when(_has(v, "messages"), _sum_field_len(v, "messages", "content")))


def image_count_variant(v: Column) -> Column:
    """Images of an erniekit row (list length) or a messages row
    (list length, 1 for any other truthy value)."""
    ii = F.try_variant_get(v, "$.image_info", "array<variant>")
    im = F.variant_get(v, "$.images", "variant")
    im_list = F.try_variant_get(v, "$.images", "array<variant>")
    truthy = ~(F.is_variant_null(im) | (F.try_variant_get(im, "$", "string") == "")
               | (F.try_variant_get(im, "$", "double") == 0) | (F.try_variant_get(im, "$", "boolean") == F.lit(False)))
    return (F.when(_has(v, "text_info"), F.coalesce(F.size(ii), F.lit(0)))
             .when(_has(v, "messages"),
                   F.when(im.isNull(), 0).when(im_list.isNotNull(), F.size(im_list))
                    .when(truthy, 1).otherwise(0))
             .otherwise(F.lit(0)))


def text_length_typed(df: DataFrame) -> Column:
    """P03 on typed erniekit/messages records."""
    if "text_info" in df.columns:
        arr, fld = F.col("text_info"), "text"
    else:
        arr, fld = F.col("messages"), "content"
    lens = F.transform(arr, lambda t: F.coalesce(F.char_length(t[fld]), F.lit(4)))
    return F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _stats_from_hist(hist: DataFrame, by: list[str], cnt: str = "cnt", extra: list[Column] | None = None) -> DataFrame:
    """Nearest-rank stats from a (by, len, cnt) histogram (see
    ``length_stats``) plus ``extra`` aggregates over the same rows, in one
    aggregation (so the histogram is computed once)."""
    valid = F.col("len").isNotNull() & (F.col(cnt) > 0)
    c = F.when(valid, F.col(cnt)).otherwise(F.lit(0))
    w = Window.partitionBy(*by).orderBy("len")
    h = (hist.withColumn("_c", c)
             .withColumn("cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("n", F.sum("_c").over(Window.partitionBy(*by))))
    i50 = F.floor(F.col("n") / 2)
    i95 = F.floor(F.col("n").cast("double") * F.lit(0.95).cast("double"))  # n - 1 up to 20 rows
    at = lambda i: F.min(F.when(valid & (F.col("cum") - F.col("_c") <= i) & (i < F.col("cum")), F.col("len")))
    return h.groupBy(*by).agg(
        *(extra or []),
        F.max("n").cast("bigint").alias("n_lengths"),
        F.min(F.when(valid, F.col("len"))).cast("bigint").alias("len_min"),
        F.max(F.when(valid, F.col("len"))).cast("bigint").alias("len_max"),
        F.bround(F.sum(F.when(valid, F.col("len") * F.col("_c"))) / F.max("n"), 0).cast("bigint").alias("len_avg"),
        at(i50).cast("bigint").alias("len_p50"),
        at(i95).cast("bigint").alias("len_p95"))


def length_stats(df: DataFrame, length: str, by: list[str] | None = None) -> DataFrame:
    """Min, max, avg (half-even to an integer), p50 = sorted[n div 2],
    p95 = sorted[int(n * 0.95)], which is the last up to 20 rows; rows with a null length
    are ignored. Exact, via a histogram of lengths (see module doc)."""
    by = by or []
    hist = df.groupBy(*by, F.col(length).alias("len")).agg(F.count(F.lit(1)).alias("cnt"))
    return _stats_from_hist(hist, by)


def profile(lines: DataFrame, line: str = "line", by: list[str] | None = None) -> DataFrame:
    """One row per dataset: num_samples (object lines),
    json_errors (non-blank lines that do not parse), image_count, has_images,
    text-length stats.

    One parse, one aggregation: rows are counted per (dataset, text length)
    with the object, error and image tallies alongside, so the totals and the
    exact percentiles both come from that small histogram."""
    by = by or []
    p = parse_lines(lines, line)
    obj = F.col("is_object")
    x = p.select(*by, obj.alias("_obj"), (~F.col("is_blank") & F.col("v").isNull()).alias("_err"),
                 F.when(obj, text_length_variant(F.col("v"))).alias("len"),
                 F.when(obj, image_count_variant(F.col("v"))).alias("_imgs"))
    hist = x.groupBy(*by, "len").agg(F.count_if("_obj").alias("cnt"), F.count_if("_err").alias("_errs"),
                                     F.sum("_imgs").alias("_imgs"))
    out = _stats_from_hist(hist, by, extra=[
        F.sum("cnt").cast("bigint").alias("num_samples"), F.sum("_errs").cast("bigint").alias("json_errors"),
        F.coalesce(F.sum("_imgs"), F.lit(0)).cast("bigint").alias("image_count")])
    return out.select(*by, "num_samples", "json_errors", "image_count", (F.col("image_count") > 0).alias("has_images"),
                      "len_min", "len_max", "len_avg", "len_p50", "len_p95")


def profile_typed(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """P01-P05 on typed records (one row per record, already parsed), from
    one (dataset, length) histogram as in ``profile``."""
    by = by or []
    imgs = F.size(F.col("image_info") if "image_info" in df.columns else F.col("images"))
    hist = df.groupBy(*by, text_length_typed(df).alias("len")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(F.greatest(imgs, F.lit(0))).alias("_imgs"))
    out = _stats_from_hist(hist, by, extra=[
        F.sum("cnt").cast("bigint").alias("num_samples"),
        F.coalesce(F.sum("_imgs"), F.lit(0)).cast("bigint").alias("image_count")])
    return out.select(*by, "num_samples", "image_count", (F.col("image_count") > 0).alias("has_images"),
                      "len_min", "len_max", "len_avg", "len_p50", "len_p95")


def field_coverage(lines: DataFrame, line: str = "line", by: list[str] | None = None) -> DataFrame:
    """Share of object rows holding each key, half-even to 2 decimals.

    Keys come from the raw text (``json_object_keys``) and are de-duplicated
    per row; the explode is partially aggregated per (group, key)."""
    by = by or []
    p = parse_lines(lines, line).where("is_object")
    n = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    k = (p.select(*by, F.explode(F.array_distinct(F.json_object_keys(F.col("s")))).alias("key"))
          .groupBy(*by, "key").agg(F.count(F.lit(1)).alias("rows_with_key")))
    j = k.join(n, by) if by else k.withColumn("n", n.select("n").scalar())
    return j.select(*by, "key", F.col("rows_with_key").cast("bigint").alias("rows_with_key"),
                    F.bround(F.col("rows_with_key") / F.col("n"), 2).alias("coverage"))


def quality_flags(profile_df: DataFrame) -> DataFrame:
    """P06: "<pct>% lines have JSON errors" with pct = errors / (samples +
    errors) * 100, half-even to 1 decimal; empty list without errors."""
    pct = F.bround(F.col("json_errors") / (F.col("num_samples") + F.col("json_errors")) * 100, 1)
    flag = F.when(F.col("json_errors") > 0,
                  F.array(F.concat(pct.cast("string"), F.lit("% lines have JSON errors")))) \
            .otherwise(F.array().cast("array<string>"))
    return profile_df.withColumn("quality_flags", flag)


# Recommendation texts and thresholds.
REC_INVALID = "Fix data format errors before training"
REC_SMALL = "Dataset is very small — consider adding more data"
REC_LONG = "Average text length is long — consider increasing max_seq_len"
SMALL_DATASET = 100
LONG_AVG_TEXT = 2000


def recommendations(profile_df: DataFrame, valid: Column | None = None) -> DataFrame:
    """Recommendation list and quality score 1.0 / 0.5 by validity."""
    valid = valid if valid is not None else (F.col("valid") if "valid" in profile_df.columns else F.lit(True))
    recs = F.filter(F.array(F.when(~valid, F.lit(REC_INVALID)),
                            F.when(F.col("num_samples") < SMALL_DATASET, F.lit(REC_SMALL)),
                            F.when(F.coalesce(F.col("len_avg"), F.lit(0)) > LONG_AVG_TEXT, F.lit(REC_LONG))),
                    lambda r: r.isNotNull())
    return profile_df.select("*", recs.alias("recommendations"),
                             F.when(valid, 1.0).otherwise(0.5).alias("quality_score"))


def processing_summary(index: DataFrame) -> DataFrame:
    """P10: batch summary over a dataset index (``status``, ``num_samples``,
    ``image_count``): datasets per status and totals over completed ones."""
    done = F.col("status") == "completed"
    return index.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(done, F.col("num_samples"))), F.lit(0)).cast("bigint").alias("total_samples"),
        F.coalesce(F.sum(F.when(done, F.col("image_count"))), F.lit(0)).cast("bigint").alias("total_images"))


def size_mb(files: DataFrame) -> DataFrame:
    """The size of a dataset's files in MB, 2 decimals: every file once,
    from the reader's metadata."""
    per_file = files.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b")).groupBy("p").agg(
        F.max("b").alias("b"))
    return per_file.agg(F.bround(F.sum("b") / 1024 / 1024, 2).alias("size_mb"))
