"""Format conversion between record shapes.

Records are typed structs:

* messages : ``messages array<struct<role,content>>, images array<string>``
* erniekit : ``image_info array<struct<image_url,matched_text_index>>,
               text_info array<struct<text,tag>>``

Every converter is a column projection (``transform``/``filter`` on arrays), so
it runs inside whole-stage codegen with no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.text import ustrip

IMAGE_INFO = "array<struct<image_url:string,matched_text_index:int>>"
TEXT_INFO = "array<struct<text:string,tag:string>>"
MESSAGES = "array<struct<role:string,content:string>>"


def turns_to_messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn",
                      role: str = "role", text: str = "text") -> DataFrame:
    """one row per conversation with its turns in ``turn`` order.

    A conversation is one group; its size is bounded by the conversation, and
    ``collect_list`` combines map-side before the shuffle on ``conv``.
    """
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"),
                                                 F.col(role).alias("role"),
                                                 F.col(text).alias("content"))))
    return (df.groupBy(conv)
              .agg(turns.alias("_turns"))
              .select(conv,
                      F.transform("_turns", lambda x: F.struct(x["role"].alias("role"),
                                                               x["content"].alias("content"))
                                  ).alias("messages"),
                      F.array().cast("array<string>").alias("images")))


def messages_to_erniekit(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """user -> ``mask``, every other role -> ``no_mask``; image strings
    become ``{image_url, matched_text_index: 0}``, image objects (structs)
    pass as they are, with the two fields they have of these."""
    keep = keep if keep is not None else [c for c in df.columns if c not in ("messages", "images")]
    images = F.coalesce(F.col("images"), F.array()) if "images" in df.columns else F.array().cast("array<string>")
    kind = df.schema["images"].dataType.elementType if "images" in df.columns else None
    if hasattr(kind, "fieldNames"):
        given = set(kind.fieldNames())
        images = F.col("images")
        field = lambda u, name, default: u[name] if name in given else default
        image_info = F.coalesce(F.transform(images, lambda u: F.struct(
            field(u, "image_url", F.lit(None).cast("string")).alias("image_url"),
            field(u, "matched_text_index", F.lit(None).cast("int")).cast("int").alias("matched_text_index"))),
            F.array().cast(IMAGE_INFO))
    else:
        image_info = F.transform(images, lambda u: F.struct(u.alias("image_url"),
                                                            F.lit(0).alias("matched_text_index")))
    text_info = F.transform(F.coalesce(F.col("messages"), F.array().cast(MESSAGES)),
                            lambda m: F.struct(F.coalesce(m["content"], F.lit("")).alias("text"),
                                               F.when(m["role"] == "user", "mask")
                                                .otherwise("no_mask").alias("tag")))
    return df.select(*keep, image_info.cast(IMAGE_INFO).alias("image_info"),
                     text_info.cast(TEXT_INFO).alias("text_info"))


def erniekit_to_messages(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``mask`` -> user, anything else -> assistant; empty urls dropped;
    ``images`` is null when none remain (the key is omitted in JSON)."""
    keep = keep if keep is not None else [c for c in df.columns if c not in ("image_info", "text_info")]
    urls = F.filter(F.transform(F.coalesce(F.col("image_info"), F.array().cast(IMAGE_INFO)),
                                lambda i: i["image_url"]),
                    lambda u: u.isNotNull() & (u != ""))
    msgs = F.transform(F.coalesce(F.col("text_info"), F.array().cast(TEXT_INFO)),
                       lambda t: F.struct(F.when(F.coalesce(t["tag"], F.lit("no_mask")) == "mask", "user")
                                           .otherwise("assistant").alias("role"),
                                          F.coalesce(t["text"], F.lit("")).alias("content")))
    return df.select(*keep, msgs.alias("messages"),
                     F.when(F.size(urls) > 0, urls).alias("images"))


def csv_qa_to_erniekit(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """question/answer rows; both stripped, rows with either blank skipped."""
    keep = keep or []
    q = ustrip(F.coalesce(F.col("question"), F.lit("")))
    a = ustrip(F.coalesce(F.col("answer"), F.lit("")))
    img = ustrip(F.coalesce(F.col("image_path"), F.lit(""))) if "image_path" in df.columns else F.lit("")
    image_info = F.when(img != "", F.array(F.struct(img.alias("image_url"),
                                                    F.lit(0).alias("matched_text_index")))) \
                  .otherwise(F.array().cast(IMAGE_INFO))
    text_info = F.array(F.struct(q.alias("text"), F.lit("mask").alias("tag")),
                        F.struct(a.alias("text"), F.lit("no_mask").alias("tag")))
    return (df.where((q != "") & (a != ""))
              .select(*keep, image_info.cast(IMAGE_INFO).alias("image_info"),
                      text_info.cast(TEXT_INFO).alias("text_info")))


def conversion_stats(src: DataFrame, converted: DataFrame) -> DataFrame:
    """one row ``converted, skipped`` from input and output row counts
    (two counts; the output count attaches as a scalar subquery)."""
    n_out = converted.agg(F.count(F.lit(1))).scalar()
    return src.agg(F.count(F.lit(1)).alias("n_in")).select(
        n_out.alias("converted"), (F.col("n_in") - n_out).alias("skipped"))


def _qa(question: Column, answer: Column, image: Column) -> Column:
    return F.struct(
        F.array(F.struct(image.alias("image_url"), F.lit(0).alias("matched_text_index"))).alias("image_info"),
        F.array(F.struct(question.alias("text"), F.lit("mask").alias("tag")),
                F.struct(answer.alias("text"), F.lit("no_mask").alias("tag"))).alias("text_info"))


# Texts of the conversion rules.
OCR_QUESTION = "Read the text in the image."
VQA_DEFAULT_QUESTION = "Describe this image."
DETECTION_QUESTION = "How many text regions?"
DETECTION_ANSWER = "%d regions"


def ocr_to_erniekit(df: DataFrame, image: str = "image", question: str = OCR_QUESTION) -> DataFrame:
    """OCR crop -> erniekit; the answer is the first non-empty of
    ``text``, ``full_text``, else ""."""
    full = F.col("full_text") if "full_text" in df.columns else F.lit(None).cast("string")
    txt = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.nullif(full, F.lit("")), F.lit(""))
    rec = _qa(F.lit(question), txt, F.col(image))
    return df.select("*", rec.alias("_r")).select(*df.columns, "_r.image_info", "_r.text_info")


def vqa_to_erniekit(df: DataFrame, image: str = "image") -> DataFrame:
    """question defaults to "Describe this image."."""
    q = F.coalesce(F.nullif(F.col("question"), F.lit("")), F.lit(VQA_DEFAULT_QUESTION))
    rec = _qa(q, F.coalesce(F.col("answer"), F.lit("")), F.col(image))
    return df.select("*", rec.alias("_r")).select(*df.columns, "_r.image_info", "_r.text_info")


def bboxes_to_erniekit(df: DataFrame, image: str = "image_path") -> DataFrame:
    """detection record with boxes only -> a counting question/answer."""
    n = F.size(F.coalesce(F.col("bboxes"), F.array().cast("array<array<int>>")))
    rec = _qa(F.lit(DETECTION_QUESTION), F.format_string(DETECTION_ANSWER, n), F.col(image))
    return df.select("*", rec.alias("_r")).select(*df.columns, "_r.image_info", "_r.text_info")


def absolutize_images(df: DataFrame, src_dir: str | Column, col: str = "image_info") -> DataFrame:
    """image urls starting with ``./`` are rewritten under ``src_dir``."""
    base = src_dir if isinstance(src_dir, Column) else F.lit(src_dir.rstrip("/"))
    fix = lambda u: F.when(u.startswith("./"), F.concat(base, F.lit("/"), F.substring(u, 3, 1 << 30))).otherwise(u)
    if col == "images":
        return df.withColumn(col, F.transform(col, fix))
    return df.withColumn(col, F.transform(col, lambda i: i.withField("image_url", fix(i["image_url"]))))


# Converter registry keyed by (source format, target format).
_CONVERTERS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}


def register_converter(src: str, dst: str):
    """Decorator registering ``fn(df) -> df`` as the converter from
    format ``src`` to ``dst`` (used by ``convert``)."""
    def deco(fn):
        _CONVERTERS[(src, dst)] = fn
        return fn
    return deco


register_converter("messages", "erniekit")(messages_to_erniekit)
register_converter("erniekit", "messages")(erniekit_to_messages)
register_converter("csv_qa", "erniekit")(csv_qa_to_erniekit)


def convert(df: DataFrame, src: str, dst: str) -> DataFrame:
    """look up and apply a registered converter (``df.transform``)."""
    fn = _CONVERTERS.get((src, dst))
    if fn is None:
        avail = ", ".join(f"{a}->{b}" for a, b in sorted(_CONVERTERS))
        raise ValueError(f"no converter {src}->{dst}; available: {avail}")
    return df.transform(fn)


def user_conversion(df: DataFrame, fn, schema: str, trial_rows: int | None = None) -> DataFrame:
    """A user function over pandas batches (``mapInPandas``).

    ``trial_rows`` runs it on the first rows only (the trial run before the
    full run); ``None`` is the full run.
    """
    src = df.limit(trial_rows) if trial_rows else df
    return src.mapInPandas(fn, schema)
