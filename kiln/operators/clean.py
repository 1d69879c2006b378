"""Cleaning and validation of JSON-lines corpora.

Input is a *line table*: one row per physical line with a position column
``pos`` (unique, in file order) and the raw text ``line``; optional group
columns (``by``) keep several datasets apart. ``parse_lines`` adds the parsed
VARIANT once; every predicate after that is a column expression.

Scale notes
* Exact dedup never ranks inside an md5 group. Funnel counts use
  ``groupBy(by, md5)`` (partial aggregation collapses a hot duplicate on the
  map side) and the kept rows come from ``min(struct(pos, ...))`` per md5, so a
  line repeated in a third of all rows costs one map-side combined group.
* Checks read every line; ``n``, ``max_errors``, ``limit`` and the like are
  optional and then ordered top-k (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.text import is_blank, ustrip

# ---------------------------------------------------------------- parsing


def parse_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``s`` (stripped line), ``v`` (VARIANT or null), ``is_blank``,
    ``is_object``. A JSON text that parses and starts with ``{`` is an object."""
    s = ustrip(F.col(line))
    return (df.withColumn("s", s)
              .withColumn("v", F.try_parse_json(F.col("s")))
              .withColumn("is_blank", F.col("s") == "")
              .withColumn("is_object", F.col("v").isNotNull() & F.col("s").startswith("{")))


def _vtype(x: Column) -> Column:
    return F.schema_of_variant(x)


def _has(v: Column, key: str) -> Column:
    return F.variant_get(v, f"$.{key}", "variant").isNotNull()


def _str_nonblank(val: Column) -> Column:
    """``str(val).strip() != ''`` for a VARIANT value; a missing one is blank.

    Of those present only a string can be blank; numbers, booleans, null
    ("None"), lists and objects always print as something."""
    return F.when(val.isNull(), F.lit(False)).when(_vtype(val) == "STRING",
                  ustrip(F.variant_get(val, "$", "string")) != "").otherwise(F.lit(True))


def _list_any_field_nonblank(v: Column, list_key: str, field: str) -> Column:
    arr = F.try_variant_get(v, f"$.{list_key}", "array<variant>")
    elem = lambda t: (_vtype(t).startswith("OBJECT")
                      & F.coalesce(_str_nonblank(F.variant_get(t, f"$.{field}", "variant")), F.lit(False)))
    return F.exists(arr, elem)


def is_empty_record(v: Column) -> Column:
    """C03 on a parsed object.

    ``text_info`` present: empty when it is a list with no element holding a
    non-blank ``text``; else ``messages`` with ``content`` likewise; else
    every str/int/float/bool value is blank (so a row without any is empty).
    A non-list ``text_info``/``messages`` is not empty."""
    ti_list = F.try_variant_get(v, "$.text_info", "array<variant>").isNotNull()
    ms_list = F.try_variant_get(v, "$.messages", "array<variant>").isNotNull()
    vals = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    scalar_blank = lambda x: F.when(_vtype(x) == "STRING", ustrip(F.variant_get(x, "$", "string")) == "") \
                              .when(_vtype(x).isin("VOID") | _vtype(x).startswith("OBJECT")
                                    | _vtype(x).startswith("ARRAY"), F.lit(True)) \
                              .otherwise(F.lit(False))
    return (F.when(_has(v, "text_info"),
                   ti_list & ~_list_any_field_nonblank(v, "text_info", "text"))
             .when(_has(v, "messages"),
                   ms_list & ~_list_any_field_nonblank(v, "messages", "content"))
             .otherwise(F.forall(vals, scalar_blank)))


# ------------------------------------------------------------- C01 - C05


def valid_objects(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines whose stripped text parses to a JSON object."""
    return parse_lines(lines, line).where("is_object")


def disposition(lines: DataFrame, line: str = "line") -> DataFrame:
    """Per line: ``blank``, ``json_error`` or ``ok`` plus ``md5`` of the
    stripped text and ``empty`` (C03) for the parsed objects."""
    p = parse_lines(lines, line)
    return p.select(
        "*",
        F.when(F.col("is_blank"), "blank")
         .when(~F.col("is_object"), "json_error")
         .otherwise("ok").alias("state"),
        F.when(F.col("is_object"), F.md5(F.col("s"))).alias("md5"),
        F.when(F.col("is_object"), is_empty_record(F.col("v"))).alias("empty"))


def clean_stats(lines: DataFrame, line: str = "line", by: list[str] | None = None) -> DataFrame:
    """C05 funnel: input_lines, json_errors, duplicates, empty_content,
    valid_lines, output_lines (one row per ``by`` group).

    Precedence parse -> duplicate -> empty. All copies of a line share its
    md5 and so its emptiness; per (group, md5) one aggregate gives everything:
    duplicates = valid lines - distinct md5s; empty = distinct empty md5s."""
    by = by or []
    d = disposition(lines, line)
    per_hash = (d.groupBy(*by, "state", "md5")
                 .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("empty").cast("int")).alias("empty")))
    out = per_hash.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("input_lines"),
        F.coalesce(F.sum(F.when(F.col("state") == "json_error", F.col("n"))), F.lit(0)).cast("bigint").alias("json_errors"),
        F.coalesce(F.sum(F.when(F.col("state") == "ok", F.col("n") - 1)), F.lit(0)).cast("bigint").alias("duplicates"),
        F.count(F.when((F.col("state") == "ok") & (F.col("empty") == 1), 1)).cast("bigint").alias("empty_content"),
        F.count(F.when((F.col("state") == "ok") & (F.col("empty") == 0), 1)).cast("bigint").alias("valid_lines"))
    return out.withColumn("output_lines", F.col("valid_lines"))


def dedup_exact(lines: DataFrame, line: str = "line", pos: str = "pos",
                by: list[str] | None = None, drop_empty: bool = False) -> DataFrame:
    """C02 (and C05's kept rows with ``drop_empty``): first occurrence of each
    stripped JSON-object line, by position.

    ``min(struct(pos, ...))`` per md5 keeps the first copy; partial
    aggregation folds copies before the shuffle, so hot duplicates are cheap."""
    by = by or []
    d = disposition(lines, line).where(F.col("state") == "ok")
    if drop_empty:  # all copies of a line are empty or none is
        d = d.where(~F.col("empty"))
    first = d.groupBy(*by, "md5").agg(F.min(pos).alias(pos))
    return d.join(first, [*by, "md5", pos], "left_semi").select(*by, pos, F.col("s").alias(line), "md5")


def _quoted(text: Column) -> Column:
    """A string as JSON text."""
    j = F.to_json(F.array(text))
    return F.substr(j, F.lit(2), F.char_length(j) - 2)


def _printed(v: Column) -> Column:
    """``str(value)`` of a VARIANT value."""
    return (F.when(_vtype(v) == "STRING", F.variant_get(v, "$", "string")).when(_vtype(v) == "VOID", "None")
             .when(_vtype(v) == "BOOLEAN", F.initcap(F.to_json(v))).otherwise(F.to_json(v)))


def _object_json(v: Column, rewrite: dict) -> Column:
    """JSON text of an object, the values of the keys in ``rewrite`` through
    its functions (VARIANT -> JSON text, null to leave one); null if ``v`` is
    no object."""
    value = lambda e: F.coalesce(*[F.when(e["key"] == k, fn(e["value"])) for k, fn in rewrite.items()], F.to_json(e["value"]))
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    pairs = F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), value(e)))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def normalized_json(v: Column) -> Column:
    """C04 on a parsed object: its JSON text with ``text_info[].text`` and
    ``messages[].content`` stripped; other values print as they are."""
    def items(field: str):
        strip = {field: lambda x: _quoted(ustrip(_printed(x)))}
        return lambda x: F.concat(F.lit("["), F.array_join(F.transform(
            F.try_variant_get(x, "$", "array<variant>"),
            lambda t: F.coalesce(_object_json(t, strip), F.to_json(t))), ","), F.lit("]"))
    return _object_json(v, {"text_info": items("text"), "messages": items("content")})


def clean_lines(lines: DataFrame, line: str = "line", pos: str = "pos", by: list[str] | None = None) -> DataFrame:
    """C01-C05 in one call, the rows a clean run writes: first occurrences of
    parseable, non-empty objects with normalised texts (C04), one JSON text
    per row with its position; ``clean_stats`` gives the counts."""
    kept = dedup_exact(lines, line, pos, by, drop_empty=True)
    return kept.withColumn(line, normalized_json(F.try_parse_json(F.col(line)))).drop("md5")


def drop_empty_typed(df: DataFrame) -> DataFrame:
    """C03 on typed records: erniekit ``text_info`` or messages ``messages``.
    A null text prints as "None" (non-blank), as ``str(None)`` does."""
    def nonblank(x: Column) -> Column:
        return F.when(x.isNull(), F.lit(True)).otherwise(~is_blank(x))
    if "text_info" in df.columns:
        return df.where(F.exists(F.coalesce("text_info", F.array()), lambda t: nonblank(t["text"])))
    return df.where(F.exists(F.coalesce("messages", F.array()), lambda m: nonblank(m["content"])))


def normalize_text(df: DataFrame) -> DataFrame:
    """Strip ``text_info[].text`` and ``messages[].content``."""
    if "text_info" in df.columns:
        df = df.withColumn("text_info", F.transform("text_info",
                           lambda t: t.withField("text", ustrip(t["text"]))))
    if "messages" in df.columns:
        df = df.withColumn("messages", F.transform("messages",
                           lambda m: m.withField("content", ustrip(m["content"]))))
    return df


# ------------------------------------------------------------- C06 - C09

# Required keys of the two record formats.
ERNIEKIT_REQUIRED = ["image_info", "text_info"]
MESSAGES_REQUIRED = ["messages"]


def detect_format(lines: DataFrame, line: str = "line", pos: str = "pos",
                  by: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Vote over the lines of each group (``n``: the first so many): any
    erniekit object wins, else any messages object, else null."""
    by = by or []
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(pos)) if by else None
    p = parse_lines(lines, line)
    if n is None:
        head = p
    elif by:
        # rank <= n per group becomes a WindowGroupLimit (top-n per partition before the shuffle)
        head = p.withColumn("_rn", rn).where(F.col("_rn") <= n)
    else:
        head = p.orderBy(pos).limit(n)
    ek = F.col("is_object") & _has(F.col("v"), "image_info") & _has(F.col("v"), "text_info")
    ms = F.col("is_object") & _has(F.col("v"), "messages")
    agg = head.groupBy(*by).agg(F.count_if(ek).alias("ek"), F.count_if(~ek & ms).alias("ms"))
    return agg.select(*by, F.when(F.col("ek") > 0, "erniekit").when(F.col("ms") > 0, "messages")
                      .alias("format"))


def _errors_erniekit(v: Column, is_json: Column) -> Column:
    """Error messages of one line (array<string>), in the reference's order."""
    missing = F.when(~_has(v, "image_info"), F.lit("Missing required field 'image_info'")) \
               .when(~_has(v, "text_info"), F.lit("Missing required field 'text_info'"))
    not_list = lambda k: F.when(_has(v, k) & F.try_variant_get(v, f"$.{k}", "array<variant>").isNull(),
                                F.lit(f"'{k}' must be a list"))
    errs = F.array(missing, not_list("image_info"), not_list("text_info"))
    return F.when(~is_json, F.array(F.lit("Invalid JSON"))).otherwise(F.filter(errs, lambda e: e.isNotNull()))


def _errors_messages(v: Column, is_json: Column) -> Column:
    msgs = F.try_variant_get(v, "$.messages", "array<variant>")
    idx = F.sequence(F.lit(0), F.greatest(F.size(msgs) - 1, F.lit(0)))
    # first non-object element stops the walk
    first_bad = F.array_min(F.filter(F.transform(idx, lambda j: F.when(
        ~_vtype(F.element_at(msgs, j + 1)).startswith("OBJECT"), j)), lambda j: j.isNotNull()))
    per_elem = F.flatten(F.transform(idx, lambda j: F.when(
        (F.size(msgs) > 0) & (first_bad.isNull() | (j <= first_bad)),
        F.when(j == first_bad, F.array(F.format_string("message[%d] must be a dict", j)))
         .otherwise(F.filter(F.array(
             F.when(~_has(F.element_at(msgs, j + 1), "role"), F.format_string("message[%d] missing 'role'", j)),
             F.when(~_has(F.element_at(msgs, j + 1), "content"), F.format_string("message[%d] missing 'content'", j))),
             lambda e: e.isNotNull()))).otherwise(F.array().cast("array<string>"))))
    return (F.when(~is_json, F.array(F.lit("Invalid JSON")))
             .when(~_has(v, "messages"), F.array(F.lit("Missing 'messages' field")))
             .when(msgs.isNull(), F.array(F.lit("'messages' must be a list")))
             .otherwise(per_elem))


def validation_errors(lines: DataFrame, fmt: str, line: str = "line", pos: str = "pos",
                      max_errors: int | None = None) -> DataFrame:
    """Every error (``max_errors``: up to and including the line at
    which so many are reached). Columns ``line_no, k, error``.

    Only the first ``max_errors`` erroneous lines can contribute, so an ordered
    top-k (no global sort) bounds the work; without a limit the errors are a
    plain distributed projection."""
    p = parse_lines(lines, line).where(~F.col("is_blank"))
    is_json = F.col("v").isNotNull()
    errs = _errors_erniekit(F.col("v"), is_json) if fmt == "erniekit" else _errors_messages(F.col("v"), is_json)
    e = p.select(F.col(pos).alias("line_no"), errs.alias("errs")).where(F.size("errs") > 0)
    if max_errors is None:
        return (e.select("line_no", F.posexplode("errs").alias("k", "msg"))
                 .select("line_no", "k", F.format_string("Line %d: %s", F.col("line_no"), F.col("msg")).alias("error")))
    top = e.orderBy("line_no").limit(max_errors)
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("_before", F.coalesce(F.sum(F.size("errs")).over(w), F.lit(0)))
    return (top.where(F.col("_before") < max_errors)
               .select("line_no", F.posexplode("errs").alias("k", "msg"))
               .select("line_no", "k", F.format_string("Line %d: %s", F.col("line_no"), F.col("msg")).alias("error")))


def validation_warnings(lines: DataFrame, line: str = "line", pos: str = "pos") -> DataFrame:
    """C07 warning: erniekit lines whose ``text_info`` is an empty list."""
    p = parse_lines(lines, line).where(~F.col("is_blank"))
    ti = F.try_variant_get(F.col("v"), "$.text_info", "array<variant>")
    return p.where(F.size(ti) == 0).select(
        F.col(pos).alias("line_no"), F.format_string("Line %d: 'text_info' is empty", F.col(pos)).alias("warning"))


def validation_summary(lines: DataFrame, fmt: str, line: str = "line", pos: str = "pos",
                       max_errors: int | None = None) -> DataFrame:
    """Valid iff no errors; samples_checked = non-blank lines read
    (``max_errors``: up to the line at which so many errors stop the check)."""
    if max_errors is None:
        p = parse_lines(lines, line).where(~F.col("is_blank"))
        found = _errors_erniekit if fmt == "erniekit" else _errors_messages
        a = p.select(F.size(found(F.col("v"), F.col("v").isNotNull())).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_errors"),
            F.count(F.lit(1)).cast("bigint").alias("samples_checked"))
        return a.select(F.lit(fmt).alias("format"), (F.col("n_errors") == 0).alias("valid"), "n_errors", "samples_checked")
    errs = validation_errors(lines, fmt, line, pos, max_errors)
    e = errs.agg(F.count(F.lit(1)).alias("n_errors"), F.max("line_no").alias("last_err"))
    n_errors = e.select("n_errors").scalar()
    stop = e.select(F.when(F.col("n_errors") >= max_errors, F.col("last_err"))).scalar()
    nb = parse_lines(lines, line).where(~F.col("is_blank")).select(F.col(pos).alias("p"))
    n = nb.where(stop.isNull() | (F.col("p") <= stop)).agg(F.count(F.lit(1)).alias("n_lines"))
    return n.select(F.lit(fmt).alias("format"), (n_errors == 0).alias("valid"),
                    n_errors.cast("bigint").alias("n_errors"),
                    F.col("n_lines").cast("bigint").alias("samples_checked"))


# ------------------------------------------------------------- C10 - C15

def image_refs(recs: DataFrame, pos: str = "pos", max_line: int | None = None) -> DataFrame:
    """Relative (``./``) image urls of erniekit lines (``image_info`` objects)
    with ``k``, their place in the line."""
    p = recs if "v" in recs.columns else parse_lines(recs)
    if max_line is not None:
        p = p.where(F.col(pos) <= max_line)
    arr = F.try_variant_get(F.col("v"), "$.image_info", "array<variant>")
    urls = F.transform(arr, lambda i: F.try_variant_get(i, "$.image_url", "string"))
    return (p.select(F.col(pos).alias("line_no"), F.posexplode(urls).alias("k", "url"))
             .where(F.col("url").startswith("./")))


def missing_images(recs: DataFrame, images: DataFrame, base_dir: str, pos: str = "pos",
                   limit: int | None = None) -> DataFrame:
    """Relative image references with no file under ``base_dir``, as
    ``line_no, k, url, missing`` (``k``: the reference's place in its line);
    ``images`` is a path listing (``list_images``). ``limit``: the lines in
    order up to and including the one at which so many are reached."""
    refs = image_refs(recs, pos).withColumn(
        "path", F.concat(F.lit(base_dir.rstrip("/") + "/"), F.substring("url", 3, 1 << 30)))
    have = images.select(F.regexp_replace("path", "^file:", "").alias("path"))
    miss = refs.join(have, "path", "left_anti")
    text = F.format_string("Line %d: %s", F.col("line_no"), F.col("url")).alias("missing")
    if limit is None:
        return miss.select("line_no", "k", "url", text)
    per_line = miss.groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("k", "url"))).alias("urls"))
    top = per_line.orderBy("line_no").limit(limit)
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("_before", F.coalesce(F.sum(F.size("urls")).over(w), F.lit(0)))
    return (top.where(F.col("_before") < limit).select("line_no", F.explode("urls").alias("u"))
               .select("line_no", F.col("u.k").alias("k"), F.col("u.url").alias("url")).select("line_no", "k", "url", text))


def image_drop(recs: DataFrame, source_has_images: bool | Column, pos: str = "pos",
               n: int | None = None, min_fill: float = 0.1) -> DataFrame:
    """C11: among the parsed lines (``n``: the first so many), the share with
    a non-empty ``image_info`` list; flagged when the source has images and
    the share is under ``min_fill``."""
    p = (recs if "v" in recs.columns else parse_lines(recs)).where(F.col("v").isNotNull())
    head = p if n is None else p.orderBy(pos).limit(n)
    has = F.coalesce(F.size(F.try_variant_get(F.col("v"), "$.image_info", "array<variant>")) > 0, F.lit(False))
    src = source_has_images if isinstance(source_has_images, Column) else F.lit(source_has_images)
    a = head.agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(has).alias("rows_with_images"))
    return a.select("rows_checked", "rows_with_images",
                    (src & (F.col("rows_checked") > 0)
                     & (F.col("rows_with_images") / F.col("rows_checked") < min_fill)).alias("dropped"))


# Name hints for image data.
PARQUET_IMAGE_COLUMNS = ["image", "img", "image_bytes", "bytes", "pixel_values", "image_data"]
CSV_IMAGE_HINTS = ["image", "img", "image_path", "file_name", "path", "filename", "photo", "image url"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff", ".gif"]
JSONL_IMAGE_KEYS = ["image", "img", "image_bytes", "image_url"]


def image_columns(df: DataFrame) -> list[str]:
    """Schema-only check (no job): columns named like image data."""
    hints = set(PARQUET_IMAGE_COLUMNS)
    return [c for c in df.columns if c.lower() in hints]


def csv_has_images(lines: DataFrame, pos: str = "pos", line: str = "line", n: int | None = None) -> DataFrame:
    """C13 over a CSV line table: header mentions an image hint, or a later
    line (``n``: one of the next so many) contains an image extension."""
    head = lines if n is None else lines.orderBy(pos).limit(n + 1)
    first = head.agg(F.min(pos).alias("p")).scalar()
    low = F.lower(F.col(line))
    hdr = F.lower(ustrip(F.col(line)))
    hint = F.exists(F.array(*[F.lit(h) for h in CSV_IMAGE_HINTS]), lambda h: F.contains(hdr, h))
    ext = F.exists(F.array(*[F.lit(e) for e in IMAGE_EXTENSIONS]), lambda e: F.contains(low, e))
    return head.agg(F.coalesce(F.bool_or(F.when(F.col(pos) == first, hint).otherwise(ext)), F.lit(False))
                    .alias("has_images"))


def jsonl_has_images(lines: DataFrame, pos: str = "pos", line: str = "line", n: int | None = None) -> DataFrame:
    """C14: a line (``n``: one of the first so many) is an object with an
    image-like key."""
    head = parse_lines(lines if n is None else lines.orderBy(pos).limit(n), line)
    keys = F.coalesce(F.json_object_keys(F.col("s")), F.array().cast("array<string>"))
    hit = F.col("is_object") & F.arrays_overlap(keys, F.array(*[F.lit(k) for k in JSONL_IMAGE_KEYS]))
    return head.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("has_images"))


def source_has_images(inventory: DataFrame) -> DataFrame:
    """C15 over a file inventory (``file_inventory``): any image file, or any
    per-file flag ``has_images`` already computed by C12-C14."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    img = ext.isin(*(IMAGE_EXTENSIONS))
    flag = F.col("has_images") if "has_images" in inventory.columns else F.lit(False)
    return inventory.agg(F.coalesce(F.bool_or(img | flag), F.lit(False)).alias("has_images"))


# ------------------------------------------------------------- C16 - C20

def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float/double columns becomes null."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _py_type(x: Column) -> Column:
    """Python type name of a VARIANT scalar/container."""
    t = _vtype(x)
    return (F.when(t == "STRING", "str").when(t == "BOOLEAN", "bool").when(t == "VOID", "NoneType")
             .when(t.startswith("OBJECT"), "dict").when(t.startswith("ARRAY"), "list")
             .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | t.rlike(r"^DECIMAL\(\d+,0\)$"), "int")
             .otherwise("float"))


def infer_schema(lines: DataFrame, pos: str = "pos", line: str = "line", n: int | None = None) -> DataFrame:
    """C17: per key its first-seen Python type (``list[elem]`` for lists) and
    example (strings over 80 chars cut + "...", lists cut to 2 items), over
    all objects (``n``: the first so many)."""
    p = parse_lines(lines, line).where("is_object")
    if n is not None:
        p = p.orderBy(pos).limit(n)
    kv = p.select(pos, F.explode(F.try_variant_get(F.col("v"), "$", "map<string,variant>")).alias("key", "val"))
    t = _py_type(F.col("val"))
    first = F.try_variant_get(F.col("val"), "$[0]", "variant")
    typ = F.when(t == "list", F.concat(F.lit("list["),
                                       F.when(first.isNull(), "any").otherwise(_py_type(first)), F.lit("]"))).otherwise(t)
    s = F.variant_get(F.col("val"), "$", "string")
    ex = (F.when((t == "str") & (F.char_length(s) > 80), F.concat(F.substring(s, 1, 80), F.lit("...")))
           .when(t == "str", s)
           .when(t == "list", F.to_json(F.slice(F.try_variant_get(F.col("val"), "$", "array<variant>"), 1, 2)))
           .otherwise(F.to_json(F.col("val"))))
    return (kv.groupBy("key").agg(F.min_by(F.struct(typ.alias("type"), ex.alias("example")), F.col(pos)).alias("f"),
                                  F.min(pos).alias("first_pos"))
              .select("key", "f.type", "f.example", "first_pos"))


def head(recs: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """First ``n`` rows in position order (ordered top-k)."""
    return recs.orderBy(pos).limit(n)


def sample_rows(recs: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` pseudo-random rows: smallest ``md5(seed|key)`` (top-k)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return recs.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def clean_annotation(c, max_chars: int = 300) -> Column:
    """C20: drop markdown code fences; the label is a short one by design:
    its first ``max_chars`` characters + "..." if there are more."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.when(x.startswith("```html"),
               ustrip(F.replace(F.replace(x, F.lit("```html\n"), F.lit("")), F.lit("```"), F.lit("")))).otherwise(x)
    x = F.when(x.startswith("```"), ustrip(F.replace(x, F.lit("```"), F.lit("")))).otherwise(x)
    return F.when(F.char_length(x) > max_chars, F.concat(F.substring(x, 1, max_chars), F.lit("..."))).otherwise(x)
