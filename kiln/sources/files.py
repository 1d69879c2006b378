"""File sources (S01-S21): JSON lines, JSON documents, CSV/TSV, Parquet, XML,
plain text, archives, image folders, inventories and format routing.

Text, logs, JSON lines, delimited text and large JSON documents are read in byte
ranges (``kiln.sources.ranges``): line numbers, quotes and brackets are followed
across ranges by a prefix over small rows, and no text is exchanged. On storage
that only Spark opens, ``numbered_lines`` and Spark's own readers do the same:
there the text reader yields each split's lines in order, so
``monotonically_increasing_id`` minus the split's first id is the line's offset
inside the split, and per-(file, split) line counts give its starting line.
"""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kiln.functions.text import ustrip
from kiln.sources import json_ranges, ranges, xml_ranges


def numbered_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """``(file, line_no, line)`` from a text DataFrame with ``_metadata``."""
    x = df.select(F.col("_metadata.file_path").alias("file"),
                  F.col("_metadata.file_block_start").alias("_blk"),
                  F.monotonically_increasing_id().alias("_id"), F.col(value).alias("line"))
    splits = x.groupBy("file", "_blk").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return (x.join(splits, ["file", "_blk"])
             .select("file", (F.col("_start") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text, one row per line with its file and line number."""
    if ranges.reachable(spark, path):
        return ranges.ranged_lines(spark, path)
    return numbered_lines(spark.read.format("text").load(path))


def read_logs(spark: SparkSession, path: str, id_pattern: str = r"([^/]+?)(\.[^./]*)?$") -> DataFrame:
    """Training logs as ``(log_id, line_no, line)``; log_id = group 1 of
    ``id_pattern`` on the file path (default: file name without extension)."""
    x = read_lines(spark, path)
    return x.select(F.regexp_extract("file", id_pattern, 1).alias("log_id"), "line_no", "line")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: file, line_no, raw line, parsed VARIANT, is_blank,
    is_bad (non-blank and not JSON). Undecodable bytes come through as
    replacement characters."""
    x = read_lines(spark, path)
    s = ustrip(F.col("line"))
    return x.select("file", "line_no", F.col("line").alias("raw"), F.try_parse_json(s).alias("rec"),
                    (s == "").alias("is_blank")).withColumn(
        "is_bad", ~F.col("is_blank") & F.col("rec").isNull())


# Envelope keys of JSON documents, in precedence order.
ENVELOPE_KEYS = ["data", "samples", "items", "records", "images", "annotations", "train", "test"]


def read_json_doc(spark: SparkSession, path: str, rule: str = "first_list", split_bytes: int = ranges.SPLIT_BYTES) -> DataFrame:
    """One JSON document per file -> one row per record (``file``,
    ``pos``, VARIANT ``rec``). A top-level list gives its elements; an object
    gives the list under its first list-valued key in document order
    (``first_list``) or under the first present envelope key (``envelope``),
    else the object itself. Documents above ``split_bytes`` are read in byte
    ranges by many tasks (``json_ranges``); a record of theirs that is not JSON
    comes out as null, where a smaller document that is not JSON gives no rows."""
    apart = ranges.reachable(spark, path)
    if apart:
        d = ranges.whole_files(ranges.list_files(spark, path).where(F.col("length") <= split_bytes))
    else:
        d = spark.read.format("text").option("wholetext", "true").load(path)
        d = d.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    d = d.withColumn("_v", F.try_parse_json("raw"))
    as_list = F.try_variant_get("_v", "$", "array<variant>")
    if rule == "envelope":
        cands = [F.try_variant_get("_v", f"$.{k}", "array<variant>") for k in ENVELOPE_KEYS]
        inner = F.coalesce(*cands)
    else:
        keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
        # first key whose value is a list, in the document's own key order
        list_keys = F.filter(keys, lambda k: F.try_variant_get(
            F.col("_v"), F.concat(F.lit("$['"), k, F.lit("']")), "array<variant>").isNotNull())
        first = F.element_at(list_keys, 1)
        inner = F.when(F.size(list_keys) > 0, F.try_variant_get(
            F.col("_v"), F.concat(F.lit("$['"), first, F.lit("']")), "array<variant>"))
    recs = F.coalesce(as_list, inner, F.when(F.col("_v").isNotNull(), F.array(F.col("_v"))))
    small = d.select("file", F.posexplode(recs).alias("pos", "rec"))
    if not apart:
        return small
    large = json_ranges.ranged_json(ranges.list_files(spark, path).where(F.col("length") > split_bytes),
                                    ENVELOPE_KEYS if rule == "envelope" else None, split_bytes)
    large = large.select("file", F.col("pos").cast("int").alias("pos"), F.try_parse_json("raw").alias("rec"), "whole")
    return small.unionByName(large.where(~F.col("whole") | F.col("rec").isNotNull()).drop("whole"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header_cols: list[str] | None = None,
                   split_bytes: int = ranges.SPLIT_BYTES) -> DataFrame:
    """CSV/TSV with a header, UTF-8; quoted fields may hold doubled
    quotes, separators and line breaks. A file is read by as many tasks as it
    has ranges (``ranges.ranged_records``), line breaks within quotes or not.
    Rows with more fields than the header are skipped, short rows are padded
    with nulls (as pandas does with ``on_bad_lines='skip'``): the schema has one
    spare ``_extra`` column, which stays null unless a row fills it. Empty
    fields are null. The header's names come from the first file's first row."""
    options = {"sep": sep, "encoding": "UTF-8", "quote": '"', "escape": '"', "nullValue": "\u0001", "emptyValue": ""}
    whole = options | {"header": "true", "multiLine": "true"}
    if header_cols is None:
        header_cols = [c.strip() for c in spark.read.options(**whole).csv(path).columns]
    schema = StructType([StructField(c, StringType()) for c in header_cols] + [StructField("_extra", StringType())])
    if ranges.reachable(spark, path):
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
        records = ranges.ranged_records(spark, path, sep, split_bytes)
        df = records.select(F.from_csv("record", ddl, options | {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    else:
        df = spark.read.options(**whole, mode="PERMISSIVE", enforceSchema="true").schema(schema).csv(path)
    return df.where(F.col("_extra").isNull()).select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in header_cols])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S06."""
    return spark.read.parquet(path)


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None, schema: str | None = None) -> DataFrame:
    """XML records. Without ``row_tag`` the most frequent direct child
    of the root element is used (counted over the document's tags, a
    per-file aggregate). The records are cut out in byte ranges and parsed one
    by one (``from_xml``). Without ``schema`` all of them are read once more
    to infer it, as Spark's reader does."""
    if row_tag is None:
        row_tag = infer_row_tag(spark, path)
    if not ranges.reachable(spark, path):
        reader = spark.read.format("xml").option("rowTag", row_tag)
        return (reader.schema(schema) if schema else reader).load(path)
    records = xml_ranges.records(spark, path, row_tag).select("record")
    if schema is None:
        strings = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        found = spark._jsparkSession.read().option("rowTag", row_tag).xml(strings).schema()
        schema = StructType.fromJson(json.loads(found.json()))
    return records.select(F.from_xml("record", schema).alias("r")).select("r.*")


def _whole_child_tags(batches):
    """Per document, how often each tag is a direct child of the root."""
    from collections import Counter
    for pdf in batches:
        counts: Counter = Counter()
        for text in pdf["value"]:
            xml_ranges.follow((text or "").encode(), 0, 0, lambda _, tag, __: counts.update([tag.decode("utf-8", "replace")]))
        yield pd.DataFrame(list(counts.items()), columns=["tag", "n"])


def infer_row_tag(spark: SparkSession, path: str) -> str:
    """The most frequent direct child of the root element over all documents
    (counted in byte ranges; one row comes back, the reader's option)."""
    if ranges.reachable(spark, path):
        found = xml_ranges.child_tags(spark, path)
    else:
        d = spark.read.format("text").option("wholetext", "true").load(path).select("value")
        found = d.mapInPandas(_whole_child_tags, "tag string, n long")
    row = found.groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag").first()
    return row["tag"] if row else "row"


def xml_summary(spark: SparkSession, path: str) -> DataFrame:
    """Per ``file`` its row element (the most frequent child of the root,
    the first of equals), how many ``rows`` there are of it, and the names of
    the first one's ``attributes``."""
    tags = xml_ranges.child_tags(spark, path)
    best = F.max_by(F.struct("tag", "n", "attributes"), F.struct("n", (-F.col("first_at")).alias("at"))).alias("b")
    return tags.groupBy("file").agg(best).select("file", F.col("b.tag").alias("row_tag"), F.col("b.n").alias("rows"), "b.attributes")


ARCHIVE_SCHEMA = "archive string, member string, size long, content binary"
# Data extensions recognised inside archives and folders.
DATA_EXTENSIONS = [".jsonl", ".json", ".csv", ".tsv", ".parquet", ".xml"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tiff"]
SKIP_NAME_PATTERNS = ["log", "readme", "summary", "license", "download", ".sh", ".md", ".py", ".txt"]


def _members(pdf_iter, with_content: bool):
    for pdf in pdf_iter:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            data = bytes(content)
            try:
                if zipfile.is_zipfile(io.BytesIO(data)):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for info in z.infolist():
                            if not info.is_dir():
                                out.append((path, info.filename, info.file_size,
                                            z.read(info) if with_content else None))
                else:
                    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                        for m in t.getmembers():
                            if m.isfile():
                                f = t.extractfile(m) if with_content else None
                                out.append((path, m.name, m.size, f.read() if f else None))
            except (tarfile.TarError, zipfile.BadZipFile, OSError):
                continue
        yield pd.DataFrame(out, columns=["archive", "member", "size", "content"])


def read_archive(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Members of zip / tar / tar.gz archives as rows; each
    archive is opened in the task that read it."""
    b = spark.read.format("binaryFile").load(path).select("path", "content")
    return b.mapInPandas(lambda it: _members(it, with_content), ARCHIVE_SCHEMA)


def first_data_member(members: DataFrame) -> DataFrame:
    """Per archive the first member (by name) with a data extension."""
    ext = F.lower(F.regexp_extract("member", r"(\.[^./]+)$", 1))
    return (members.where(ext.isin(*DATA_EXTENSIONS))
                   .groupBy("archive").agg(F.min("member").alias("member")))


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files below ``path`` (path and size; content is pruned)."""
    b = ranges.walk(spark, path, recursive=True)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return b.select("path", "length").where(ext.isin(*IMAGE_EXTENSIONS))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` with size, extension, relative path and
    whether it counts as a data file (data extension and no skip pattern in
    the name). File contents are never read."""
    bare = lambda x: re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", x)  # without scheme and authority
    root = bare(path if path.startswith("/") or ":" in path else os.path.abspath(path)).rstrip("/") + "/"
    b = ranges.walk(spark, path, recursive=True)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    full = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    rel = F.when(full.startswith(root), F.substr(full, F.lit(len(root) + 1))).otherwise(F.element_at(F.split(full, "/"), -1))
    skip = F.exists(F.array(*[F.lit(p) for p in SKIP_NAME_PATTERNS]), lambda p: F.contains(name, p))
    return b.select("path", rel.alias("rel"), "length", "modificationTime", ext.alias("ext"),
                    (ext.isin(*DATA_EXTENSIONS) & ~skip).alias("is_data"))


def inventory_summary(inv: DataFrame) -> DataFrame:
    """File count, total MB (2 dp) and data-file count."""
    return inv.agg(F.count(F.lit(1)).alias("file_count"),
                   F.round(F.sum("length") / 1024 / 1024, 2).alias("total_size_mb"),
                   F.count_if("is_data").alias("data_files"))


def extension_counts(inv: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most common extensions (top-k report)."""
    return inv.groupBy("ext").count().orderBy(F.col("count").desc(), "ext").limit(k)


def expand_datasets(inv: DataFrame) -> DataFrame:
    """A folder with no top-level data files but sub-folders becomes one
    dataset per sub-folder that holds data; otherwise the folder itself."""
    depth = F.size(F.split("rel", "/"))
    top = inv.agg(F.count_if(F.col("is_data") & (depth == 1)).alias("top"))
    subs = (inv.where(F.col("is_data") & (depth > 1))
               .select(F.element_at(F.split("rel", "/"), 1).alias("dataset")).distinct())
    return subs.where(top.select(F.col("top") == 0).scalar()).unionByName(
        top.where(F.col("top") > 0).select(F.lit(".").alias("dataset")))


def sniff_format(lines: DataFrame, group: str = "file", pos: str = "line_no", line: str = "line") -> DataFrame:
    """From the first non-empty line: '{' jsonl, '[' json, a comma csv,
    a tab tsv, else text."""
    s = ustrip(F.col(line))
    head = lines.withColumn("_s", s).where(F.col("_s") != "")
    first = head.groupBy(group).agg(F.min_by("_s", pos).alias("_f"))
    f = F.col("_f")
    return first.select(group, F.when(f.startswith("{"), "jsonl").when(f.startswith("["), "json")
                        .when(f.contains(","), "csv").when(f.contains("\t"), "tsv").otherwise("text").alias("format"))


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """S15 for files: ``sniff_format`` of the first line that is not blank; no file is read beyond it."""
    return sniff_format(ranges.first_lines(spark, path))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Route by suffix (driver-side dispatch, one reader per format).
    Any other path is taken as a folder, on any storage Spark reads: the most
    common data extension in its inventory (a small aggregate) picks the
    reader, which then reads every such file below it; a folder or file
    without data files is read as JSON lines."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return read_parquet(spark, path)
    if suffix in (".csv", ".tsv"):
        return read_delimited(spark, path, "\t" if suffix == ".tsv" else ",")
    if suffix == ".xml":
        return read_xml(spark, path)
    if suffix in (".zip", ".tar", ".gz", ".tgz"):
        return read_archive(spark, path)
    if suffix == ".json":
        return read_json_doc(spark, path)
    if suffix == ".jsonl":
        return read_jsonl(spark, path)
    inv = file_inventory(spark, path).where("is_data")
    top = inv.groupBy("ext").count().orderBy(F.col("count").desc(), "ext").first()
    if top is None:
        return read_jsonl(spark, path)
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{top['ext']}")
    if top["ext"] == ".parquet":
        return files.parquet(path)
    found = f"{path.rstrip('/')}/**/*{top['ext']}"
    if top["ext"] in (".csv", ".tsv"):
        return read_delimited(spark, found, "\t" if top["ext"] == ".tsv" else ",")
    return {".json": read_json_doc, ".xml": read_xml}.get(top["ext"], read_jsonl)(spark, found)


def estimate_rows(df: DataFrame) -> DataFrame:
    """The row count as one row ``n``: exact, as a lazy aggregate."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def estimate_csv_rows(spark: SparkSession, path: str, head_bytes: int = 4096) -> DataFrame:
    """The estimate for delimited files: bytes / average row bytes of the
    first ``head_bytes`` of each file (the estimate's feature: it reads no
    further), per ``file``."""
    h = ranges.file_heads(spark, path, head_bytes)
    text = F.decode("head", "ISO-8859-1")  # a character a byte
    feeds = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n")))
    average = F.greatest(F.lit(1.0), F.octet_length("head") / F.greatest(F.lit(1), feeds))
    return h.select("file", F.floor(F.col("length") / average).cast("bigint").alias("rows"))


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per experiment (``multiLine``), optional
    ``history`` arrays kept as they are."""
    return spark.read.option("multiLine", "true").json(path)


DETECTION_SCHEMA = ("image_name string, source string, image_path string, bboxes array<array<int>>, "
                    "num_boxes int")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detection records from JSON lines, typed."""
    x = read_jsonl(spark, path).where(~F.col("is_blank") & ~F.col("is_bad"))
    return x.select("file", "line_no", F.from_json(F.col("raw"), DETECTION_SCHEMA).alias("d")).select(
        "file", "line_no", "d.*")
