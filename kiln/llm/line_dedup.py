"""Line dedup: range-partitioned line hashes, keep bitmaps per document.

Only hashes, document ids and positions are shuffled until the end. The hashes
are range-partitioned by (hash, document) with a secondary sort by position, so
a line that a third of all documents hold spreads over many partitions; each
partition streams its sorted runs, leaving one row per (hash, document), and
the per-line document count and keeper come out of a partial and a final
aggregate. What the operator returns per document is a compressed bitmap: a map
from word number to a 64-bit word of dropped lines, words without a drop absent.

Defined results. Null or empty text: one empty line. Rows that share a doc_id
count as one document; each row has its own bitmap, found by (doc_id, hash of
text). A null doc_id is one document of its own that never keeps a line others
hold. Repeated lines of the keeper all stay. An empty table gives no rows.
Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiln.llm.common import ASCII_SPACE, LOWER, UPPER, ascii_lower, hash128, table, written

BITS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"),
                       F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    keyed = (rows.where(F.char_length("line") >= min_chars)
             .select("id", "th", "pos", F.btrim("line", F.lit(ASCII_SPACE)).alias("line"))
             .where(F.char_length("line") >= min_chars))
    return keyed.select("id", "th", "pos", *hash128(ascii_lower(F.col("line"))))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                   min_docs: int = 5, keep: str = "last") -> DataFrame:
    """h1, h2, n_docs, keeper of every line key found in ``min_docs`` documents."""
    occ = _occurrences(docs, id_col, text_col, min_chars).select("h1", "h2", "id", "pos")
    ranged = occ.repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos")
    # the range partitions and their order are kept: the window streams over sorted rows, no exchange or sort of its own
    first = F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("pos"))
    firsts = ranged.withColumn("nth", first).where("nth = 1")
    pick = {"last": F.max, "first": F.min}[keep]
    return (firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), pick("id").alias("keeper"))
            .where(F.col("n_docs") >= min_docs))


def line_drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                      min_docs: int = 5, keep: str = "last") -> DataFrame:
    """id, th, n_dropped, dropped (map word -> 64 bits) for every document that loses a line."""
    occ = _occurrences(docs, id_col, text_col, min_chars)
    # written, so that the join reads both sides from exchanges of their own and a hot line can be split
    frequent = written(frequent_lines(docs, id_col, text_col, min_chars, min_docs, keep).select("h1", "h2", "keeper"),
                       "frequent-lines")
    lost = occ.join(frequent, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos") % BITS)
    words = (lost.groupBy("id", "th", F.floor(F.col("pos") / BITS).cast("int").alias("word"))
             .agg(F.bit_or(bit).alias("bits")))
    return words.groupBy("id", "th").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def kept_lines(text: Column, dropped: Column) -> Column:
    """The lines of ``text`` whose bit is not set in ``dropped``, joined by line breaks."""
    lines = _lines(text)
    n_words = F.floor((F.size(lines) - 1) / BITS).cast("int")
    flags = F.flatten(F.transform(
        F.sequence(F.lit(0), n_words),
        lambda w: F.flatten(F.transform(
            F.array(F.coalesce(F.element_at(dropped, w), F.lit(0).cast("bigint"))),
            lambda word: F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit(word, b))))))
    pairs = F.arrays_zip(lines.alias("line"), F.slice(flags, F.lit(1), F.size(lines)).alias("flag"))
    kept = F.transform(F.filter(pairs, lambda p: p["flag"] == 0), lambda p: p["line"])
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, keep: str = "last") -> DataFrame:
    """The documents' id and text with dropped lines taken out: id, text, n_lines, n_dropped."""
    bitmaps = line_drop_bitmaps(docs, id_col, text_col, min_chars, min_docs, keep)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    b = bitmaps.select(F.col("id").alias("b_id"), F.col("th").alias("b_th"), "n_dropped", "dropped")
    joined = base.join(b, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("th") == F.col("b_th")), "left")
    return joined.select("id", kept_lines(F.col("text"), F.col("dropped")).alias("text"),
                         F.size(_lines(F.col("text"))).cast("bigint").alias("n_lines"),
                         F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      '{UPPER}', '{LOWER}') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
