"""Source and sink queries: files derived from the driver tables are
written to a fresh folder under the checkpoint directory and read back
through the sources (the work grows with the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import convert
from kiln.plans.catalog import query
from kiln.plans.corpus import v_jsonl_chat
from kiln.plans.views import table, v_jsonl
from kiln.session import scratch_path
from kiln.sources import files as S
from kiln.sources import sinks as K


CHUNK = 200  # documents to a file: files and archives stay small however many documents there are


def _chunk(col: str = "doc_id"):
    return F.floor(F.col(col) / CHUNK).cast("bigint").alias("chunk")


def _write_text(df, col, path, by="source", order="line_no"):
    """Text files of one ``by`` value and ``CHUNK`` lines each, in ``order``."""
    keyed = df.select("*", _chunk(order))
    K.write_files(_grouped(keyed, by, "chunk").sortWithinPartitions(by, "chunk", order), path, [by, "chunk"], col)
    return path


def _grouped(df, *by):
    """Each group's rows in one of as many tasks as shuffles have: what costs here is files, not bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _source(df):
    return df.withColumn("source", F.regexp_extract("file", r"source=([^/]+)/", 1))


@query("S01_read_jsonl", """select source, count(*)::bigint as lines, count(*) filter (where trim(line) = '')::bigint as blank,
  count(*) filter (where not json_valid(line))::bigint as bad, sum(rn)::bigint as line_nos, sum(length(line))::bigint as chars
from (select *, row_number() over (partition by source, line_no // 200 order by line_no) as rn from v_jsonl) t group by source""",
       views=("v_jsonl",))
def s01(spark, sf):
    p = _write_text(v_jsonl(spark, sf), "line", scratch_path(spark, "jsonl"))
    r = _source(S.read_jsonl(spark, p))
    return r.groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("lines"),
                                   F.count_if("is_blank").cast("bigint").alias("blank"),
                                   F.count_if("is_bad").cast("bigint").alias("bad"),
                                   F.sum("line_no").cast("bigint").alias("line_nos"),
                                   F.sum(F.char_length("raw")).cast("bigint").alias("chars"))


def _json_documents(spark, sf, build, name):
    """JSON documents of one source and ``CHUNK`` records each."""
    d = table(spark, sf, "documents").select("*", _chunk())
    doc = _grouped(d, "source", "chunk").groupBy("source", "chunk").agg(F.to_json(build(F.collect_list(
        F.struct("doc_id", "lang", "text")))).alias("j"))
    p = scratch_path(spark, name)
    K.write_files(doc, p, ["source", "chunk"], "j")
    return p


_RECORDS_SQL = """select doc_id, lang, text from documents"""


def _records(r):
    get = lambda k, t: F.variant_get("rec", f"$.{k}", t).alias(k)
    return r.select(get("doc_id", "bigint"), get("lang", "string"), get("text", "string"))


@query("S02_read_json_doc", _RECORDS_SQL)
def s02(spark, sf):
    p = _json_documents(spark, sf, lambda rows: F.struct(F.lit(1).alias("version"), rows.alias("rows")), "jsondoc")
    return _records(S.read_json_doc(spark, p))


@query("S03_read_json_envelope", _RECORDS_SQL)
def s03(spark, sf):
    p = _json_documents(spark, sf, lambda rows: F.struct(F.array(F.lit(1)).alias("other"), rows.alias("samples")), "jsonenv")
    return _records(S.read_json_doc(spark, p, rule="envelope"))


def _qa_csv(spark, sf, sep):
    """Question/answer rows with quotes, separators and line breaks as they are."""
    c = table(spark, sf, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    qa = q.join(a, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.concat(F.lit('say "'), F.col("question"), F.lit('", then\tgo')).alias("question"), "answer")
    p = scratch_path(spark, "csv")
    (qa.write.option("header", "true").option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
       .option("ignoreTrailingWhiteSpace", "false").mode("overwrite").csv(p))
    return p


_QA_SQL = """select q.conv_id || '-' || q.turn as id, 'say "' || q.text || '", then' || chr(9) || 'go' as question, a.text as answer
from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user'"""


@query("S04_read_csv", _QA_SQL)
def s04(spark, sf):
    return S.read_delimited(spark, _qa_csv(spark, sf, ","), ",")


@query("S05_read_tsv", _QA_SQL)
def s05(spark, sf):
    return S.read_delimited(spark, _qa_csv(spark, sf, "\t"), "\t")


@query("S06_read_parquet", """select source, count(*)::bigint as n, sum(n_chars)::bigint as chars from documents group by source""")
def s06(spark, sf):
    d = S.read_parquet(spark, f"{sf.rstrip('/')}/documents.parquet")
    return d.groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.sum("n_chars").cast("bigint").alias("chars"))


def _xml_documents(spark, sf):
    """XML documents of one source and ``CHUNK`` records each."""
    escaped = F.col("text")
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(ref))
    record = F.concat(F.lit('<record id="'), F.col("doc_id").cast("string"), F.lit('"><lang>'), F.col("lang"),
                      F.lit("</lang><text>"), escaped, F.lit("</text></record>"))
    d = table(spark, sf, "documents").select("*", _chunk())
    body = _grouped(d, "source", "chunk").groupBy("source", "chunk").agg(F.concat(
        F.lit("<dataset><meta/>"), F.concat_ws("", F.collect_list(record)), F.lit("</dataset>")).alias("x"))
    p = scratch_path(spark, "xml")
    K.write_files(body, p, ["source", "chunk"], "x")
    return p


@query("S07_read_xml", """select doc_id as id, lang, regexp_replace(text, '[ \\t\\r\\n]+', '', 'g') as text from documents""")
def s07(spark, sf):
    r = S.read_xml(spark, _xml_documents(spark, sf), schema="_id string, lang string, text string")
    return r.select(F.col("_id").cast("bigint").alias("id"), "lang", F.regexp_replace("text", r"[ \t\r\n]+", "").alias("text"))


@query("S07_xml_summary", """select source, doc_id // 200 as chunk, case when count(*) > 1 then 'record' else 'meta' end as row_tag,
  count(*)::bigint as rows, case when count(*) > 1 then 'id' else '' end as attributes from documents group by source, doc_id // 200""")
def s07_summary(spark, sf):
    """The row element of each document; one with a single record has its first child, ``meta``, as often."""
    r = _source(S.xml_summary(spark, _xml_documents(spark, sf)))
    return r.select("source", F.regexp_extract("file", "chunk=([^/]+)/", 1).cast("bigint").alias("chunk"), "row_tag", "rows",
                    F.array_join("attributes", ",").alias("attributes"))


@query("S08_read_lines", """select count(*)::bigint as lines, sum(length(l))::bigint as chars
from (select unnest(string_split(text, chr(10))) as l from documents)""")
def s08(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("line_no"), "text")
    p = _write_text(d, "text", scratch_path(spark, "lines"))
    return S.read_lines(spark, p).agg(F.count(F.lit(1)).cast("bigint").alias("lines"),
                                      F.sum(F.char_length("line")).cast("bigint").alias("chars"))


def _storage(p):
    """File system and root of a path, local or shared storage alike."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(p if "://" in p else "file://" + p.replace("file:", "", 1))


def _archives(spark, sf, kind="zip"):
    """Archives of one source and ``CHUNK`` documents each as JSON lines, written by the tasks."""
    import io
    import tarfile
    import zipfile

    import pandas as pd

    d = table(spark, sf, "documents").select("source", _chunk(), "doc_id", "lang", "text")
    p = scratch_path(spark, f"archives-{kind}")

    def pack(key, pdf):
        source, chunk = key
        rows = pdf.sort_values("doc_id")[["doc_id", "lang", "text"]].to_json(orient="records", lines=True).encode()
        members = [("README.md", b"docs"), (f"{source}/train.jsonl", rows)]
        buf = io.BytesIO()
        if kind == "zip":
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                for name, data in members:
                    z.writestr(name, data)
        else:
            with tarfile.open(fileobj=buf, mode="w:gz") as t:
                for name, data in members:
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
        filesystem, root = _storage(p)
        filesystem.create_dir(root, recursive=True)
        with filesystem.open_output_stream(f"{root}/{source}-{chunk}.{kind}", compression=None) as f:
            f.write(buf.getvalue())
        return pd.DataFrame({"n": [len(pdf)]})
    d.groupBy("source", "chunk").applyInPandas(pack, "n long").agg(F.sum("n")).collect()
    return p


_PARTS = "(select distinct source, doc_id // 200 as chunk from documents)"


@query("S09_read_archive", f"""select source || '-' || chunk || '.zip' as archive, m as member
from {_PARTS} t, (values ('README.md'), ('train.jsonl')) v(m)""")
def s09(spark, sf):
    m = S.read_archive(spark, _archives(spark, sf))
    return m.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), F.element_at(F.split("member", "/"), -1).alias("member"))


@query("S10_first_data_member", f"""select source || '-' || chunk || '.tar.gz' as archive, source || '/train.jsonl' as member from {_PARTS} t""")
def s10(spark, sf):
    f = S.first_data_member(S.read_archive(spark, _archives(spark, sf, "tar.gz")))
    return f.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "member")


def _tree(spark, sf):
    """A folder tree: a data file per source and chunk, and an 'image' per document."""
    import pandas as pd

    d = table(spark, sf, "documents").select("source", _chunk(), "doc_id", "lang")
    p = scratch_path(spark, "tree")
    rows = d.select("source", "chunk", F.to_json(F.struct("doc_id", "lang")).alias("j"))
    K.write_files(_grouped(rows, "source", "chunk").sortWithinPartitions("source", "chunk"), p + "/data", ["source", "chunk"], "j", ".json")

    def put(batches):
        filesystem, root = _storage(p)
        made = set()
        for pdf in batches:
            for source, i in zip(pdf["source"], pdf["doc_id"]):
                if source not in made:
                    filesystem.create_dir(f"{root}/images/{source}", recursive=True)
                    made.add(source)
                with filesystem.open_output_stream(f"{root}/images/{source}/{i}.png") as f:
                    f.write(b"\x89PNG")
            yield pd.DataFrame({"n": [len(pdf)]})
    _grouped(d, "doc_id").mapInPandas(put, "n long").agg(F.sum("n")).collect()
    return p


@query("S11_list_images", """select count(*)::bigint as images, 4 * count(*)::bigint as bytes from documents""")
def s11(spark, sf):
    return S.list_images(spark, _tree(spark, sf)).agg(F.count(F.lit(1)).cast("bigint").alias("images"),
                                                      F.sum("length").cast("bigint").alias("bytes"))


@query("S12_file_inventory", f"""with n as (select count(*) as files from {_PARTS}),
b as (select sum(length('{{"doc_id":' || doc_id || ',"lang":"' || lang || '"}}') + 1) + 4 * count(*) as bytes, count(*) as docs from documents)
select docs + files as file_count, round(bytes / 1024.0 / 1024.0, 2) as total_size_mb, files as data_files from n, b""")
def s12(spark, sf):
    return S.inventory_summary(S.file_inventory(spark, _tree(spark, sf)))


@query("S13_extension_counts", f"""select '.png' as ext, count(*) as count from documents union all select '.json', count(*) from {_PARTS}""")
def s13(spark, sf):
    return S.extension_counts(S.file_inventory(spark, _tree(spark, sf)))


@query("S14_expand_datasets", """select distinct 'source=' || source as dataset from documents""")
def s14(spark, sf):
    return S.expand_datasets(S.file_inventory(spark, _tree(spark, sf) + "/data"))


@query("S15_sniff_format", f"""select 'jsonl' as format, count(*)::bigint as files from {_PARTS}""")
def s15(spark, sf):
    p = _write_text(v_jsonl_chat(spark, sf), "line", scratch_path(spark, "sniff"))
    f = S.sniff_files(spark, p)
    return f.groupBy("format").agg(F.count(F.lit(1)).cast("bigint").alias("files"))


@query("S16_read_any", """select f as format, count(*)::bigint as n, sum(doc_id)::bigint as ids
from documents, (values ('parquet'), ('csv'), ('jsonl folder'), ('parquet folder')) v(f) group by f""")
def s16(spark, sf):
    """The same table through several readers, by suffix and by a folder's files."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    p = scratch_path(spark, "any")
    d.write.option("header", "true").csv(f"{p}/docs.csv")

    def put(batches):
        import uuid

        import pandas as pd
        filesystem, root = _storage(p)
        filesystem.create_dir(f"{root}/lines/part", recursive=True)
        for pdf in batches:
            with filesystem.open_output_stream(f"{root}/lines/part/{uuid.uuid4().hex}.jsonl") as f:
                f.write(pdf.to_json(orient="records", lines=True).encode())
            yield pd.DataFrame({"n": [len(pdf)]})
    d.repartition(4).mapInPandas(put, "n long").agg(F.sum("n")).collect()
    d.write.partitionBy("source").parquet(f"{p}/columns")
    lines = S.read_any(spark, f"{p}/lines")
    ids = {"parquet": S.read_any(spark, f"{sf.rstrip('/')}/documents.parquet").select("doc_id"),
           "csv": S.read_any(spark, f"{p}/docs.csv").select(F.col("doc_id").cast("bigint").alias("doc_id")),
           "jsonl folder": lines.select(F.variant_get("rec", "$.doc_id", "bigint").alias("doc_id")),
           "parquet folder": S.read_any(spark, f"{p}/columns").select("doc_id")}
    out = None
    for name, df in ids.items():
        part = df.agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.sum("doc_id").alias("ids")).select(
            F.lit(name).alias("format"), "n", "ids")
        out = part if out is None else out.unionByName(part)
    return out


@query("S17_estimate_rows", """select count(*)::bigint as n from events""")
def s17(spark, sf):
    return S.estimate_rows(table(spark, sf, "events"))


@query("S17_estimate_csv_rows", """with t as (select event_type, event_id // 5000 as chunk,
  string_agg(event_id || ',' || user_id, chr(10) order by event_id) || chr(10) as body from events group by all),
h as (select *, substr(body, 1, 4096) as head from t)
select event_type, chunk, floor(length(body) / greatest(1.0, length(head)::double
  / greatest(1, length(head) - length(replace(head, chr(10), '')))))::bigint as rows from h""")
def s17_csv(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor(F.col("event_id") / 5000).cast("bigint").alias("chunk"), "event_id",
                                          F.concat_ws(",", "event_id", "user_id").alias("line"))
    p = scratch_path(spark, "estimate")
    K.write_files(_grouped(e, "event_type", "chunk").sortWithinPartitions("event_type", "chunk", "event_id"), p,
                  ["event_type", "chunk"], "line")
    return S.estimate_csv_rows(spark, p).select(F.regexp_extract("file", "event_type=([^/]+)/", 1).alias("event_type"),
                                                F.regexp_extract("file", "chunk=([^/]+)/", 1).cast("bigint").alias("chunk"), "rows")


@query("S18_read_logs", """select log_id, line_no, line from v_log""", views=("v_log",))
def s18(spark, sf):
    from kiln.plans.views import v_log
    v = v_log(spark, sf)
    p = scratch_path(spark, "logs")
    # one file per log, as logs are: a log's lines go through one task in order
    K.write_files(_grouped(v, "log_id").sortWithinPartitions("log_id", "line_no"), p, ["log_id"], "line")
    return S.read_logs(spark, p, id_pattern=r"log_id=([^/]+)/").select("log_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


def log_files(spark, sf):
    from kiln.plans.views import v_log
    p = scratch_path(spark, "live")
    v = v_log(spark, sf)
    (v.repartition("log_id").sortWithinPartitions("log_id", "line_no").select(F.concat_ws("|", "log_id", "line_no", "line").alias("value"))
       .write.mode("overwrite").text(p))
    return p


def drained(df, spark, name):
    """Run a stream over all files that are there, into files, and read those."""
    out = scratch_path(spark, name)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint")
           .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("S19_stream_logs", """select log_id, line_no, line from v_log""", views=("v_log",))
def s19(spark, sf):
    """Lines as a stream brings them, against the same lines in batch."""
    from kiln.streaming.live import stream_logs
    got = drained(stream_logs(spark, log_files(spark, sf)).select("line"), spark, "s19")
    parts = F.split("line", r"\|", 3)
    return got.select(parts[0].alias("log_id"), parts[1].cast("bigint").alias("line_no"), parts[2].alias("line"))


@query("U04_stream_callbacks", """select log_id, line_no, error_type from (select *, case
  when regexp_matches(line, '(?i)(?:CUDA|GPU)\\s*(?:out\\s*of\\s*memory|OOM)') or regexp_matches(line, '(?i)ResourceExhaustedError') then 'OOM'
  when regexp_matches(line, '(?i)(?:FATAL|Fatal error|CRITICAL)') then 'FATAL' when regexp_matches(line, '(?i)loss.*(?:NaN|nan|inf)') then 'NaN'
  when regexp_matches(line, '(?i)NCCL.*(?:error|timeout|abort)') then 'NCCL' when regexp_matches(line, '(?:^|\\s)ERROR') then 'ERROR'
  when regexp_matches(line, '(?i)(?:^|\\s)WARNING') and not regexp_matches(line, 'NCCL|LAUNCH|RAS') then 'WARNING' end as error_type
  from v_log) t where error_type is not null""", views=("v_log",))
def u04(spark, sf):
    """A callback on every batch of errors of a stream: it appends them to a notification log."""
    from kiln.streaming.live import notify_sink, stream_errors_transform, stream_logs
    parts = F.split("line", r"\|", 3)
    lines = stream_logs(spark, log_files(spark, sf)).select(
        parts[0].alias("log_id"), parts[1].cast("bigint").alias("line_no"), parts[2].alias("line"))
    out = scratch_path(spark, "u04")
    errors = stream_errors_transform(lines).select("log_id", "line_no", "error_type")
    q = (errors.writeStream.foreachBatch(notify_sink(out)).option("checkpointLocation", out + "-checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return K.read_batches(spark, out, "log_id string, line_no bigint, error_type string").select("log_id", "line_no", "error_type")


@query("S20_read_eval_results", """select 'run-' || user_id as experiment_id, count(*)::bigint as points, round(sum(value), 6) as total
from events group by user_id""")
def s20(spark, sf):
    e = table(spark, sf, "events")
    res = e.groupBy("user_id").agg(F.struct(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("experiment_id"),
                                            F.struct(F.collect_list("value").alias("train_loss")).alias("history")).alias("r"))
    # JSON arrays of the results of 50 experiments a file, as a results folder holds them
    docs = res.groupBy(F.floor(F.col("user_id") / 50).alias("part")).agg(F.to_json(F.collect_list("r")).alias("j"))
    p = scratch_path(spark, "evals")
    docs.write.partitionBy("part").mode("overwrite").text(p)
    r = S.read_eval_results(spark, p)
    return r.select("experiment_id", F.size("history.train_loss").cast("bigint").alias("points"), F.round(
        F.aggregate("history.train_loss", F.lit(0.0).cast("double"), lambda a, b: a + b), 6).alias("total"))


@query("S21_read_detections", """select doc_id || '.png' as image_name, source, './img/' || doc_id || '.png' as image_path,
  (n_chars % 5)::int as num_boxes, (4 * (n_chars % 5))::int as n_numbers from documents""")
def s21(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    rec = d.select("source", F.col("doc_id").alias("line_no"), F.to_json(F.struct(
        name.alias("image_name"), F.col("source").alias("source"), F.concat(F.lit("./img/"), name).alias("image_path"),
        F.array_repeat(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), (F.col("n_chars") % 5).cast("int")).alias("bboxes"),
        (F.col("n_chars") % 5).cast("int").alias("num_boxes"))).alias("line"))
    p = _write_text(rec, "line", scratch_path(spark, "det"))
    r = S.read_detections(spark, p)
    return r.select("image_name", "source", "image_path", "num_boxes", F.size(F.flatten("bboxes")).alias("n_numbers"))


# ------------------------------------------------------------ sinks

@query("K01_write_jsonl", """select event_id, case when value > 400 then null else value end as value from events""")
def k01(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("value") > 400, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    p = scratch_path(spark, "k01")
    K.write_jsonl(e, p)
    return spark.read.schema("event_id long, value double").json(p)


@query("K02_write_splits", """with r as (select doc_id, source, row_number() over (order by md5('42|' || cast(doc_id as varchar)), doc_id) as rk,
  count(*) over () as n from documents)
select doc_id, source, case when rk <= floor(n * 0.9) then 'train' when rk <= floor(n * 0.9) + floor(n * 0.05) then 'val' else 'test' end as split
from r""")
def k02(spark, sf):
    from kiln.operators.sampling import split_exact
    s = split_exact(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 0.9, 0.05)
    p = scratch_path(spark, "k02")
    K.write_splits(s, p)
    return spark.read.json(p).select("doc_id", "source", "split")


@query("K03_append_notifications", """select 'WARN' as level, props as message from events where event_type = 'error'""")
def k03(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    p = scratch_path(spark, "k03")
    half = e.where(F.col("event_id") % 2 == 0).select(F.lit("WARN").alias("level"), F.col("props").alias("message"))
    rest = e.where(F.col("event_id") % 2 == 1).select(F.lit("WARN").alias("level"), F.col("props").alias("message"))
    K.append_notifications(half, p)
    K.append_notifications(rest, p)
    return spark.read.json(p).select("level", "message")


_IDX = """old as (select source as source_path, count(*) as n from documents where doc_id % 2 = 0 group by source),
new as (select source as source_path, n_chars::bigint as n, doc_id from documents where doc_id % 3 = 0 and source < 'src5'),
last as (select source_path, arg_max(n, doc_id) as n from new group by source_path)"""


@query("K04_upsert_index", f"""with {_IDX}
select * from old where source_path not in (select source_path from new) union all select * from last""")
def k04(spark, sf):
    """Results that come one after another, each replacing its source's record."""
    d = table(spark, sf, "documents")
    old = d.where(F.col("doc_id") % 2 == 0).groupBy(F.col("source").alias("source_path")).agg(F.count(F.lit(1)).alias("n"))
    new = d.where((F.col("doc_id") % 3 == 0) & (F.col("source") < "src5")).select(
        F.col("source").alias("source_path"), F.col("n_chars").cast("bigint").alias("n"), "doc_id")
    return K.upsert_index(old, new, order="doc_id").select("source_path", "n")


_EXPERIMENTS = """e as (select concat('e', cast(event_id // 3 as varchar)) as id, concat('run-', cast(event_id // 90 as varchar)) as run_id,
  event_id, event_type from events)"""


def _experiment_rows(spark, sf):
    """Three events an experiment."""
    number = F.floor(F.col("event_id") / 3).cast("bigint").cast("string")
    run = F.floor(F.col("event_id") / 90).cast("bigint").cast("string")
    return table(spark, sf, "events").select(F.concat(F.lit("e"), number).alias("id"), F.concat(F.lit("run-"), run).alias("run_id"),
                                             "event_id", "event_type")


@query("K05_upsert_experiments", f"""with {_EXPERIMENTS},
old as (select distinct id, run_id, 'pending' as status from e where event_id % 2 = 0),
new as (select id, run_id, arg_max(event_type, event_id) as status from e where event_id % 5 <> 0 group by id, run_id)
select * from old where not exists (select 1 from new where new.id = old.id and new.run_id = old.run_id) union all select * from new""")
def k05(spark, sf):
    e = _experiment_rows(spark, sf)
    old = e.where(F.col("event_id") % 2 == 0).select("id", "run_id", F.lit("pending").alias("status")).distinct()
    new = e.where(F.col("event_id") % 5 != 0).select("id", "run_id", F.col("event_type").alias("status"), "event_id")
    return K.upsert_experiments(old, new, order="event_id").select("id", "run_id", "status")


_ABSENT = f"""with {_EXPERIMENTS},
old as (select id, min(event_type) as state from e where event_id % 7 = 0 group by id),
new as (select id, arg_min(event_type, event_id) as state from e where event_id % 3 <> 0 group by id)
select * from old union all select * from new where id not in (select id from old)"""


@query("K06_append_if_absent", _ABSENT)
def k06(spark, sf):
    e = _experiment_rows(spark, sf)
    old = e.where(F.col("event_id") % 7 == 0).groupBy("id").agg(F.min("event_type").alias("state"))
    new = e.where(F.col("event_id") % 3 != 0).select("id", F.col("event_type").alias("state"), "event_id")
    return K.append_if_absent(old, new, ["id"], order="event_id").select("id", "state")


_MERGED = f"""with {_EXPERIMENTS},
first as (select id, run_id, arg_max(event_type, event_id) as status, max(event_id) as event_id from e
  where event_id % 2 = 0 group by id, run_id),
second as (select id, run_id, arg_max(event_type, event_id) as status, max(event_id) as event_id from e
  where event_id % 5 = 0 and event_id < 1000 group by id, run_id)
select * from second union all select * from first
where not exists (select 1 from second where second.id = first.id and second.run_id = first.run_id)"""


@query("K05_merge_table", _MERGED)
def k05_merge(spark, sf):
    """Two merges into a stored table; the second one rewrites the buckets of its keys only."""
    e = _experiment_rows(spark, sf).withColumnRenamed("event_type", "status")
    p = scratch_path(spark, "merged")
    K.merge_into(spark, p, e.where(F.col("event_id") % 2 == 0), ["id", "run_id"], "event_id", buckets=8)
    K.merge_into(spark, p, e.where((F.col("event_id") % 5 == 0) & (F.col("event_id") < 1000)), ["id", "run_id"], "event_id", buckets=8)
    return spark.read.parquet(p).select("id", "run_id", "status", "event_id")


@convert.register_converter("messages", "turn_count")
def _turn_count(df):
    return df.select("conv_id", F.size("messages").cast("bigint").alias("turns"))


@query("U01_register_converter", """select conv_id, count(*)::bigint as turns from conversations group by conv_id""")
def u01(spark, sf):
    return convert.convert(convert.turns_to_messages(table(spark, sf, "conversations")), "messages", "turn_count")


def _user_fn(batches):
    for pdf in batches:
        yield pdf.assign(question=pdf["lang"].str.upper(), answer=pdf["source"])[["doc_id", "question", "answer"]]


@query("U02_user_conversion", """select doc_id, upper(lang) as question, source as answer from documents""")
def u02(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    full = convert.user_conversion(d, _user_fn, "doc_id long, question string, answer string")
    e = convert.csv_qa_to_erniekit(full, keep=["doc_id"])
    return e.select("doc_id", F.col("text_info")[0]["text"].alias("question"), F.col("text_info")[1]["text"].alias("answer"))


@query("U03_archive_members", """select doc_id, lang, text from documents""")
def u03(spark, sf):
    """The documents back from the members of their archives."""
    m = S.read_archive(spark, _archives(spark, sf), with_content=True).where(F.col("member").endswith(".jsonl"))
    rec = m.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where(F.col("line") != "").select(
        F.from_json("line", "doc_id bigint, lang string, text string").alias("r"))
    return rec.select("r.*")
