"""Corpus queries: conversion, cleaning, validation, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import clean, convert, profile
from kiln.plans.catalog import query
from kiln.plans.views import duck_strip, spread, table, v_jsonl

# ------------------------------------------------------------ conversion


def _messages(spark, sf):
    return convert.turns_to_messages(table(spark, sf, "conversations"))


@query("F06_turns_to_messages", """
select conv_id, count(*)::bigint as n_messages, string_agg(role, ',' order by turn) as roles,
       sum(length(text))::bigint as chars
from conversations group by conv_id""")
def f06(spark, sf):
    m = _messages(spark, sf)
    return m.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
                    F.aggregate(F.transform("messages", lambda x: F.char_length(x["content"])),
                                F.lit(0).cast("bigint"), lambda a, b: a + b).alias("chars"))


@query("F01_messages_to_erniekit", """
select conv_id, string_agg(case when role = 'user' then 'mask' else 'no_mask' end, ',' order by turn) as tags,
       string_agg(text, '|' order by turn) as texts, count(*) filter (where role = 'user')::bigint as n_mask, 0::bigint as n_images
from conversations group by conv_id""")
def f01(spark, sf):
    e = convert.messages_to_erniekit(_messages(spark, sf))
    return e.select("conv_id", F.array_join(F.transform("text_info", lambda t: t["tag"]), ",").alias("tags"),
                    F.array_join(F.transform("text_info", lambda t: t["text"]), "|").alias("texts"),
                    F.size(F.filter("text_info", lambda t: t["tag"] == "mask")).cast("bigint").alias("n_mask"),
                    F.size("image_info").cast("bigint").alias("n_images"))


@query("F02_erniekit_to_messages", """
select conv_id, string_agg(case when role = 'user' then 'user' else 'assistant' end, ',' order by turn) as roles,
       string_agg(text, '|' order by turn) as texts, true as images_omitted
from conversations group by conv_id""")
def f02(spark, sf):
    m = convert.erniekit_to_messages(convert.messages_to_erniekit(_messages(spark, sf)))
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
                    F.array_join(F.transform("messages", lambda x: x["content"]), "|").alias("texts"),
                    F.col("images").isNull().alias("images_omitted"))


def _qa_table(spark, sf):
    # question = a user turn, answer = the turn after it; blank texts skip
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return (c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
             .join(a, ["conv_id", "turn"]))


@query("F03_csv_qa_to_erniekit", f"""
select q.conv_id, q.turn, {duck_strip('q.text')} as question, {duck_strip('a.text')} as answer
from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
where q.role = 'user' and {duck_strip('q.text')} <> '' and {duck_strip('a.text')} <> ''""")
def f03(spark, sf):
    e = convert.csv_qa_to_erniekit(_qa_table(spark, sf), keep=["conv_id", "turn"])
    return e.select("conv_id", "turn", F.col("text_info")[0]["text"].alias("question"),
                    F.col("text_info")[1]["text"].alias("answer"))


@query("F04_conversion_stats", f"""
select count(*) filter (where {duck_strip('q.text')} <> '' and {duck_strip('a.text')} <> '')::bigint as converted,
       count(*) filter (where not ({duck_strip('q.text')} <> '' and {duck_strip('a.text')} <> ''))::bigint as skipped
from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
where q.role = 'user'""")
def f04(spark, sf):
    src = _qa_table(spark, sf)
    return convert.conversion_stats(src, convert.csv_qa_to_erniekit(src))


_ENTRY_SQL = f"""
with t as (select conv_id, sum(length({duck_strip('text')}))::bigint as tlen,
                  bool_or({duck_strip('text')} <> '') as keep
           from conversations group by conv_id),
k as (select tlen, row_number() over (order by tlen) - 1 as i, count(*) over () as n from t where keep)
select count(*)::bigint as num_samples, 0::bigint as image_count, false as has_images,
       min(tlen)::bigint as len_min, max(tlen)::bigint as len_max,
       round_even(sum(tlen) / count(*), 0)::bigint as len_avg,
       max(case when i = n // 2 then tlen end)::bigint as len_p50,
       max(case when i = (case when n > 20 then floor(n * 0.95::double) else n - 1 end) then tlen end)::bigint as len_p95
from k"""


@query("P04_conversation_profile", _ENTRY_SQL)
def conversation_profile(spark, sf):
    """F06 -> F01 -> C03 -> C04 -> P03/P04: the flagship query."""
    e = convert.messages_to_erniekit(_messages(spark, sf))
    e = clean.normalize_text(clean.drop_empty_typed(e))
    return profile.profile_typed(e)


# ------------------------------------------------------------ cleaning

_DUCK_PARSE = f"""p as (select line_no, source, {duck_strip('line')} as s from v_jsonl),
d as (select *, case when s = '' then 'blank'
                     when not json_valid(s) or json_type(s) <> 'OBJECT' then 'json_error'
                     else 'ok' end as state from p)"""


def _duck_empty(s: str) -> str:
    """DuckDB spelling of C03 (``clean.is_empty_record``) on JSON text ``s``."""
    def blank(x):
        return f"{duck_strip(x)} = ''"
    scal = (f"list_filter(json_keys({s}), lambda k: json_type({s}, '$.\"' || k || '\"') in ('BIGINT','UBIGINT','DOUBLE','BOOLEAN') "
            f"or (json_type({s}, '$.\"' || k || '\"') = 'VARCHAR' and not {blank(f'json_extract_string({s}, ' + chr(39) + '$.' + chr(34) + chr(39) + ' || k || ' + chr(39) + chr(34) + chr(39) + ')')}))")

    def lst(key, fld):
        nonblank = f"not {blank(f'json_extract_string(t, {chr(39)}$.{fld}{chr(39)})')}"
        return (f"(json_type({s}, '$.{key}') = 'ARRAY' and not coalesce(list_bool_or(list_transform(json_extract({s}, '$.{key}[*]'), "
                f"lambda t: json_type(t) = 'OBJECT' and json_exists(t, '$.{fld}') and (json_type(t, '$.{fld}') <> 'VARCHAR' "
                f"or {nonblank}))), false))")
    return (f"case when json_exists({s}, '$.text_info') then {lst('text_info', 'text')} "
            f"when json_exists({s}, '$.messages') then {lst('messages', 'content')} "
            f"else len({scal}) = 0 end")


@query("C01_valid_objects", f"""
with {_DUCK_PARSE}
select line_no, s as line from d where state = 'ok'""", views=("v_jsonl",))
def c01(spark, sf):
    return clean.valid_objects(v_jsonl(spark, sf)).select("line_no", F.col("s").alias("line"))


@query("C02_dedup_exact", f"""
with {_DUCK_PARSE}
select min(line_no) as line_no, s as line, md5(s) as md5 from d where state = 'ok' group by s""", views=("v_jsonl",))
def c02(spark, sf):
    return clean.dedup_exact(v_jsonl(spark, sf), pos="line_no").select("line_no", "line", "md5")


@query("C03_drop_empty", f"""
with {_DUCK_PARSE}
select min(line_no) as line_no, s as line from d where state = 'ok' and not ({_duck_empty('s')})
group by s""", views=("v_jsonl",))
def c03(spark, sf):
    return clean.dedup_exact(v_jsonl(spark, sf), pos="line_no", drop_empty=True).select("line_no", "line")


_C05_SQL = f"""
with {_DUCK_PARSE},
h as (select {{by}} md5(s) as h, count(*) as n, bool_or({_duck_empty('s')}) as e from d where state = 'ok' group by {{by}} md5(s)),
c as (select {{by}} count(*) as input_lines, count(*) filter (where state = 'json_error') as json_errors from d group by all),
x as (select {{by}} sum(n - 1) as duplicates, count(*) filter (where e) as empty_content,
             count(*) filter (where not e) as valid_lines from h group by all)
select {{by}} c.input_lines::bigint as input_lines, c.json_errors::bigint as json_errors,
       coalesce(x.duplicates, 0)::bigint as duplicates, coalesce(x.empty_content, 0)::bigint as empty_content,
       coalesce(x.valid_lines, 0)::bigint as valid_lines, coalesce(x.valid_lines, 0)::bigint as output_lines
from c left join x on {{on}}"""


@query("C05_clean_stats", _C05_SQL.replace("{by}", "").replace("{on}", "true").replace("c.input_lines", "c.input_lines"),
       views=("v_jsonl",))
def c05(spark, sf):
    return clean.clean_stats(v_jsonl(spark, sf))


@query("C05_clean_stats_by_source",
       _C05_SQL.replace("select {by}", "select source,").replace("group by {by}", "group by source,")
               .replace("{on}", "c.source = x.source").replace("select source, c.input_lines", "select c.source, c.input_lines"),
       views=("v_jsonl",))
def c05s(spark, sf):
    return clean.clean_stats(v_jsonl(spark, sf), by=["source"])


@query("C06_detect_format", """
select source, case when count(*) filter (where json_type(line) = 'OBJECT' and json_exists(line, '$.image_info') and json_exists(line, '$.text_info')) > 0 then 'erniekit'
  when count(*) filter (where json_type(line) = 'OBJECT' and json_exists(line, '$.messages')) > 0 then 'messages' end as format
from v_jsonl_chat group by source""")
def c06(spark, sf):
    return clean.detect_format(v_jsonl_chat(spark, sf), pos="line_no", by=["source"])


def v_jsonl_chat(spark, sf):
    """Documents as JSON lines in the two record formats: even ids as
    erniekit, odd ids as messages, every 23rd as a bare object."""
    d = table(spark, sf, "documents")
    ek = F.to_json(F.struct(F.array().cast("array<struct<image_url:string,matched_text_index:int>>").alias("image_info"),
                            F.array(F.struct(F.col("text").alias("text"), F.lit("no_mask").alias("tag"))).alias("text_info")))
    ms = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages")))
    other = F.to_json(F.struct(F.col("lang").alias("lang")))
    line = F.when(F.col("doc_id") % 23 == 0, other).when(F.col("doc_id") % 2 == 0, ek).otherwise(ms)
    d = spread(d)
    return d.select(F.col("doc_id").alias("line_no"), "source", line.alias("line"))


_DUCK_CHAT = """select doc_id as line_no, source,
  case when doc_id % 23 = 0 then json_object('lang', lang)::varchar
       when doc_id % 2 = 0 then json_object('image_info', json('[]'), 'text_info', json_array(json_object('text', text, 'tag', 'no_mask')))::varchar
       else json_object('messages', json_array(json_object('role', 'user', 'content', text)))::varchar end as line
from documents"""

from kiln.plans import views as _views  # noqa: E402

_views.DUCK["v_jsonl_chat"] = _DUCK_CHAT
# register the view CTE for C06 after the fact
from kiln.plans import catalog as _catalog  # noqa: E402

_catalog._ORACLE["C06_detect_format"] = _views.with_views(_catalog._ORACLE["C06_detect_format"], "v_jsonl_chat")


@query("P09_profile_by_source", f"""
with k as (select source, doc_id, length(text)::bigint as tlen, doc_id % 23 <> 0 as has_text from documents),
s as (select source, tlen, row_number() over (partition by source order by tlen) - 1 as i,
             count(*) over (partition by source) as n from k where has_text),
st as (select source, min(tlen)::bigint as len_min, max(tlen)::bigint as len_max,
              round_even(sum(tlen) / count(*), 0)::bigint as len_avg,
              max(case when i = n // 2 then tlen end)::bigint as len_p50,
              max(case when i = (case when n > 20 then floor(n * 0.95::double) else n - 1 end) then tlen end)::bigint as len_p95
       from s group by source),
c as (select source, count(*)::bigint as num_samples from k group by source)
select c.source, c.num_samples, 0::bigint as json_errors, 0::bigint as image_count, false as has_images,
       len_min, len_max, len_avg, len_p50, len_p95
from c left join st on c.source = st.source""")
def p09(spark, sf):
    return profile.profile(v_jsonl_chat(spark, sf), by=["source"])


@query("P01_profile", """
select count(*) filter (where (case when json_valid(line) then json_type(line) end) = 'OBJECT')::bigint as num_samples,
       count(*) filter (where not json_valid(line))::bigint as json_errors, 0::bigint as image_count, false as has_images,
       null::bigint as len_min, null::bigint as len_max, null::bigint as len_avg, null::bigint as len_p50, null::bigint as len_p95
from v_jsonl""", views=("v_jsonl",))
def p01(spark, sf):
    return profile.profile(v_jsonl(spark, sf))


@query("P02_field_coverage", """
with o as (select source, line from v_jsonl_chat where json_type(line) = 'OBJECT'),
n as (select source, count(*) as n from o group by source),
k as (select source, unnest(list_distinct(json_keys(line))) as key from o)
select k.source, key, count(*)::bigint as rows_with_key, round_even(count(*) / any_value(n.n), 2) as coverage
from k join n on k.source = n.source group by k.source, key""", views=("v_jsonl_chat",))
def p02(spark, sf):
    return profile.field_coverage(v_jsonl_chat(spark, sf), by=["source"])


@query("P06_quality_flags", """
with p as (select source, count(*) filter (where (case when json_valid(line) then json_type(line) end) = 'OBJECT') as num_samples,
                  count(*) filter (where not json_valid(line)) as json_errors from v_jsonl group by source)
select source, num_samples::bigint as num_samples, json_errors::bigint as json_errors,
  case when json_errors > 0 then concat(cast(round_even(json_errors / (num_samples + json_errors) * 100, 1) as varchar), '% lines have JSON errors') end as flag
from p""", views=("v_jsonl",))
def p06(spark, sf):
    p = profile.quality_flags(profile.profile(v_jsonl(spark, sf), by=["source"]))
    return p.select("source", "num_samples", "json_errors", F.try_element_at("quality_flags", F.lit(1)).alias("flag"))


@query("C17_infer_schema", """
with o as (select line_no, line from v_jsonl_chat where json_type(line) = 'OBJECT'),
kv as (select line_no, unnest(json_keys(line)) as key, line from o),
f as (select key, min(line_no) as first_pos from kv group by key)
select f.key, case json_type(o.line, '$.' || f.key) when 'VARCHAR' then 'str' when 'ARRAY' then
  'list[' || coalesce(case json_type(o.line, '$.' || f.key || '[0]') when 'OBJECT' then 'dict' when 'VARCHAR' then 'str' end, 'any') || ']'
  when 'OBJECT' then 'dict' when 'BIGINT' then 'int' when 'DOUBLE' then 'float' end as type, f.first_pos
from f join o on o.line_no = f.first_pos""", views=("v_jsonl_chat",))
def c17(spark, sf):
    return clean.infer_schema(v_jsonl_chat(spark, sf), pos="line_no", n=None).select("key", "type", "first_pos")


# ------------------------------------------------------------ more cleaning / validation

@query("C04_normalize_text", f"""
select conv_id, turn, {duck_strip('text')} as text from conversations""")
def c04(spark, sf):
    e = clean.normalize_text(_messages(spark, sf))
    return (e.select("conv_id", F.posexplode("messages").alias("turn", "m"))
             .select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.content").alias("text")))


def v_jsonl_ek(spark, sf):
    """erniekit-style lines with the usual defects: every 17th has no
    image_info, every 19th a string text_info, every 23rd an empty
    text_info, every 29th is not JSON; image urls are relative."""
    d = table(spark, sf, "documents")
    url = F.concat(F.lit('"./img/'), F.col("doc_id").cast("string"), F.lit('.png"'))
    good = F.concat(F.lit('{"image_info":[{"image_url":'), url, F.lit(',"matched_text_index":0}],"text_info":[{"text":"'),
                    F.col("lang"), F.lit('","tag":"mask"}]}'))
    line = (F.when(F.col("doc_id") % 29 == 0, F.lit("{broken"))
             .when(F.col("doc_id") % 23 == 0, F.lit('{"image_info":[],"text_info":[]}'))
             .when(F.col("doc_id") % 19 == 0, F.lit('{"image_info":[],"text_info":"x"}'))
             .when(F.col("doc_id") % 17 == 0, F.lit('{"text_info":[]}'))
             .otherwise(good))
    return d.select(F.col("doc_id").alias("line_no"), line.alias("line"))


_DUCK_EK = """select doc_id as line_no, case when doc_id % 29 = 0 then '{broken'
  when doc_id % 23 = 0 then '{"image_info":[],"text_info":[]}'
  when doc_id % 19 = 0 then '{"image_info":[],"text_info":"x"}'
  when doc_id % 17 == 0 then '{"text_info":[]}'
  else concat('{"image_info":[{"image_url":"./img/', cast(doc_id as varchar), '.png","matched_text_index":0}],"text_info":[{"text":"', lang, '","tag":"mask"}]}') end as line
from documents"""
_views.DUCK["v_jsonl_ek"] = _DUCK_EK

_EK_ERRS = """e as (select line_no, list_filter([
    case when not json_valid(line) then 'Invalid JSON' end,
    case when json_valid(line) and not json_exists(line, '$.image_info') then 'Missing required field ''image_info'''
         when json_valid(line) and not json_exists(line, '$.text_info') then 'Missing required field ''text_info''' end,
    case when json_valid(line) and json_exists(line, '$.image_info') and json_type(line, '$.image_info') <> 'ARRAY' then '''image_info'' must be a list' end,
    case when json_valid(line) and json_exists(line, '$.text_info') and json_type(line, '$.text_info') <> 'ARRAY' then '''text_info'' must be a list' end],
  lambda x: x is not null) as errs from v_jsonl_ek),
c as (select * from e where len(errs) > 0)"""


@query("C07_validate_erniekit", f"""with {_EK_ERRS}
select line_no, unnest(range(len(errs))) as k, 'Line ' || line_no || ': ' || unnest(errs) as error from c""",
       views=("v_jsonl_ek",))
def c07(spark, sf):
    return clean.validation_errors(v_jsonl_ek(spark, sf), "erniekit", pos="line_no")


@query("C08_validate_messages", """
select line_no, 0 as k, 'Line ' || line_no || ': ' || case when not json_valid(line) then 'Invalid JSON'
  when not json_exists(line, '$.messages') then 'Missing ''messages'' field' else '''messages'' must be a list' end as error
from v_jsonl_chat
where case when json_valid(line) then not json_exists(line, '$.messages') or json_type(line, '$.messages') <> 'ARRAY' else true end""",
       views=("v_jsonl_chat",))
def c08(spark, sf):
    return clean.validation_errors(v_jsonl_chat(spark, sf), "messages", pos="line_no", max_errors=None)


@query("C09_validation_summary", f"""with {_EK_ERRS},
s as (select coalesce(sum(len(errs)), 0) as n_errors from c)
select 'erniekit' as format, n_errors = 0 as valid, n_errors::bigint as n_errors,
  (select count(*) from v_jsonl_ek where trim(line) <> '')::bigint as samples_checked
from s""", views=("v_jsonl_ek",))
def c09(spark, sf):
    return clean.validation_summary(v_jsonl_ek(spark, sf), "erniekit", pos="line_no")


@query("C10_missing_images", """with u as (select line_no, unnest(json_extract_string(line, '$.image_info[*].image_url')) as url,
  generate_subscripts(json_extract_string(line, '$.image_info[*].image_url'), 1) - 1 as k
  from v_jsonl_ek where json_valid(line) and json_type(line, '$.image_info') = 'ARRAY'),
m as (select line_no, k, url, '/data/set/' || substr(url, 3) as path from u where starts_with(url, './'))
select line_no, k::int as k, url, 'Line ' || line_no || ': ' || url as missing from m
where path not in (select '/data/set/img/' || cast(doc_id as varchar) || '.png' from labels where quality = 1)""", views=("v_jsonl_ek",))
def c10(spark, sf):
    have = table(spark, sf, "labels").where("quality = 1").select(
        F.concat(F.lit("/data/set/img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return clean.missing_images(v_jsonl_ek(spark, sf).withColumnRenamed("line_no", "pos"), have, "/data/set")


@query("C11_image_drop", """with h as (select line from v_jsonl_ek where json_valid(line))
select count(*)::bigint as rows_checked,
  count(*) filter (where json_type(line, '$.image_info') = 'ARRAY' and json_array_length(line, '$.image_info') > 0)::bigint as rows_with_images,
  count(*) > 0 and (count(*) filter (where json_type(line, '$.image_info') = 'ARRAY' and json_array_length(line, '$.image_info') > 0)) / count(*) < 0.1 as dropped
from h""", views=("v_jsonl_ek",))
def c11(spark, sf):
    r = clean.image_drop(v_jsonl_ek(spark, sf).withColumnRenamed("line_no", "pos"), True)
    return r.select(F.col("rows_checked").cast("bigint").alias("rows_checked"),
                    F.col("rows_with_images").cast("bigint").alias("rows_with_images"), "dropped")


@query("C12_image_columns", "select table_name as tbl, column_name as col, lower(column_name) in ("
       + ", ".join(f"'{c}'" for c in clean.PARQUET_IMAGE_COLUMNS)
       + ") as is_image from information_schema.columns where table_name in ('embeddings', 'pages', 'documents')")
def c12(spark, sf):
    cols = [(t, c) for t in ("embeddings", "pages", "documents") for c in clean.image_columns(table(spark, sf, t))]
    names = [(t, c) for t in ("embeddings", "pages", "documents") for c in table(spark, sf, t).columns]
    return spark.createDataFrame(names, "tbl string, col string").withColumn(
        "is_image", F.struct("tbl", "col").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in cols]) if cols else F.lit(False))


@query("C13_csv_has_images", """with l as (select * from (values (0, 'question,answer,image_path')) t(line_no, line)
  union all select doc_id + 1, concat(source, ',', lang, ',', case when doc_id % 3 = 0 then 'img/' || doc_id || '.png' else '' end) from documents),
h as (select * from l)
select coalesce(bool_or(case when line_no = 0 then contains(lower(line), 'image') or contains(lower(line), 'path')
  else regexp_matches(lower(line), '\\.(jpg|jpeg|png|bmp|webp|tif|tiff|gif)') end), false) as has_images from h""")
def c13(spark, sf):
    d = table(spark, sf, "documents")
    body = d.select((F.col("doc_id") + 1).alias("line_no"),
                    F.concat_ws(",", "source", "lang", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png"))).otherwise(F.lit(""))).alias("line"))
    lines = spark.createDataFrame([(0, "question,answer,image_path")], "line_no long, line string").unionByName(body)
    return clean.csv_has_images(lines, pos="line_no")


@query("C14_jsonl_has_images", """with h as (select line from v_jsonl_ek)
select coalesce(bool_or(case when json_valid(line) then json_type(line) = 'OBJECT' and len(list_intersect(json_keys(line), ['image', 'img', 'image_bytes', 'image_url'])) > 0 else false end), false) as has_images from h""",
       views=("v_jsonl_ek",))
def c14(spark, sf):
    return clean.jsonl_has_images(v_jsonl_ek(spark, sf), pos="line_no")


@query("C15_source_has_images", """select coalesce(bool_or(regexp_matches(lower(url), '\\.(jpg|jpeg|png|bmp|webp|tif|tiff|gif)$')), false) as has_images
from (select url as url from pages)""")
def c15(spark, sf):
    inv = table(spark, sf, "pages").select(F.col("url").alias("path"))
    return clean.source_has_images(inv)


@query("C16_nan_to_null", """select event_id, case when value > 400 then null else value end as value from events""")
def c16(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("value") > 400, F.lit(float("nan")))
                                          .otherwise(F.col("value")).alias("value"))
    return clean.nan_to_null(e)


@query("C18_head", """select doc_id, source from documents order by doc_id limit 10""")
def c18(spark, sf):
    return clean.head(table(spark, sf, "documents").select("doc_id", "source"), 10, pos="doc_id")


@query("C19_sample_rows", """select doc_id, source from documents order by md5('42|' || cast(doc_id as varchar)), doc_id limit 10""")
def c19(spark, sf):
    return clean.sample_rows(table(spark, sf, "documents").select("doc_id", "source"), 10, "doc_id", seed=42)


@query("C20_clean_annotation", f"""with t as (select item_id, case when item_id % 3 = 0 then '```html' || chr(10) || text || '```'
  when item_id % 3 = 1 then '```' || text || '```' else text end as x from benchmark),
a as (select item_id, case when starts_with(x, '```html') then {duck_strip("replace(replace(x, '```html' || chr(10), ''), '```', '')")} else x end as x from t),
b as (select item_id, case when starts_with(x, '```') then {duck_strip("replace(x, '```', '')")} else x end as x from a)
select item_id, case when length(x) > 300 then substring(x, 1, 300) || '...' else x end as text from b""")
def c20(spark, sf):
    b = table(spark, sf, "benchmark")
    x = (F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("```html\n"), F.col("text"), F.lit("```")))
          .when(F.col("item_id") % 3 == 1, F.concat(F.lit("```"), F.col("text"), F.lit("```"))).otherwise(F.col("text")))
    return b.select("item_id", clean.clean_annotation(x).alias("text"))


# ------------------------------------------------------------ more conversion / profiling

@query("F05_convert_registry", """
select conv_id, string_agg(case when role = 'user' then 'user' else 'assistant' end, ',' order by turn) as roles
from conversations group by conv_id""")
def f05(spark, sf):
    e = convert.convert(_messages(spark, sf), "messages", "erniekit")
    m = convert.convert(e, "erniekit", "messages")
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"))


@query("F07_ocr_to_erniekit", """select doc_id, coalesce(nullif(text, ''), '') as answer, './img/' || doc_id || '.png' as image from documents""")
def f07(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text",
                                             F.concat(F.lit("./img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"))
    e = convert.ocr_to_erniekit(d)
    return e.select("doc_id", F.col("text_info")[1]["text"].alias("answer"), F.col("image_info")[0]["image_url"].alias("image"))


@query("F08_vqa_to_erniekit", """select conv_id, turn, case when turn % 4 = 0 then 'Describe this image.' else text end as question
from conversations where role = 'user'""")
def f08(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("question"),
        F.lit("a").alias("answer"), F.lit("./i.png").alias("image"))
    e = convert.vqa_to_erniekit(c)
    return e.select("conv_id", "turn", F.col("text_info")[0]["text"].alias("question"))


@query("F09_bboxes_to_erniekit", """select doc_id, (n_chars % 7) || ' regions' as answer from documents""")
def f09(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.array_repeat(F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), (F.col("n_chars") % 7).cast("int")).alias("bboxes"),
        F.lit("./i.png").alias("image_path"))
    return convert.bboxes_to_erniekit(d).select("doc_id", F.col("text_info")[1]["text"].alias("answer"))


@query("F10_absolutize_images", """select line_no, '/data/set/img/' || line_no || '.png' as url from v_jsonl_ek
where json_valid(line) and json_type(line, '$.image_info') = 'ARRAY' and json_array_length(line, '$.image_info') > 0""",
       views=("v_jsonl_ek",))
def f10(spark, sf):
    v = v_jsonl_ek(spark, sf)
    e = v.select("line_no", F.from_json("line", "image_info array<struct<image_url:string,matched_text_index:int>>").alias("r")) \
         .select("line_no", "r.image_info").where(F.size("image_info") > 0)
    a = convert.absolutize_images(e, "/data/set")
    return a.select("line_no", F.col("image_info")[0]["image_url"].alias("url"))


@query("P03_text_length", """select doc_id, length(text)::bigint as tlen from documents where doc_id % 23 <> 0""")
def p03(spark, sf):
    p = clean.parse_lines(v_jsonl_chat(spark, sf)).where("is_object")
    return p.select(F.col("line_no").alias("doc_id"), profile.text_length_variant(F.col("v")).alias("tlen")).where(
        F.col("tlen").isNotNull())


@query("P05_image_count", """select source, count(*) filter (where n > 0)::bigint as n_with_images, coalesce(sum(n), 0)::bigint as image_count
from (select d.source, case when json_valid(v.line) then (case when json_type(v.line, '$.image_info') = 'ARRAY'
  then json_array_length(v.line, '$.image_info') else 0 end) end as n
  from v_jsonl_ek v join documents d on v.line_no = d.doc_id) t where n is not null group by source""", views=("v_jsonl_ek",))
def p05(spark, sf):
    v = v_jsonl_ek(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), "source"), "line_no")
    p = clean.parse_lines(v).where("is_object").select("source", profile.image_count_variant(F.col("v")).alias("n"))
    return p.groupBy("source").agg(F.count_if(F.col("n") > 0).cast("bigint").alias("n_with_images"),
                                   F.sum("n").cast("bigint").alias("image_count"))


@query("P07_recommendations",
       "select source, array_to_string(list_filter(["
       f"case when json_errors > 0 then '{profile.REC_INVALID}' end, "
       f"case when num_samples < {profile.SMALL_DATASET} then '{profile.REC_SMALL}' end, "
       f"case when coalesce(len_avg, 0) > {profile.LONG_AVG_TEXT} then '{profile.REC_LONG}' end], "
       "lambda r: r is not null), ' | ') as recommendations, "
       "case when json_errors = 0 then 1.0 else 0.5 end as quality_score from (\n"
       + _catalog._ORACLE["P09_profile_by_source"] + "\n) p")
def p07(spark, sf):
    p = profile.profile(v_jsonl_chat(spark, sf), by=["source"])
    return profile.recommendations(p, F.col("json_errors") == 0).select(
        "source", F.array_join("recommendations", " | ").alias("recommendations"), "quality_score")


@query("P08_size_mb", """select round_even(sum(length('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}') + 1) / 1024.0 / 1024.0, 2) as size_mb
from documents""")
def p08(spark, sf):
    """Size of a dataset of many JSON files, from their metadata."""
    from kiln.session import scratch_path
    p = scratch_path(spark, "size")
    table(spark, sf, "documents").select("doc_id", "n_chars").repartition(7).write.json(p)
    return profile.size_mb(spark.read.json(p))


@query("P10_processing_summary", """with p as (select source, case when min(doc_id) % 3 = 0 then 'failed' when min(doc_id) % 5 = 0 then 'skipped'
  else 'completed' end as status, count(*) as num_samples, sum(n_chars % 3) as image_count from documents group by source)
select count(*)::bigint as total, count(*) filter (where status = 'completed')::bigint as completed,
  count(*) filter (where status = 'failed')::bigint as failed, count(*) filter (where status = 'skipped')::bigint as skipped,
  coalesce(sum(num_samples) filter (where status = 'completed'), 0)::bigint as total_samples,
  coalesce(sum(image_count) filter (where status = 'completed'), 0)::bigint as total_images from p""")
def p10(spark, sf):
    d = table(spark, sf, "documents")
    idx = d.groupBy("source").agg(
        F.when(F.min("doc_id") % 3 == 0, "failed").when(F.min("doc_id") % 5 == 0, "skipped").otherwise("completed").alias("status"),
        F.count(F.lit(1)).alias("num_samples"), F.sum(F.col("n_chars") % 3).alias("image_count"))
    return profile.processing_summary(idx).select(*[F.col(c).cast("bigint").alias(c) for c in
                                                    ["total", "completed", "failed", "skipped", "total_samples", "total_images"]])


@query("P11_text_len", """select item_id, length(text)::bigint as text_len from benchmark""")
def p11(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.char_length("text").cast("bigint").alias("text_len"))


@query("C05_clean_lines", f"""with l as (select doc_id as line_no, '{{"messages":[{{"content":"  ' || lang || ' ","role":"user"}}' || case when doc_id % 3 = 0 then ',{{"role":"x"}}' else '' end
  || '],"n":' || doc_id % 50 || '}}' as line, doc_id % 50 as n, lang, doc_id % 3 = 0 as extra from documents)
select min(line_no) as line_no, '{{"messages":[{{"content":"' || lang || '","role":"user"}}' || case when extra then ',{{"role":"x"}}' else '' end
  || '],"n":' || n || '}}' as line from l group by n, lang, extra""")
def c05_lines(spark, sf):
    """What a clean run writes: first copies with their contents stripped."""
    d = table(spark, sf, "documents")
    line = F.concat(F.lit('{"messages":[{"content":"  '), F.col("lang"), F.lit(' ","role":"user"}'),
                    F.when(F.col("doc_id") % 3 == 0, F.lit(',{"role":"x"}')).otherwise(F.lit("")),
                    F.lit('],"n":'), (F.col("doc_id") % 50).cast("string"), F.lit("}"))
    return clean.clean_lines(d.select(F.col("doc_id").alias("line_no"), line.alias("line")), pos="line_no").select("line_no", "line")
