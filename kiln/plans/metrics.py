"""Text-metric and token-budget queries over derived pairs (whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions.editdistance import edit_distance
from kiln.operators import textmetrics as T
from kiln.plans.catalog import query
from kiln.plans.views import duck_words, spread, table, v_pairs, v_word_pairs


@query("T01_edit_distance", """
select doc_id, (length(ref) - length(pred))::bigint as dist from v_pairs""", views=("v_pairs",))
def t01(spark, sf):
    return v_pairs(spark, sf).select("doc_id", edit_distance("pred", "ref").cast("bigint").alias("dist"))


@query("T03_ned", """
select source, round_even(coalesce(avg(case when greatest(length(pred), length(ref)) > 0
  then (length(ref) - length(pred)) / length(ref) end), 0.0), 6) as ned
from v_pairs group by source""", views=("v_pairs",))
def t03(spark, sf):
    d = T.pair_distances(v_pairs(spark, sf).select("source", "pred", "ref"))
    return d.groupBy("source").agg(F.bround(T.ned_agg(), 6).alias("ned"))


@query("T04_cer", """
select source, round_even(case when sum(length(ref)) = 0 then 0.0
  else sum(length(ref) - length(pred)) / sum(length(ref)) end, 6) as cer
from v_pairs group by source""", views=("v_pairs",))
def t04(spark, sf):
    p = v_pairs(spark, sf)
    d = p.select("source", edit_distance("pred", "ref").alias("dist"), F.char_length("ref").alias("ref_len"))
    return d.groupBy("source").agg(F.bround(T.cer_agg(), 6).alias("cer"))


_WORDS = f"""w as (select source, doc_id, pred, ref, length(ref) as rc, length(ref) - length(pred) as dist,
  {duck_words('ref')} as rw, {duck_words('ref')} - {duck_words('pred')} as wdist from v_word_pairs)"""
_BUNDLE = f"""{_WORDS},
b as (select source, round_even(coalesce(avg(case when rc > 0 then dist / rc end), 0.0), 6) as ned,
  round_even(case when sum(rc) = 0 then 0.0 else sum(dist) / sum(rc) end, 6) as cer,
  round_even(case when sum(rw) = 0 then 0.0 else sum(wdist) / sum(rw) end, 6) as wer,
  round_even(coalesce(avg(case when pred = ref then 1.0 else 0.0 end), 0.0), 6) as exact_match, count(*)::bigint as num_samples
  from w group by source)"""


@query("T05_wer", f"""with {_WORDS}
select source, round_even(case when sum(rw) = 0 then 0.0 else sum(wdist) / sum(rw) end, 6) as wer from w group by source""",
       views=("v_word_pairs",))
def t05(spark, sf):
    d = T.pair_distances(v_word_pairs(spark, sf).select("source", "pred", "ref"))
    return d.groupBy("source").agg(F.bround(T.wer_agg(), 6).alias("wer"))


@query("T06_exact_match", """
select source, round_even(coalesce(avg(case when pred = ref then 1.0 else 0.0 end), 0.0), 6) as exact_match,
       count(*)::bigint as num_samples
from v_pairs group by source""", views=("v_pairs",))
def t06(spark, sf):
    p = v_pairs(spark, sf).withColumn("exact", F.col("pred") == F.col("ref"))
    return p.groupBy("source").agg(F.bround(T.exact_match_agg(), 6).alias("exact_match"),
                                   F.count(F.lit(1)).cast("bigint").alias("num_samples"))


@query("T07_ocr_metrics", f"""with {_BUNDLE}
select * from b""", views=("v_word_pairs",))
def t07(spark, sf):
    return T.ocr_metrics(v_word_pairs(spark, sf).select("source", "pred", "ref"), by=["source"])


def v_html_pairs(spark, sf):
    """Reference HTML = the page; prediction = list items turned into
    paragraphs and links unwrapped (closing tags dropped)."""
    p = spread(table(spark, sf, "pages"))
    pred = F.replace(F.replace("html", F.lit("<li>"), F.lit("<p>")), F.lit("</a>"), F.lit(""))
    return p.select("page_id", pred.alias("pred_html"), F.col("html").alias("ref_html"))


_TEDS_SQL = """
with p as (select page_id, replace(replace(html, '<li>', '<p>'), '</a>', '') as pred_html, html as ref_html from pages),
t as (select page_id, regexp_extract_all(pred_html, '<(/?\\w+)[^>]*>', 1) as pt,
             regexp_extract_all(ref_html, '<(/?\\w+)[^>]*>', 1) as rt from p),
v as (select tag, chr(33 + row_number() over (order by tag)::int) as c
      from (select distinct unnest(pt || rt) as tag from t)),
m as (select map(list(tag), list(c)) as m from v),
e as (select page_id, len(pt) as np, len(rt) as nr,
             array_to_string(list_transform(pt, lambda x: m.m[x]), '') as a,
             array_to_string(list_transform(rt, lambda x: m.m[x]), '') as b from t, m)
"""


@query("T08_teds", _TEDS_SQL + """
select page_id, case when nr = 0 then (case when np = 0 then 1.0 else 0.0 end)
  else 1.0 - levenshtein(a, b) / greatest(np, nr) end as teds from e""")
def t08(spark, sf):
    h = v_html_pairs(spark, sf)
    return h.select("page_id", T.teds("pred_html", "ref_html").alias("teds"))


@query("T09_teds_mean", _TEDS_SQL + """
select coalesce(avg(case when nr = 0 then (case when np = 0 then 1.0 else 0.0 end)
  else 1.0 - levenshtein(a, b) / greatest(np, nr) end), 0.0) as teds, count(*)::bigint as num_samples from e""")
def t09(spark, sf):
    return T.teds_mean(v_html_pairs(spark, sf))


@query("T10_align_pairs", """
select doc_id, pred, ref from v_pairs""", views=("v_pairs",))
def t10(spark, sf):
    p = v_pairs(spark, sf)
    return T.align_pairs(p.select("doc_id", "pred"), p.select("doc_id", "ref"), "doc_id")


@query("T12_est_tokens", """
select doc_id, greatest(1, length(text) // 3)::bigint as tokens from documents""")
def t12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.est_tokens("text").alias("tokens"))


@query("T13_est_tokens_total", """
select source, sum(greatest(1, length(text) // 3))::bigint as tokens from documents group by source""")
def t13(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.sum(T.est_tokens("text")).cast("bigint").alias("tokens"))


@query("T14_truncate_tail", """
select doc_id, case when greatest(1, length(text) // 3) <= 500 then text
  else concat(substring(text, 1, floor(length(text)::double * (500.0 / greatest(1, length(text) // 3)::double))::int), chr(10) || '...[truncated]') end as text
from documents""")
def t14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_tail("text", 500).alias("text"))


@query("T15_truncate_head", """
select doc_id, case when greatest(1, length(text) // 3) <= 500 then text
  else concat('...[earlier content truncated]...' || chr(10),
              substring(text, floor(length(text)::double * (1.0 - 500.0 / greatest(1, length(text) // 3)::double))::int + 1)) end as text
from documents""")
def t15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_head("text", 500).alias("text"))


@query("T16_fit_conversation", """
with t as (select conv_id, turn, greatest(1, length(text) // 3) as tokens from conversations),
s as (select *, sum(tokens) over (partition by conv_id order by turn desc rows between unbounded preceding and current row) as suffix,
             row_number() over (partition by conv_id order by turn desc) as rn from t)
select conv_id, turn, tokens::bigint as tokens from s where suffix <= 1000 or rn = 1""")
def t16(spark, sf):
    c = table(spark, sf, "conversations")
    return T.fit_conversation(c, 1000).select("conv_id", "turn", "tokens")


@query("T17_fit_lines", """
with l as (select concat('run-', cast(user_id as varchar)) as log_id,
                  row_number() over (partition by user_id order by event_id) as line_no,
                  greatest(1, length(props) // 3) as tokens from events),
s as (select *, sum(tokens) over (partition by log_id order by line_no desc rows between unbounded preceding and current row) as suffix from l)
select log_id, line_no, tokens::bigint as tokens from s where suffix <= 40""")
def t17(spark, sf):
    from pyspark.sql import Window
    e = table(spark, sf, "events")
    lines = e.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("log_id"),
                     F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("line_no"),
                     F.col("props").alias("line"))
    return T.fit_lines(lines, 40, ["log_id"]).select("log_id", "line_no", "tokens")


@query("T02_token_edit_distance", f"""
with p as (select doc_id, string_split(text, ' ') as t from documents),
c as (select doc_id, t, list_filter(list_transform(t, lambda x, i: case when (i - 1) % 7 = 3 then 'zqx-none' else x end),
                                    lambda x, i: (i - 1) % 11 <> 5) as u from p)
select doc_id, (len(list_filter(u, lambda x: x = 'zqx-none')) + len(t) - len(u))::bigint as word_dist from c""")
def t02(spark, sf):
    """Pieces between single spaces as tokens; every seventh becomes one found
    nowhere else and every eleventh goes: the distance is how many changed."""
    from kiln.functions.editdistance import token_edit_distance
    t = spread(table(spark, sf, "documents")).select("doc_id", F.split("text", " ", -1).alias("ref"))
    changed = F.transform("ref", lambda w, i: F.when(i % 7 == 3, F.lit("zqx-none")).otherwise(w))
    pred = F.filter(changed, lambda w, i: i % 11 != 5)
    return t.select("doc_id", token_edit_distance(pred, F.col("ref")).cast("bigint").alias("word_dist"))


@query("T11_metrics_bundle", f"""with {_BUNDLE},
{_TEDS_SQL.strip()[5:].rstrip()},
ts as (select 'src' || (page_id % 20) as source, round_even(avg(case when nr = 0 then (case when np = 0 then 1.0 else 0.0 end)
  else 1.0 - levenshtein(a, b) / greatest(np, nr) end), 6) as teds from e group by 1)
select b.*, teds, null::double as layout_map from b left join ts using (source)""", views=("v_word_pairs",))
def t11(spark, sf):
    """Per source: text metrics (T07), mean TEDS of its pages (page_id mod
    20 picks the source), layout mAP passed through (null), rounded as the
    reference bundle does."""
    text = T.ocr_metrics(v_word_pairs(spark, sf).select("source", "pred", "ref"), by=["source"])
    pages = v_html_pairs(spark, sf).withColumn("source", F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")))
    tab = T.teds_mean(pages, by=["source"]).select("source", F.bround("teds", 6).alias("teds"))
    return text.join(tab, "source", "left").withColumn("layout_map", F.lit(None).cast("double"))
