"""Derived views over the driver tables, in Spark and in DuckDB SQL.

Each view is defined twice: a Spark DataFrame builder (used by the queries)
and the DuckDB text (inlined as a CTE by the oracle SQL). Both read whole
tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------- Spark

def v_pairs(spark, sf_dir) -> DataFrame:
    """Prediction/reference pairs: the whole text of each document and a copy
    with 'th' -> 'h' and 'an ' -> 'a ': characters are only deleted, so the
    distance is the difference in length."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "source", F.col("text").alias("ref")).select(
        "doc_id", "source", "ref",
        F.replace(F.replace("ref", F.lit("th"), F.lit("h")), F.lit("an "), F.lit("a ")).alias("pred"))


def v_word_pairs(spark, sf_dir) -> DataFrame:
    """The same with every eleventh piece between single spaces deleted: words
    are only deleted, so both distances are differences in length."""
    d = spread(table(spark, sf_dir, "documents"))
    kept = F.filter(F.split("text", " ", -1), lambda w, i: i % 11 != 5)
    return d.select("doc_id", "source", F.col("text").alias("ref"), F.array_join(kept, " ").alias("pred"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer full splits than there are cores (the driver's tables are one row group each) is dealt out; a
    larger one is left as its splits are, and no text is shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores) if size < cores * split else df


def v_jsonl(spark, sf_dir) -> DataFrame:
    """Raw JSON lines with duplicates, bad JSON, non-objects and blank content."""
    d = table(spark, sf_dir, "documents")
    line = (F.when(F.col("doc_id") % 50 == 0, F.lit("not json"))
             .when(F.col("doc_id") % 41 == 0, F.lit("[1]"))
             .when(F.col("doc_id") % 37 == 0, F.lit('{"text":"  "}'))
             .otherwise(F.concat(F.lit('{"id":'), (F.col("doc_id") % 700).cast("string"),
                                 F.lit(',"lang":"'), F.col("lang"), F.lit('"}'))))
    return d.select(F.col("doc_id").alias("line_no"), line.alias("line"), "source")


def v_log(spark, sf_dir) -> DataFrame:
    """One training log per user, lines numbered by event order."""
    e = table(spark, sf_dir, "events")
    eid, val = F.col("event_id").cast("string"), F.col("value").cast("string")
    err = (F.when(F.col("event_id") % 6 == 0, "CUDA out of memory")
            .when(F.col("event_id") % 6 == 1, "FATAL stop")
            .when(F.col("event_id") % 6 == 2, "loss: nan")
            .when(F.col("event_id") % 6 == 3, "NCCL timeout")
            .when(F.col("event_id") % 6 == 4, "x ERROR y")
            .otherwise("WARNING slow"))
    line = (F.when(F.col("event_type") == "view",
                   F.concat(F.lit("global_step: "), eid, F.lit(", loss: "), val,
                            F.lit(", learning_rate: 1e-4, throughput: 900.5 tokens/s")))
             .when(F.col("event_type") == "click",
                   F.concat(F.lit("eval_loss: "), val, F.lit(", eval_accuracy: 0.92, global_step: "), eid))
             .when(F.col("event_type") == "purchase",
                   F.concat(F.lit("global_step: "), eid, F.lit(", loss: "), val,
                            F.lit(", grad_norm: 1.23, epoch: 1")))
             .when(F.col("event_type") == "signup", F.lit("some random log line"))
             .otherwise(err))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("log_id"),
                    F.row_number().over(w).cast("bigint").alias("line_no"), line.alias("line"))


def v_experiments(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").alias("seq"), F.col("event_type").alias("factor"),
        (F.col("event_id") % 9 + 1).cast("double").alias("factor_value"),
        F.when(F.col("event_id") % 11 == 0, "failed").when(F.col("event_id") % 13 == 0, "pending")
         .otherwise("completed").alias("status"),
        (F.col("value") / 100).alias("final_loss"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value") / 110).alias("eval_loss"))


def v_phase_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"),
                    F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
                    (F.col("event_id") % 7).alias("phase"),
                    F.when(F.col("event_id") % 4 == 0, "failed").when(F.col("event_id") % 4 == 1, "in_progress")
                     .otherwise("completed").alias("status"), "ts")


def v_checkpoints(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
                    F.col("event_type").alias("experiment_id"),
                    F.concat(F.lit("/ckpt/checkpoint-"), F.col("event_id").cast("string")).alias("path"),
                    F.col("event_id").alias("step"), F.col("value").alias("loss"))


def v_gpu(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.col("user_id").alias("gpu"), F.lit(350.0).alias("mem_total_mb"),
                    F.col("value").alias("mem_used_mb"), (F.col("value") / 4).alias("util"),
                    (F.lit(40) + F.col("value") / 6).alias("temp"))


# ----------------------------------------------------------------- DuckDB

DUCK = {
    "v_pairs": """select doc_id, source, text as ref, replace(replace(text,'th','h'),'an ','a ') as pred from documents""",
    "v_word_pairs": """select doc_id, source, text as ref,
  array_to_string(list_filter(string_split(text, ' '), lambda w, i: (i - 1) % 11 <> 5), ' ') as pred from documents""",
    "v_jsonl": """select doc_id as line_no, case when doc_id % 50 = 0 then 'not json' when doc_id % 41 = 0 then '[1]'
  when doc_id % 37 = 0 then '{"text":"  "}'
  else concat('{"id":',cast(doc_id % 700 as varchar),',"lang":"',lang,'"}') end as line, source
from documents""",
    "v_log": """select concat('run-',cast(user_id as varchar)) as log_id,
  row_number() over (partition by user_id order by event_id) as line_no,
  case event_type
    when 'view' then concat('global_step: ',cast(event_id as varchar),', loss: ',cast(value as varchar),', learning_rate: 1e-4, throughput: 900.5 tokens/s')
    when 'click' then concat('eval_loss: ',cast(value as varchar),', eval_accuracy: 0.92, global_step: ',cast(event_id as varchar))
    when 'purchase' then concat('global_step: ',cast(event_id as varchar),', loss: ',cast(value as varchar),', grad_norm: 1.23, epoch: 1')
    when 'signup' then 'some random log line'
    else case event_id % 6 when 0 then 'CUDA out of memory' when 1 then 'FATAL stop' when 2 then 'loss: nan'
      when 3 then 'NCCL timeout' when 4 then 'x ERROR y' else 'WARNING slow' end end as line
from events""",
    "v_experiments": """select concat('e',cast(event_id as varchar)) as id, concat('run-',cast(user_id as varchar)) as run_id,
  event_id as seq, event_type as factor, cast(event_id % 9 + 1 as double) as factor_value,
  case when event_id % 11 = 0 then 'failed' when event_id % 13 = 0 then 'pending' else 'completed' end as status,
  value / 100 as final_loss, case when event_id % 7 = 0 then null else value / 110 end as eval_loss
from events""",
    "v_phase_events": """select event_id as id, concat('run-',cast(user_id as varchar)) as run_id, event_id % 7 as phase,
  case event_id % 4 when 0 then 'failed' when 1 then 'in_progress' else 'completed' end as status, ts
from events""",
    "v_checkpoints": """select concat('run-',cast(user_id as varchar)) as run_id, event_type as experiment_id,
  concat('/ckpt/checkpoint-',cast(event_id as varchar)) as path, event_id as step, value as loss
from events""",
    "v_gpu": """select ts, user_id as gpu, 350.0e0 as mem_total_mb, value as mem_used_mb, value / 4 as util, 40 + value / 6 as temp
from events""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the DuckDB CTEs of the named views."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} as (\n{DUCK[n]}\n)" for n in names)
    body = sql.lstrip()
    if body[:15].lower() == "with recursive ":
        return f"with recursive {ctes},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{sql}"


# DuckDB spellings of the Unicode strip used on the Spark side.
def _duck_ws() -> str:
    from kiln.functions.text import WS_CLASS_RE2
    return WS_CLASS_RE2


def duck_strip(x: str) -> str:
    ws = _duck_ws()
    return f"regexp_replace({x}, '^{ws}+|{ws}+$', '', 'g')"


def duck_words(x: str) -> str:
    """Number of words (Unicode white space between them)."""
    return f"len(regexp_extract_all({x}, '{_duck_ws().replace('[', '[^', 1)}+'))"
