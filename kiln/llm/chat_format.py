"""Chat formatting: budgeted windows of turns, repeated context, loss masks.

A turn costs ceil(characters / 4) + 4 tokens. The prefix sums of these costs
choose the spans: a turn belongs to span ``before div stride`` with ``before``
the tokens ahead of it, so spans are turn-aligned and found without walking a
conversation in order. ``stride`` is the window less the history and the system
turn (at least a quarter of the window). Every window repeats the conversation's
opening system turn and the last turns of the span before it, as far as they
fit in the history budget; repeated turns carry no loss. Each turn is trained
on once, in the window that owns it. No turn is cut: a turn above the budget
makes a longer window.

Prefix sums come in two levels, inside blocks of 256 turn numbers and over the
blocks of a conversation, so one huge conversation spreads over many tasks.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line break. Control
strings inside roles and texts (of this template and of the common ones) get a
backslash behind their first character, and one more if some are there already;
taking one away restores the text.

Defined results. Null role or text: empty. Turns are ordered by turn (null
first), then role, then text; repeated rows are turns of their own. A null
conv_id is a conversation of its own. An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiln.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# What follows the first character of a control string.
CONTROL_REST = r"(/?s>|</?SYS>>|/?INST\]|\|(?:im_start|im_sep|im_end|endoftext)\|>)"
ESCAPE_RE = r"([<\[])(\\*)" + CONTROL_REST
UNESCAPE_RE = r"([<\[])\\(\\*)" + CONTROL_REST
BLOCK = 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE_RE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE_RE, r"$1$2$3")


def format_windows(turns: DataFrame, window_tokens: int = 2048, history_tokens: int = 256) -> DataFrame:
    """conv_id, window, text, n_repeated, n_turns, loss (array of start, length in code points, from 0)."""
    rows = turns.select(
        F.col("conv_id"), F.col("turn"),
        F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("c0"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).cast("bigint").alias("b"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tok", (F.ceil(F.char_length("text") / 4) + 4).cast("bigint"))
    in_block = Window.partitionBy("c", "c0", "b").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pre", F.sum("tok").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tok")
                           ).withColumn("block_tok", F.sum("tok").over(Window.partitionBy("c", "c0", "b")))
    # one row for each block: its tokens and first turn; then the conversation's totals and opening turn
    by_block = Window.partitionBy("c", "c0").orderBy("b")
    whole = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_system = F.col("role") == "system"
    blocks = rows.where(F.col("pre") == 0).select("c", "c0", "b", "block_tok", "role", "text", "tok")
    blocks = blocks.select(
        "c", "c0", "b",
        (F.sum("block_tok").over(by_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tok")).alias("off"),
        F.sum("block_tok").over(whole).alias("total"),
        F.first(F.when(is_system, F.col("tok")).otherwise(F.lit(0))).over(whole).cast("bigint").alias("sys_tok"),
        F.when(F.row_number().over(by_block) == 1, F.when(is_system, F.col("text"))).alias("sys_text"))
    blocks = blocks.withColumn("stride", F.greatest(
        F.lit(window_tokens // 4), F.lit(window_tokens - history_tokens) - F.col("sys_tok")).cast("bigint"))
    placed = rows.drop("block_tok").join(blocks.drop("sys_text"), ["c", "c0", "b"]).withColumn(
        "before", F.col("pre") + F.col("off"))
    placed = placed.withColumn("span", F.expr("before div stride"))
    span_w = Window.partitionBy("c", "c0", "span")
    placed = placed.withColumn("next", F.max(F.col("before") + F.col("tok")).over(span_w))
    # kind: 0 the system turn, 1 history, 2 the window's own turns
    opening = (F.col("before") == 0) & (F.col("sys_tok") > 0)
    repeats = ~opening & (F.col("next") < F.col("total")) & (F.col("next") - F.col("before") <= history_tokens)
    own = F.struct(F.col("span").alias("window"), F.lit(2).alias("kind"))
    again = F.struct(F.expr("next div stride").alias("window"), F.lit(1).alias("kind"))
    spread = placed.select("conv_id", "c", "c0", "before", "role", "text",
                           F.explode(F.when(repeats, F.array(own, again)).otherwise(F.array(own))).alias("to"))
    spread = spread.select("conv_id", "c", "c0", F.col("to.window").alias("window"), F.col("to.kind").alias("kind"),
                           "before", "role", "text")
    systems = blocks.where(F.col("sys_text").isNotNull()).select("c", "c0", "sys_text")
    later = placed.where(F.col("span") > 0).where(F.col("sys_tok") > 0).select("conv_id", "c", "c0", "span").distinct()
    context = later.join(systems, ["c", "c0"]).select(
        "conv_id", "c", "c0", F.col("span").alias("window"), F.lit(0).alias("kind"),
        F.lit(0).cast("bigint").alias("before"), F.lit("system").alias("role"), F.col("sys_text").alias("text"))
    pieces = spread.unionByName(context)
    pieces = pieces.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))).withColumn(
        "body", escape(F.col("text")))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("c", "c0", "window").orderBy("kind", "before")
    pieces = pieces.withColumn("at", F.sum(F.char_length("piece")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("piece"))
    loss = F.when((F.col("kind") == 2) & (F.col("role") == "assistant"), F.struct(
        (F.col("at") + F.char_length("head")).alias("start"), F.char_length("body").cast("bigint").alias("length")))
    packed = pieces.groupBy("c", "c0", "window").agg(
        F.first("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"),
        F.array_sort(F.collect_list(loss)).alias("loss"),
        F.sum((F.col("kind") < 2).cast("int")).cast("int").alias("n_repeated"),
        F.sum((F.col("kind") == 2).cast("int")).cast("int").alias("n_turns"))
    return packed.select("conv_id", "window", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"),
                         "n_repeated", "n_turns", "loss")


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text), loss (array of texts), parsed from the formatted
    text and its mask: repeated turns left out, control strings restored."""
    pieces = F.split(F.col("text"), r"<\|im_end\|>\n", -1)
    mine = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    parts = F.transform(mine, lambda p: F.split(F.substring(p, len(START) + 1, 1 << 30), r"<\|im_sep\|>", 2))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substr(
        F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss"),
                          F.char_length("text").alias("n_chars"))


PLANTED = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)],
                                    "conv_id bigint, turn bigint, role string, text string")
    back = read_back(format_windows(given.unionByName(planted)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    own = back.select("conv_id", "window", lines.alias("lines"), F.array_join("loss", "").alias("loss"), "n_chars",
                      F.size("turns").cast("bigint").alias("n"))
    whole = own.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("n_chars").cast("bigint").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "lines", "loss"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["lines"]), "")
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(text, 256).alias("turns_sha256"),
                        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                        "formatted_chars")


_SQL_ESC = r"regexp_replace({c}, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|\|(?:im_start|im_sep|im_end|endoftext)\|>)', '\1\\\2\3', 'g')"
SQL = f"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED}'
  UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'),
t AS (
  SELECT *, (length(text) + 3) // 4 + 4 AS tok,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
         length('{START}{SEP}{END}') + 1 + length({_SQL_ESC.format(c="role")})
           + length({_SQL_ESC.format(c="text")}) AS piece
  FROM base),
p AS (
  SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY rn) - tok AS before,
         sum(tok) OVER (PARTITION BY conv_id) AS total,
         max(CASE WHEN rn = 1 AND role = 'system' THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_tok,
         max(CASE WHEN rn = 1 AND role = 'system' THEN piece ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_piece
  FROM t),
s AS (SELECT *, before // greatest(512, 2048 - 256 - sys_tok) AS span FROM p),
n AS (SELECT *, max(before + tok) OVER (PARTITION BY conv_id, span) AS next FROM s)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(piece + CASE WHEN NOT (before = 0 AND sys_tok > 0) AND next < total AND next - before <= 256
                         THEN piece ELSE 0 END)
        + (count(DISTINCT span) - 1) * max(sys_piece))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
