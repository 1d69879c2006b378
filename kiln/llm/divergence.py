"""How far the sources of a language stand apart in their words: smoothed term shares, compared pair by pair.

Terms are counted where the texts are read, in one pass that keeps a task's partial counts and flushes them when they
reach ``HELD`` entries; only (lang, source, term) sums are shuffled, so a hot source or a frequent word is a row a
task. Kept terms are numbered within term blocks of about ``TERM_BLOCK`` terms.

Pairs are compared by three-dimensional cube partitioning. The cube's axes are the groups of a language, the same
groups again, and the kept terms, each cut into blocks; a task owns cells (group block, group block, term block). A
group's slice of a term block, its non-zero shares only, is sent to each cell that needs it, with one header row for
what absent terms have; the cell sets up two dense matrices of at most about ``GROUP_BLOCK`` x ``TERM_BLOCK`` integers
and adds up absolute differences row against row. Partial sums are reduced along the term axis. Work and memory of a
cell are bounded whatever the number of groups, terms or documents, and a term's row travels once for each group block.

All arithmetic is in integers: a share is ``1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept terms))``.

Defined results. Null text, lang and source read as ''; every row counts as a document, so repeated rows count as
often as they occur. A group without kept terms has smoothed shares only; a language without kept terms gives its
groups' pairs the value 0. Ties rank by item in UTF-8 order. A language with one source has no pairs. An empty table
gives no rows. Only the named columns are read, under names of their own, so others may have any name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.llm.common import table, written
from kiln.llm.tokens import release

UNIT = 1_000_000_000
SMOOTH = 5
MIN_DOCS = 30
TOP_TERMS = 50
GROUP_BLOCK = 256
TERM_BLOCK = 2048
HELD = 400_000
PIECE = 1 << 20

# What terms are made of (everything but these bytes), A-Z folded.
TERM_RE = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _term_lists(text: bytes):
    """The terms of a text, in lists of about PIECE bytes, cut between terms."""
    folded = text.translate(_FOLD)
    a = 0
    while len(folded) - a > PIECE:
        b = folded.rfind(b" ", a, a + PIECE)
        if b < a:
            b = folded.find(b" ", a + PIECE)
            if b < 0:
                break
        yield folded[a:b].split()
        a = b + 1
    yield folded[a:].split()


def _counted(batches):
    """lang, source, text -> partial rows lang, source, term, n, docs; the term '' marks that the group occurs."""
    held: dict = {}
    entries = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        texts = batch.column("text").cast(pa.binary())
        for i, group in enumerate(zip(langs, sources)):
            if group not in held:
                held[group] = Counter(), Counter()
            n, docs = held[group]
            before = len(n)
            seen: set = set()
            for terms in _term_lists(texts[i].as_py()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            entries += len(n) - before
            if entries >= HELD:
                yield from _partial_rows(held)
                held, entries = {}, 0
    yield from _partial_rows(held)
    release()


def _partial_rows(held: dict):
    text = pa.string()
    for (lang, source), (n, docs) in held.items():
        terms = [b"", *n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(terms), text), pa.array([source] * len(terms), text), pa.array(terms, pa.binary()).view(text),
             pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())],
            names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a row with term '' for every group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    partial = read.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share, exact in decimals: 0 where a language keeps no terms."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(19,0)")
    whole = F.call_function("div", top, F.nullif(total + terms * SMOOTH, F.lit(0)).cast("decimal(19,0)"))
    return F.coalesce(whole.cast("bigint") + 1, F.lit(0).cast("bigint"))


class Shares:
    """The written tables of an audit: ``groups`` (lang, source, total, lang_total, terms, n_groups, p0: the share
    of a term that the group does not have), ``counts`` (the kept terms that a group has: lang, source, term, n,
    lang_n, block, place) and ``blocks`` (lang, block, size)."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, term_block: int = TERM_BLOCK, **columns: str):
        counts = written(term_counts(docs, **columns), "term-counts")
        kept = written(counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                       .where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
        groups = counts.where("term = ''").select("lang", "source")
        langs = written(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups")).join(
            kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
            .na.fill(0, ["terms", "lang_total"]), "langs")
        block = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / term_block)).cast("int")
        place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
        numbered = written(kept.join(langs.select("lang", "terms"), "lang").withColumn("block", block).drop("terms")
                           .withColumn("place", place), "numbered-terms")
        self.blocks = written(numbered.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("size")), "term-blocks")
        self.counts = written(counts.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "kept-counts")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        known = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
        self.groups = written(known.withColumn("p0", share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"))), "groups")


def _cell_sums(batches):
    """Rows of cells, sorted by cell: absolute differences of all its pairs, summed over its terms."""
    from kiln.llm.tokens import runs

    for cell in runs(batches, ["lang", "low", "high", "block"]):
        heads = cell[cell["place"].isna()]
        slices = cell[cell["place"].notna()]
        names = sorted(set(heads["source"]))
        at = {s: i for i, s in enumerate(names)}
        one = heads.drop_duplicates("source").set_index("source").loc[names]
        width, side = int(heads["size"].iloc[0]), one["side"].to_numpy()
        dense = np.repeat(one["p"].to_numpy(dtype=np.int64)[:, None], width, axis=1)
        dense[slices["source"].map(at).to_numpy(dtype=np.int64), slices["place"].to_numpy(dtype=np.int64)] = slices["p"]
        low, high = (int(cell[k].iloc[0]) for k in ("low", "high"))
        left = np.flatnonzero(side == low)
        right = np.flatnonzero(side == high)
        firsts, seconds, sums = [], [], []
        for i in left:
            others = right[right > i] if low == high else right
            if len(others):
                firsts += [names[i]] * len(others)
                seconds += [names[j] for j in others]
                sums += np.abs(dense[others] - dense[i]).sum(axis=1).tolist()
        if sums:
            yield pd.DataFrame({"lang": cell["lang"].iloc[0], "one": firsts, "two": seconds, "part": sums})
    release()


def pair_divergences(shares: Shares, group_block: int = GROUP_BLOCK) -> DataFrame:
    """lang, one, two, value: the sum over all kept terms of the differences of shares, each pair of sources once."""
    n_sides = F.ceil(F.col("n_groups") / group_block)
    groups = shares.groups.withColumn("side", F.pmod(F.xxhash64("source"), n_sides).cast("int")).withColumn("n_sides", n_sides)
    # a header for each group and term block, with what its absent terms have
    heads = groups.join(shares.blocks, "lang", "left").select(
        "lang", "source", "side", "n_sides", F.coalesce("block", F.lit(0)).alias("block"), F.lit(None).cast("int").alias("place"),
        F.col("p0").alias("p"), F.coalesce("size", F.lit(0)).alias("size"))
    slices = shares.counts.join(groups.select("lang", "source", "side", "n_sides", "total", "terms"), ["lang", "source"]).select(
        "lang", "source", "side", "n_sides", "block", "place", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        F.lit(0).alias("size"))
    other = F.explode(F.sequence(F.lit(0), (F.col("n_sides") - 1).cast("int")))
    dealt = heads.unionByName(slices).select("*", other.alias("other")).select(
        "lang", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "block", "source", "side",
        "place", "p", "size")
    cells = dealt.repartition("lang", "low", "high", "block").sortWithinPartitions("lang", "low", "high", "block")
    partial = cells.mapInPandas(_cell_sums, "lang string, one string, two string, part bigint")
    return partial.groupBy("lang", "one", "two").agg(F.sum("part").alias("value"))


def term_differences(shares: Shares) -> DataFrame:
    """lang, source, term, value of the terms a group has whose share is above the language's."""
    known = shares.counts.join(shares.groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    over = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return known.select("lang", "source", "term", over.alias("value")).where("value > 0")


def ranked_audit(shares: Shares, top_terms: int = TOP_TERMS, group_block: int = GROUP_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by their divergence, and the most telling terms."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergences(shares, group_block)
    both = F.inline(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                            F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    near = pairs.select("lang", "value", both).withColumn("rank", F.row_number().over(order))
    terms = (term_differences(shares).withColumnRenamed("term", "item").withColumn("rank", F.row_number().over(order))
             .where(F.col("rank") <= top_terms))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return near.withColumn("part", F.lit("pair")).select(*cols).unionByName(terms.withColumn("part", F.lit("term")).select(*cols))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_audit(Shares(table(spark, sf_dir, "documents")))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
w AS MATERIALIZED (
  SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '{TERM_RE}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_total FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
x AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, l.v, l.lang_total,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS MATERIALIZED (
  SELECT *, (1 + ({UNIT}::HUGEINT * (n + {SMOOTH})) // (total + {SMOOTH} * v))::BIGINT AS p,
         (1 + ({UNIT}::HUGEINT * (lang_n + {SMOOTH})) // (lang_total + {SMOOTH} * v))::BIGINT AS q FROM x),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s WHERE n > 0 AND p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
