"""Mixing sources to target weights by the cube method.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share all words; a target stops at 3 times its source and the excess is shared
again by weight. That is water-filling: with the sources sorted by cap / weight,
a prefix is capped and the rest share what is left, found by running sums over
the one row per source.

A source's documents are all taken ``target / size`` times on average: the whole
part of it each, and the fraction as an inclusion probability. The cube method
turns the fractions into zeros and ones: a pool of documents moves along a
direction that keeps both the number of documents and their words (the null
space of those two totals) until one lands on 0 or 1, the way chosen at random
so that the probability holds. The largest documents go first, so that what is
left at the end is small. A run leaves two undecided at most; runs hold about 4,000 documents of one source by hash, their leftovers are
gathered into runs again, and the last two of a source land by words alone and
then by their own probability. Randomness is a hash of seed and document, so
reruns agree; only ids, sizes and probabilities are shuffled.

Defined results. Null or empty text: size 0, taken 0 words. A source of size 0
has target 0. Repeated rows are drawn as documents of their own; a null source
is a source, the last one; null ids are allowed. An empty table gives no rows.
Further columns may have any name: `cube_mix` does not look at them, `mixed`
carries them along as they are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiln.llm.common import WORD_RE, table, written

WEIGHTS = (5, 2, 1)
CAP = 3
RUN_ROWS = 4_096
_COLUMNS = ["source", "is_null", "id", "no_id", "th", "size", "whole", "prob", "rand"]
_STATE = ("source string, is_null boolean, id bigint, no_id boolean, th bigint, size bigint, whole int, prob double, "
          "rand bigint, copies int")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, source_rows, target from rows (source, size): one row per source."""
    # one row per source from here on: the windows below order sources, not documents
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")).cast("bigint")
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ahead, all_ = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "*", F.sum("source_size").over(all_).alias("total"),
        F.coalesce(F.sum("cap").over(ahead), F.lit(0)).alias("capped"),
        (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))).alias("open_weight"))
    # the share of this source if those ahead of it are capped; from the first that stays below its cap, no more are
    fits = F.col("weight") * (F.col("total") - F.col("capped")) <= F.col("cap") * F.col("open_weight")
    first = F.min(F.when(fits, F.struct(F.row_number().over(fill).alias("n"), F.col("capped").alias("c"),
                                        F.col("open_weight").alias("w")))).over(all_)
    per = per.withColumn("n", F.row_number().over(fill)).withColumn("fit", first)
    share = (F.col("weight") * (F.col("total") - F.col("fit.c"))).cast("double") / F.col("fit.w").cast("double")
    target = F.when(F.col("n") < F.col("fit.n"), F.col("cap").cast("double")).otherwise(share)
    return per.select("source", "source_size", "source_rows", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _uniform(bits: int) -> float:
    return ((bits & ((1 << 53) - 1)) + 0.5) / (1 << 53)


class Run:
    """The flight of one run, largest documents first, through a pool of undecided units. The largest one moves
    along its projection on the null space of the pool's two totals, so that many smaller ones make up for it."""

    EPS, POOL = 1e-9, 256

    def __init__(self):
        self.rows: list = []
        self.prob = self.size = self.bits = None
        self.fresh: list[tuple] = []  # (prob, size, random bits) of the rows not yet in the arrays

    def add(self, row, prob: float, size: int, bits: int):
        """Take a unit in; yield (row, 0 or 1) of those that become decided."""
        self.rows.append(row)
        self.fresh.append((prob, float(size), bits))
        if len(self.rows) >= self.POOL:
            yield from self._move_until(self.POOL // 2)

    def drain(self):
        """Move on without new units until two totals leave no direction; yield what becomes decided. The
        rest stays in ``left``."""
        yield from self._move_until(2)
        self.left = list(zip(self.rows, self.prob.tolist() if self.rows else []))
        self.rows = []

    def land(self):
        """Decide the rest: two units move so that words hold, the last by its probability."""
        yield from self._move_until(2)
        if len(self.rows) == 2:
            a, b = self.size
            yield from self._move(np.array([b / a, -1.0] if a and b else [1.0, -1.0]))
        for row, p in zip(self.rows, self.prob if self.rows else []):
            yield row, int(self._draw() < p)
        self.rows = []

    def _move_until(self, few: int):
        if self.fresh:
            prob, size, bits = (np.array(x) for x in zip(*self.fresh))
            old = len(self.rows) > len(self.fresh)
            self.prob = np.append(self.prob, prob) if old else prob
            self.size = np.append(self.size, size) if old else size
            self.bits = np.append(self.bits, bits.astype(np.uint64)) if old else bits.astype(np.uint64)
            self.fresh = []
        while len(self.rows) > few:
            yield from self._move(self._direction())

    def _direction(self) -> np.ndarray:
        x = self.size
        m, s1, s2 = len(x), x.sum(), (x * x).sum()
        det = m * s2 - s1 * s1
        for at, pivot in enumerate(x):
            if x.max() > x.min():
                v = -(s2 - s1 * pivot) / det - (m * pivot - s1) / det * x
            else:  # equal sizes: to hold the number of documents is to hold their words
                v = np.full(m, -1 / m)
            v[at] += 1
            if v[at] > 1e-6:
                return v
        raise ArithmeticError("no direction keeps both totals")

    def _draw(self) -> float:
        first = int(self.bits[0])
        first = ((first ^ first >> 31) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1)
        self.bits[0] = first
        return _uniform(first >> 11)

    def _move(self, v: np.ndarray):
        go = np.abs(v) > 1e-14
        rise = np.where(v > 0, 1 - self.prob, self.prob)[go] / np.abs(v[go])
        fall = np.where(v > 0, self.prob, 1 - self.prob)[go] / np.abs(v[go])
        up, down = rise.min(), fall.min()
        step = up if self._draw() * (up + down) < down else -down
        self.prob = self.prob + step * v
        free = (self.prob > self.EPS) & (self.prob < 1 - self.EPS)
        for i in np.flatnonzero(~free):
            yield self.rows[i], round(self.prob[i])
        self.rows = [r for r, f in zip(self.rows, free) if f]
        self.prob, self.size, self.bits = self.prob[free], self.size[free], self.bits[free]


def _fly(batches, land: bool):
    """Rows sorted by (source, run) stream through; undecided ones come out with copies null."""
    import pandas as pd

    key, run, out = None, Run(), []
    whole, prob = _COLUMNS.index("whole"), _COLUMNS.index("prob")

    def close():
        if land:
            out.extend((*row, row[whole] + one) for row, one in run.land())
        else:
            out.extend((*row, row[whole] + one) for row, one in run.drain())
            out.extend((*row[:prob], p, *row[prob + 1:], None) for row, p in run.left)

    def frame():
        pdf = pd.DataFrame(out, columns=[*_COLUMNS, "copies"]).astype({"copies": "Int32"})
        out.clear()
        return pdf

    for pdf in batches:
        for row, part in zip(zip(*(pdf[c].tolist() for c in _COLUMNS)), pdf["part"].tolist()):
            if key != (row[0], row[1], part):
                close()
                key = (row[0], row[1], part)
            if Run.EPS < row[prob] < 1 - Run.EPS:
                out.extend((*r, r[whole] + one) for r, one in run.add(row, row[prob], row[5], row[8] & ((1 << 64) - 1)))
            else:
                out.append((*row, row[whole] + round(row[prob])))
        if out:
            yield frame()
    close()
    if out:
        yield frame()


def cube_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 17) -> DataFrame:
    """id, source, th (hash of text), size, source_size, target, copies: one row for each row of ``docs``."""
    sizes = written(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"),
                                F.xxhash64(text_col).alias("th"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = written(source_targets(sizes, weights, cap), "mix-targets")
    most = targets.agg(F.max("source_rows")).first()[0] or 0
    keyed = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = keyed.select(
        F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("is_null"),
        F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "th", "size",
        F.floor(mean).cast("int").alias("whole"), (mean - F.floor(mean)).alias("prob"),
        F.xxhash64(F.lit(seed), "id", "th").alias("rand"), F.col("source_rows").alias("n"))
    done = None
    level = 0
    while True:
        runs = F.greatest(F.lit(1), F.ceil(F.col("n") / RUN_ROWS))
        last = most <= RUN_ROWS
        flow = state.withColumn("part", F.pmod(F.xxhash64(F.lit(level), "rand"), runs).cast("bigint")).drop("n")
        flow = flow.repartition("source", "is_null", "part").sortWithinPartitions(
            "source", "is_null", "part", F.desc("size"), "rand", "id")
        flown = flow.mapInPandas(lambda it, last=last: _fly(it, last), _STATE)
        if not last:
            flown = written(flown, f"mix-level{level}")
        part = flown.where("copies is not null")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        # a run leaves two undecided at most, so the next level has about 2 / RUN_ROWS as many rows
        left = flown.where("copies is null").drop("copies")
        counts = left.groupBy("source", "is_null").agg(F.count(F.lit(1)).alias("n"))
        state = left.join(counts, ["source", "is_null"])
        most = max(1, 2 * math.ceil(most / RUN_ROWS))
        level += 1
    done = done.withColumn("source", F.when(~F.col("is_null"), F.col("source"))).withColumn(
        "id", F.when(~F.col("no_id"), F.col("id")))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    return done.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "id", "source", "th", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it."""
    mix = cube_mix(docs, id_col, source_col, text_col, **kw)
    nth = Window.partitionBy("id", "source", "th").orderBy("copies")  # repeated rows are told apart by a number
    mix = mix.select(F.col("id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("th").alias("mix_th"),
                     F.row_number().over(nth).alias("mix_nth"), F.col("copies").alias("mix_copies"))
    # the given columns travel in a struct, so that no name of theirs meets one of the mix
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id_col).cast("bigint").alias("row_id"), F.col(source_col).cast("string").alias("row_source"),
                        F.xxhash64(text_col).alias("row_th"))
    nth = Window.partitionBy("row_id", "row_source", "row_th").orderBy("row_th")
    keyed = keyed.withColumn("row_nth", F.row_number().over(nth))
    joined = keyed.join(mix, F.col("row_id").eqNullSafe(F.col("mix_id")) & F.col("row_source").eqNullSafe(F.col("mix_source"))
                        & (F.col("row_th") == F.col("mix_th")) & (F.col("row_nth") == F.col("mix_nth")))
    return joined.where("mix_copies > 0").withColumn(
        "mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube_mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))
