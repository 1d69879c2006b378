"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

A document is described by statistics of its whole text (lengths, character
classes, repetition, compressibility); nothing else enters a score. Random
Fourier features turn a Gaussian kernel over the standardised statistics into a
linear model, whose normal equations are summed by partition and fold; the
driver adds a fixed number of small matrices and solves. Scores of documents by
a model that has not seen their fold are binned, and pooling adjacent violators
over the bins gives the calibrated probability.

The model is fitted on at most ``max_rows`` labelled rows, taken by hash (the
documented bound of the fit); scoring reads every text once.

Defined results. Null and empty text: statistics of zero, and a score like any
other. Labels that are null or not 0/1 are ignored, repeated labels of a doc_id
take the smallest, repeated documents count as often as they come. A null
doc_id is not held out and has no label. Without labels of both kinds, every
score is the share of label 1 (0.5 without any). An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import table
from kiln.llm.tokens import pieces, release

N_STATS = 24
FOLDS = 4
BINS = 1024
_COUNTS = {  # byte classes, counted per character
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:", "shout": b"!?",
    "symbol": b"#$%&*@^~_|\\+=", "markup": b"<>{}[]()/\"'`", "high": range(128, 256),
}
_CLASS = np.zeros((256, len(_COUNTS)), dtype=np.float64)
for _i, _bytes in enumerate(_COUNTS.values()):
    _CLASS[list(_bytes), _i] = 1


def text_stats(text: str | None) -> np.ndarray:
    """The statistics of one text."""
    t = text if isinstance(text, str) else ""
    out = np.zeros(N_STATS)
    words = t.split()
    if not words:
        return out
    raw = t.encode("utf-8", "surrogatepass")
    n, m, lines = len(raw), len(words), [x for x in t.split("\n") if x]
    classes = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASS
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=m)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    once = len(set(lines))
    out[0:3] = np.log1p([n, m, len(lines)])
    out[3:11] = classes / n
    out[11] = lengths.mean()
    out[12] = lengths.std()
    out[13] = np.log(lengths.max())
    out[14] = np.log1p(distinct) / np.log1p(m)
    out[15] = np.log1p(pairs) / np.log1p(m)
    out[16] = 1 - once / len(lines)
    out[17] = sum(w[-1] in ".,;:!?" for w in words) / m
    out[18] = sum(w.isupper() for w in words) / m
    out[19] = sum(w[:1].isupper() for w in words) / m
    out[20] = len(zlib.compress(raw, 1)) / (n + 20)
    out[21] = sum(x.endswith((".", "!", "?")) for x in lines) / len(lines)
    out[22] = np.log1p(m / len(lines))
    out[23] = sum(map(str.isalpha, words)) / m
    return out


def stats_matrix(texts) -> np.ndarray:
    return np.array([text_stats(t) for t in texts]).reshape(-1, N_STATS)


@dataclass
class QualityModel:
    """Standardisation, Fourier directions, ridge weights and calibration steps."""

    mean: np.ndarray
    std: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.std, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, z, np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features(stats) @ self.weights, self.knots, self.values)


def pool_adjacent_violators(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic fit of y on x (x ascending): knots and values, blocks at their mean x."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", max_rows: int = 40_000, n_waves: int = 256, ridge: float = 1e-3,
                seed: int = 7, parts: int = 8) -> QualityModel:
    """Fit on labelled rows that are not held out."""
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
              .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
              .groupBy("id").agg(F.min("y").alias("y")))
    n = marked.count()
    if n > max_rows:
        marked = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    # at most about max_rows pairs of two numbers: the bound makes the broadcast safe
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")

    def describe(it):
        for pdf in pieces(it):
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "s": list(stats_matrix(pdf["text"]))})

    described = train.select("id", "y", "text").mapInPandas(describe, "id bigint, y int, s array<double>")
    # a fixed number of partitions: each one's sums go to the driver; bounded by max_rows, recomputed if lost
    held = described.repartition(parts).cache()
    try:
        return _fit(held, n_waves, ridge, seed)
    finally:
        held.unpersist()


def _sums(rows: DataFrame, fn, schema: str) -> list:
    """One row of sums from each of the fixed number of partitions, in partition order."""
    out = rows.mapInPandas(fn, schema).withColumn("p", F.spark_partition_id()).collect()
    return sorted(out, key=lambda r: (r["p"], r["fold"]))


def _fit(rows: DataFrame, n_waves: int, ridge: float, seed: int) -> QualityModel:
    def moments(it):
        s = np.zeros((2, N_STATS))
        n = ones = 0
        for pdf in it:
            x = np.array(list(pdf["s"])).reshape(-1, N_STATS)
            s += [x.sum(0), (x * x).sum(0)]
            n += len(x)
            ones += int(pdf["y"].sum())
        yield pd.DataFrame({"fold": [0], "n": [n], "ones": [ones], "s": [s.ravel()]})

    got = _sums(rows, moments, "fold int, n bigint, ones bigint, s array<double>")
    n, ones = sum(r["n"] for r in got), sum(r["ones"] for r in got)
    s = sum((np.array(r["s"]).reshape(2, N_STATS) for r in got), np.zeros((2, N_STATS)))
    rng = np.random.default_rng(seed)
    mean = s[0] / max(n, 1)
    std = np.sqrt(np.maximum(s[1] / max(n, 1) - mean**2, 0))
    std[std < 1e-9] = 1
    # kernel width: about the typical distance of two documents
    directions = rng.normal(size=(N_STATS, n_waves)) / np.sqrt(N_STATS)
    size = n_waves + N_STATS + 1
    model = QualityModel(mean, std, directions, rng.uniform(0, 2 * np.pi, n_waves), np.zeros(size),
                         np.array([0.0]), np.array([ones / n if n else 0.5]))
    if n == 0 or ones in (0, n):
        return model

    def normal(it):
        a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for pdf in it:
            z = model.features(np.array(list(pdf["s"])).reshape(-1, N_STATS))
            fold = _fold(pdf["id"])
            for f in range(FOLDS):
                x, y = z[fold == f], pdf["y"].to_numpy(dtype=np.float64)[fold == f]
                a[f] += x.T @ x
                b[f] += x.T @ y
        for f in range(FOLDS):
            yield pd.DataFrame({"fold": [f], "a": [a[f].tobytes()], "b": [b[f].tobytes()]})

    a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for r in _sums(rows, normal, "fold int, a binary, b binary"):
        a[r["fold"]] += np.frombuffer(r["a"]).reshape(size, size)
        b[r["fold"]] += np.frombuffer(r["b"])
    eye = np.eye(size) * ridge * n
    eye[-1, -1] = 0

    def solve(left, right):
        return np.linalg.solve(left + eye + 1e-9 * np.eye(size), right)

    model.weights = solve(a.sum(0), b.sum(0))
    folds = [solve(a.sum(0) - a[f], b.sum(0) - b[f]) for f in range(FOLDS)]
    lo, hi = -0.5, 1.5

    def binned(it):
        c = np.zeros((3, BINS))
        for pdf in it:
            z = model.features(np.array(list(pdf["s"])).reshape(-1, N_STATS))
            fold, y = _fold(pdf["id"]), pdf["y"].to_numpy(dtype=np.float64)
            raw = np.einsum("ij,ij->i", z, np.array(folds)[fold]) if len(z) else np.zeros(0)
            raw = np.clip(raw, lo, hi)
            at = np.minimum(((raw - lo) / (hi - lo) * BINS).astype(int), BINS - 1)
            for k, w in enumerate((np.ones(len(y)), y, raw)):
                c[k] += np.bincount(at, weights=w, minlength=BINS)
        yield pd.DataFrame({"fold": [0], "c": [c.ravel()]})

    c = sum(np.array(r["c"]).reshape(3, BINS) for r in _sums(rows, binned, "fold int, c array<double>"))
    full = c[0] > 0
    model.knots, model.values = pool_adjacent_violators(c[2][full] / c[0][full], c[1][full] / c[0][full], c[0][full])
    return model


def _fold(ids: pd.Series) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"fold%d" % i) % FOLDS for i in ids), dtype=np.int64, count=len(ids))


def quality_score(text: Column, model: QualityModel) -> Column:
    """The calibrated score of a text, 0 to 1."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.clip(model.score(stats_matrix(texts)), 0, 1))
        release()

    return score(text)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                      quality_score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
