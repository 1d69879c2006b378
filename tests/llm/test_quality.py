import random
import zlib

import numpy as np
import pytest

from kiln.llm.quality import fit_quality, held_out, op2_quality, pool_adjacent_violators, quality_score, text_stats
from pyspark.sql import functions as F


def brute_isotonic(y, w):
    """Min-max formula of the weighted isotonic fit."""
    n = len(y)
    mean = lambda a, b: np.average(y[a:b], weights=w[a:b])
    return [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]


def test_isotonic():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 12))
        x, y, w = np.arange(n, dtype=float), rng.random(n), rng.integers(1, 5, n).astype(float)
        knots, values = pool_adjacent_violators(x, y, w)
        assert np.all(np.diff(values) > 0) and np.all(np.diff(knots) > 0)
        want = brute_isotonic(y, w)
        assert np.allclose(values, sorted({round(v, 12) for v in want}), atol=1e-9)


@pytest.fixture(scope="module")
def model_and_docs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = " ".join(word() + ("." if rng.random() < 0.1 else "") if good else word().upper() + "!!$$" for _ in range(60))
        rows.append((i, text))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (0, None), (9999, 1), (None, 0), (1, 7)], "doc_id bigint, quality int")
    return fit_quality(docs, marks), docs, dict(labels)


def test_held_out_accuracy(model_and_docs):
    model, docs, labels = model_and_docs
    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("h"), quality_score(F.col("text"), model).alias("s")).collect()
    held = [r for r in got if r["h"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum((r["s"] >= 0.3) == bool(labels[r["doc_id"]]) for r in held) >= 0.95 * len(held)


def test_edge_texts_score(spark, model_and_docs):
    model, _, _ = model_and_docs
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "x"), (3, "word " * 200_000), (4, "\n\n \t"), (5, "é" * 50)],
                                 "doc_id bigint, text string")
    got = docs.select(quality_score(F.col("text"), model).alias("s"), held_out(F.col("doc_id")).alias("h")).collect()
    assert len(got) == 6 and all(0 <= r["s"] <= 1 and r["h"] in (True, False) for r in got)
    assert got[0]["s"] == got[1]["s"] == got[4]["s"]
    assert not text_stats(None).any() and np.isfinite(text_stats("é! 3")).all()


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    for labels, want in ((none, 0.5), (one, 1.0)):
        got = docs.select(quality_score(F.col("text"), fit_quality(docs, labels)).alias("s")).collect()
        assert [r["s"] for r in got] == [want, want]
    assert docs.limit(0).select(quality_score(F.col("text"), fit_quality(docs.limit(0), none))).count() == 0


def test_query_on_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = op2_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
