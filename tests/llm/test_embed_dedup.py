import math

import numpy as np
import pytest

from kiln.llm import embed_dedup
from kiln.llm.embed_dedup import near_duplicates


def brute(rows):
    vec = []
    for _, e in rows:
        ok = e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)
        v = np.array(e, dtype=np.float64) if ok else None
        vec.append(v / np.linalg.norm(v) if ok else None)
    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and vec[i] is not None and vec[j] is not None and len(vec[i]) == len(vec[j]):
                link[i][j] = float(vec[i] @ vec[j]) >= 0.95
    label = list(range(n))
    for i in range(n):
        for j in range(n):
            if link[i][j] and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(n) if label[m] == label[k] and rows[m][0] is not None]
        out.append((i, sum(link[k]), min(ids, default=None)))
    return out


def rows_of(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.normal(size=dim) * rng.choice([0.01, 1, 1000])
        for _ in range(rng.choice([1, 1, 3])):
            noise = rng.normal(size=dim) * np.linalg.norm(base) / math.sqrt(dim) * rng.choice([0, 0.05, 0.15])
            rows.append([len(rows), (base + noise).astype(np.float32).tolist()])
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_recall_and_exactness(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = rows_of(1, 150)
    rows += [[900, None], [901, []], [902, [0.0] * 16], [903, [float("nan")] + [1.0] * 15], [904, [None] * 16],
             [905, [float("inf")] * 16], [None, rows[3][1]], [3, rows[3][1]], [906, [1.0, 2.0]], [907, [2.0, 4.0]]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    from pyspark.sql import functions as F
    for name in ("id", "node", "weight", "e"):
        df = df.withColumn(name, F.lit(1))
    got = sorted(((r["id"], r["n_links"], r["component_id"]) for r in near_duplicates(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    links, found = sum(w[1] for w in want), sum(g[1] for g in got)
    assert 0.95 * links <= found <= links
    assert all(g[1] <= w[1] or g[0] in (3, None) for g, w in zip(got, want))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert near_duplicates(df).count() == 0
    df = spark.createDataFrame([(4, None)], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(4, 0, 4, True)]


def test_given_embeddings_recall(spark):
    """The given vectors, and for half of them one more at a cosine of 0.95 to 0.97, where links are easiest lost."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    e = np.array(given["embedding"].tolist(), dtype=np.float64)
    e /= np.linalg.norm(e, axis=1)[:, None]
    rng = np.random.default_rng(11)
    base, aside = e[::2], rng.normal(size=e[::2].shape)
    aside -= (aside * base).sum(axis=1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    cos = rng.uniform(0.9501, 0.97, len(base))[:, None]
    e = np.concatenate([e, cos * base + np.sqrt(1 - cos ** 2) * aside]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(e.tolist())], "vec_id bigint, embedding array<float>").repartition(8)
    got = near_duplicates(df).toPandas().set_index("id")
    e = e.astype(np.float64)
    e /= np.linalg.norm(e, axis=1)[:, None]
    links = ((e @ e.T) >= 0.95).sum(axis=1) - 1
    found = got.loc[np.arange(len(e)), "n_links"].to_numpy()
    assert links.sum() >= 2 * len(base)
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()


def test_doubles_are_kept(spark):
    def near(cosine):
        return [cosine, math.sqrt(1 - cosine * cosine), 0.0, 0.0]

    rows = [(1, [1e300, -1e300]), (2, [1e300, -1e300]),
            (3, [1.0, 0.0, 0.0, 0.0]), (4, near(0.95 - 1e-10)),
            (5, [0.0, 0.0, 1.0]), (6, [0.0, 1e-300, 0.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == [
        (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6)]
