"""Vector codes against a plain version in Python's integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm.vector_codes import Codebooks, encode, fit_codebooks, grid_vectors, nearest_entries


def whole(x):
    return int(x) * 1024 if abs(x) >= 2.0 ** 43 else math.floor(1024 * x)


def brute(rows, entries=256, rounds=4):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = -(-max((len(v) for _, v in kept), default=0) // 4)
    parts = [[tuple((([whole(x) for x in v] + [0] * 4 * w)[p * w:(p + 1) * w])) for _, v in kept] for p in range(4)]
    books = [[list(x) for x in ps[:entries]] for ps in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = defaultdict(list)
            for x in parts[p]:
                groups[nearest(x, books[p])[1]].append(x)
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for n, (i, _) in enumerate(kept):
        best = [nearest(parts[p][n], books[p]) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), min(sum(d for d, _ in best), 2 ** 63 - 1)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(out, key=str), digest


def run(spark, rows, **args):
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    for clash in ("grid", "code", "error", "part", "a.b"):
        df = df.withColumn(clash, F.lit(clash))
    vectors = grid_vectors(df, "v", id="id")
    books = fit_codebooks(vectors, **args)
    return sorted((tuple(r) for r in encode(vectors, books).collect()), key=str), books


def test_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.2), 3) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # a group of copies
    rows += [(5, rows[9][1]), (None, rows[3][1]), (-2, [0.0] * 8), (-1, [-0.0] * 8), (7, [-0.0001] * 8)]
    rows += [(8, None), (9, [None] + [0.0] * 7), (10, [float("nan")] * 8), (11, [float("inf")] * 8), (12, [0.5] * 3), (13, [])]
    got, books = run(spark, rows, entries=40)
    assert (got, books.sha256()) == brute(rows, entries=40)


def test_huge_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -1e300, 3.5, 2.0 ** 50 + 1, 1e9 + 0.3, -1e-9]) for _ in range(6)]) for i in range(40)]
    got, books = run(spark, rows, entries=7)
    assert (got, books.sha256()) == brute(rows, entries=7)
    rows = [(i, [rng.choice([70_000.5, -70_000.25, 90_000.125]) for _ in range(8)]) for i in range(60)]
    got, books = run(spark, rows, entries=5)
    assert (got, books.sha256()) == brute(rows, entries=5)


def test_few_rows_and_none(spark):
    got, books = run(spark, [(1, [0.1] * 4), (2, None)])
    assert got == [(1, "00000000", 0)] and [len(b) for b in books.books] == [1] * 4
    assert run(spark, [(1, [])])[0] == [(1, "00000000", 0)]
    assert run(spark, [])[0] == [] and run(spark, [(1, None)])[0] == []


def test_codes_decode_to_the_nearest_entries(spark):
    rows = [(i, [i / 7, -i / 3, i * 0.01, 0.0, 1.0, i % 2 * 1.0, 0.2, -0.3]) for i in range(50)]
    got, books = run(spark, rows, entries=16, rounds=2)
    vectors = dict(rows)
    for i, code, error in got:
        assert error == sum((math.floor(1024 * x) - y) ** 2 for x, y in zip(vectors[i], books.decode(code)))


def test_entries_have_two_digits(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [0.1] * 4)], entries=257)


def test_trie_of_shared_beginnings():
    rng = np.random.default_rng(5)
    parts = rng.integers(-3, 4, (5_000, 6)).astype(float)
    parts = parts[np.lexsort(parts.T[::-1])]
    book = rng.integers(-3, 4, (37, 6)).astype(float)
    entry, error = nearest_entries(parts, book)
    full = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()
    assert Codebooks([[[1, 2]], [[3, 4]]], 2, 4).decode("0000") == [1, 2, 3, 4]
