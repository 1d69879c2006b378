import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kiln.llm import mixing
from kiln.llm.mixing import Run, cube_mix, mixed


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        if not rest:
            return fixed
        left, open_ = total - sum(fixed.values()), sum(w[s] for s in rest)
        over = [s for s in rest if w[s] * left > cap * sizes[s] * open_]
        if not over:
            return fixed | {s: w[s] * left / open_ for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), f"s{i % 7}" if i % 11 else None) for i in range(2000)]
    return out + [(5000, None, "s0"), (5001, "", "nothing"), (None, "one two", "s1"), (3, out[3][1], out[3][2]),
                  (5002, "big " * 30000, "s2")]


def test_targets_and_totals(docs_of, rows):
    got = [r.asDict() for r in cube_mix(docs_of(rows)).collect()]
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        # near the target, but for a document larger than all the words that the draw decides
        fraction = want[s] / sizes[s] % 1 if sizes[s] else 0
        loose = largest[s] > fraction * sizes[s] / 2
        assert abs(taken[s] - want[s]) <= (largest[s] if loose else 0.001 * want[s] + 5), s


def test_reruns_and_levels_agree_on_balance(docs_of, rows, monkeypatch):
    once = sorted(map(str, cube_mix(docs_of(rows)).collect()))
    assert once == sorted(map(str, cube_mix(docs_of(rows).repartition(5)).collect()))
    monkeypatch.setattr(mixing, "RUN_ROWS", 64)  # several levels of runs
    got = [r.asDict() for r in cube_mix(docs_of(rows)).collect()]
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
    for r in got:
        if r["source"] not in ("s2", "s6"):  # their largest documents outweigh what is drawn
            assert abs(taken[r["source"]] - r["target"]) <= 0.01 * r["target"] + 20


def test_probabilities_hold():
    rng, n = random.Random(1), 6000
    sizes, total = [0, 0, 1, 3, 3, 3, 5, 8, 9, 40, 100, 7], [0] * 12
    for _ in range(n):
        run = Run()
        for i in sorted(range(12), key=lambda k: -sizes[k]):
            for k, one in run.add(i, 0.3, sizes[i], rng.getrandbits(64)):
                total[k] += one
        for k, one in run.land():
            total[k] += one
    assert all(abs(t / n - 0.3) < 0.03 for t in total)


def test_mixed_rows(docs_of, rows):
    docs = docs_of(rows)
    got = mixed(docs)
    assert got.columns == docs.columns
    want = sum(r["copies"] for r in cube_mix(docs).collect())
    assert got.count() == want
    assert cube_mix(docs_of([])).count() == 0 and mixed(docs_of([])).count() == 0


def test_any_column_names(docs_of, rows):
    docs = docs_of(rows[:200])
    names = ["mix_id", "mix_hash", "mix_number", "mix_copy", "row", "row_id", "a.b", "x y"]
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    got = mixed(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(
        r["id"] for r in cube_mix(docs).collect() for _ in range(r["copies"]))
    assert all(r[n] == n + str(r["doc_id"]) for r in got for n in names)
