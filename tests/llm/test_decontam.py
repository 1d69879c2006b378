import random
import re
from collections import Counter
from itertools import combinations

import pytest

from kiln.llm.decontam import SPAN, _seeds, best_segment, drop_leaks, find_leaks, short_masks, widest_segment

import numpy as np


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    """All diagonals of all pairs."""
    out = set()
    for i, t in docs:
        a = words(t)
        for j, q in items:
            b = words(q)
            if len(b) < 5 or j is None:
                continue
            for d in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -d), min(len(b), len(a) - d)
                eq = np.array([a[d + k] == b[k] for k in range(lo, hi)], dtype=bool)
                s, e = best_segment(eq)
                same = int(eq[s:e].sum())
                if same >= min(SPAN, -(-4 * len(b) // 5)) and 5 * same >= 4 * (e - s):
                    out.add((i, j))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(j, " ".join(text(rng.choice([15, 30, 60])))) for j in range(12)]
    items += [(20, " ".join(text(7))), (21, "two words"), (22, None), (23, items[0][1]), (24, "")]
    docs = []
    for i in range(60):
        body = text(rng.randint(20, 300))
        if i % 3 == 0:
            leak = words(items[i // 3 % 13][1])
            if i % 2 and len(leak) > 13:
                for k in range(5, len(leak), 9):  # one word in nine is changed
                    leak[k] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in leak]
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (102, items[0][1] + " " + "filler " * 50_000), (None, items[1][1]), (0, docs[0][1])]
    return docs, items


def test_brute_force(spark, docs_of, case):
    docs, items = case
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_leaks(docs_of(docs), table, log_bits=20).collect()
    assert {(r["id"], r["item"]) for r in got} == brute([d for d in docs if d[0] != 102], items) | {
        (102, 0), (102, 23)}
    reported = Counter((r["id"], r["k1"], r["item"]) for r in got)
    again = {j for i, j, _ in reported if i == 0}  # the row with id 0 is there twice, and each is reported
    assert again and all(n == (2 if i == 0 else 1) for (i, _, _), n in reported.items())
    kept = drop_leaks(docs_of(docs), table, log_bits=20)
    hit = {r["id"] for r in got}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in hit)
    assert kept.columns == docs_of(docs).columns


def test_empty(spark, docs_of, case):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert find_leaks(docs_of(case[0]), none, log_bits=20).count() == 0
    assert find_leaks(docs_of([]), spark.createDataFrame(case[1], none.schema), log_bits=20).count() == 0


def test_widest_segment_against_all():
    rng = np.random.default_rng(4)
    for _ in range(300):
        eq = rng.random(rng.integers(0, 40)) < rng.choice([0.5, 0.7, 0.8])
        want = max([0, *(int(eq[s:e].sum()) for s in range(len(eq)) for e in range(s + 1, len(eq) + 1)
                         if 5 * eq[s:e].sum() >= 4 * (e - s))])
        s, e = widest_segment(eq)
        assert eq[s:e].sum() == want and 5 * want >= 4 * (e - s)


def test_weak_agreement_around_a_leak(spark, docs_of):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items, docs = [], []
    for j in range(40):
        item = text(130)
        keep = rng.choice([13, 20, 30])
        copy = item[:keep] + [w if rng.random() < rng.choice([0.7, 0.75]) else "changed" for w in item[keep:]]
        items.append((j, " ".join(item)))
        docs.append((j, " ".join(text(40) + copy + text(40))))
    got = find_leaks(docs_of(docs), spark.createDataFrame(items, "item_id bigint, text string"), log_bits=20).collect()
    assert {(r["id"], r["item"]) for r in got} == {(j, j) for j in range(40)}
    assert all(r["n_equal"] >= 13 and 5 * r["n_equal"] >= 4 * r["n_words"] for r in got)


def test_short_items_with_changes(spark, docs_of):
    rng = random.Random(13)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items, docs, want = [], [], set()
    for n in range(5, 13):
        assert all(len(m) >= 4 for m in short_masks(n))
        for t in range(12):
            item, j = text(n), 100 * n + t
            items.append((j, " ".join(item)))
            for extra in (0, 1):  # as many changes as the rule allows, and one more
                out = rng.sample(range(n), n // 5 + extra)
                copy = ["changed" if k in out else w for k, w in enumerate(item)]
                docs.append((2 * j + extra, " ".join(text(20) + copy + text(20))))
            want.add((2 * j, j))
        j = 100 * n + 50  # the copy sticks out of the text
        item = text(n)
        items.append((j, " ".join(item)))
        docs.append((2 * j, " ".join(item[n // 5:] + text(20))))
        docs.append((2 * j + 1, " ".join(text(20) + item[:n - n // 5])))
        want |= {(2 * j, j), (2 * j + 1, j)}
    got = find_leaks(docs_of(docs), spark.createDataFrame(items, "item_id bigint, text string"), log_bits=20).collect()
    assert {(r["id"], r["item"]) for r in got} == want


def test_every_change_pattern_leaves_a_seed():
    """All ways to change as many words as the rule allows, in overlaps of 13 to 20 words."""
    for n in range(13, 21):
        item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        known = set(zip(*(x.tolist() for x in _seeds(item, ()))))
        for out in combinations(range(n), n - -(-4 * n // 5)):
            copy = item.copy()
            copy[list(out)] = np.arange(100, 100 + len(out), dtype=np.uint64)
            assert known & set(zip(*(x.tolist() for x in _seeds(copy, ())))), (n, out)


def test_a_fifth_of_the_words_changed(spark, docs_of):
    """Independent rule: an item is leaked if 80 % of its words stand at their places somewhere in a document."""
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items, docs = [], []
    for j in range(120):
        n = rng.randint(13, 20)
        item = text(n)
        out = {0, n - 1} if j % 3 == 0 else set(rng.sample(range(n), n // 5))
        items.append((j, " ".join(item)))
        docs.append((j, " ".join(text(j % 4) + ["x" if k in out else w for k, w in enumerate(item)] + text(j % 3))))
    got = find_leaks(docs_of(docs), spark.createDataFrame(items, "item_id bigint, text string"), log_bits=20).collect()
    assert {(r["id"], r["item"]) for r in got} == {(j, j) for j in range(120)}
