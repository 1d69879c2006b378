import random

import numpy as np
import pytest

from kiln.llm.ngram_join import (
    LOWER_HALF, SHORT, Repeats, candidate_ties, linked_positions, ngram_groups, one_of_each_group, packed, signatures,
    unpacked)


def brute_sets(rows):
    out = []
    for _, t in rows:
        ws = "".join(c.lower() if c.isascii() else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            ws = ws.replace(c, " ")
        ws = [w for w in ws.split(" ") if w]
        out.append({tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set()))
    return out


def brute_labels(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocab) for _ in range(60)]
    out = []
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 9, 30, 120, 400]))]
        if i % 4 == 0:
            base = shared + base
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 50))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.3:
                t = t[:-max(1, len(t) // 12)] or t
            out.append((len(out) * 3 % 500, " ".join(t).upper() if rng.random() < 0.2 else "\n".join(t)))
    out += [(600, None), (601, ""), (602, " \t\n"), (603, out[0][1]), (603, out[0][1]), (None, out[5][1]),
            (700, "long " + " ".join(vocab * 60)), (701, " ".join(vocab * 60)), (702, "É é"), (703, "é é")]
    return out


@pytest.mark.parametrize("block", [4_000_000, 400])
def test_brute_force(docs_of, rows, block):
    sets = brute_sets(rows)
    label = brute_labels(sets)
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None]
        want.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in ngram_groups(docs_of(rows), block_shingles=block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_stays(docs_of, rows):
    docs = docs_of(rows)
    kept = one_of_each_group(docs)
    label, sets = brute_labels(brute_sets(rows)), brute_sets(rows)
    groups = {label[k] for k in range(len(rows)) if sets[k]}
    assert kept.count() == len(groups) + sum(not s for s in sets)
    assert kept.columns == docs.columns
    assert one_of_each_group(docs_of([])).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        universe = np.unique(rng.integers(0, 2**63, 3 * n + 20).astype(np.uint64) * np.uint64(2))
        a = np.sort(rng.permutation(universe)[:n])
        drop = int(rng.integers(0, n // 9 + 1))
        rest = np.setdiff1d(universe, a)
        b = np.sort(np.concatenate([rng.permutation(a)[drop:], rng.permutation(rest)[:drop]]))
        inter = len(np.intersect1d(a, b))
        if inter and 100 * inter >= 80 * (len(a) + len(b) - inter):
            assert np.intersect1d(signatures(a), signatures(b)).size


def test_t_occurrence_with_long_lists():
    rng = np.random.default_rng(3)
    hot = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = []
    for k in range(120):
        own = rng.integers(0, 2**63, int(rng.choice([5, 60, 300]))).astype(np.uint64)
        sets.append(np.unique(np.concatenate([hot[rng.random(200) < 0.97], own])))
    want = brute_labels([set(s.tolist()) for s in sets])
    assert linked_positions(sets).tolist() == want


@pytest.mark.parametrize("n, buckets", [(1, 1), (2, 5), (5_000, 1), (5_000, 7), (5_000, 100_000)])
def test_packed_rows_read_back(n, buckets):
    rng = np.random.default_rng(n + buckets)
    sig, node = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
    sig[: n // 3], sig[-1] = sig[0], 2**64 - 1
    want = sorted(zip(((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).tolist(),
                      (sig & LOWER_HALF).tolist(), (node >> SHORT).tolist()))
    got = []
    for b, rows in packed(sig, node, buckets).itertuples(index=False):
        assert 0 <= b < buckets
        got += [(b, x, y) for x, y in zip(*(z.tolist() for z in unpacked(rows)))]
    assert sorted(got) == want


@pytest.mark.parametrize("chunk", [1, 7, 1_000])
def test_repeats_go_on_with_all_their_classes(chunk):
    rng = np.random.default_rng(chunk)
    sig, node = rng.integers(0, 300, 1_000).astype(np.uint64), rng.integers(0, 4, 1_000).astype(np.uint64)
    sig[300:500], node[300:500] = 1_000, 9  # one class, many rows
    seen, got = Repeats(), set()
    for a in range(0, len(sig), chunk):
        got |= set(zip(*(x.tolist() for x in seen.take(sig[a:a + chunk], node[a:a + chunk]))))
    classes = {}
    for s, c in zip(sig.tolist(), node.tolist()):
        classes.setdefault(s, set()).add(c)
    assert got == {(s, c) for s, cs in classes.items() if len(cs) > 1 for c in cs}


def test_classes_of_one_short_name_are_tied(spark, docs_of):
    names = [5 << 40, (5 << 40) + 1, (5 << 40) + 2, 6 << 40]
    known = spark.createDataFrame([(s, 3, b"\0" * 8) for s in names], "s1 bigint, n_shingles bigint, parity binary")
    ties = candidate_ties(docs_of([]), known, "text").collect()
    assert sorted(map(tuple, ties)) == [(names[1], names[0]), (names[2], names[0])]
