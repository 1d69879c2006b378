import random
import re

from kiln.llm.substring_dedup import (
    Fenwick, K, GAP_COST, _chains_of, align, all_minimizers, bounds, chains, equal_words, minimizers, pair_stretches, parts,
    repeated_passages, segments, stretches)

import numpy as np
import pandas as pd


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_fenwick_prefix_maximum():
    rng = random.Random(1)
    tree, held = Fenwick(50), [float("-inf")] * 50
    for i in range(300):
        at, v = rng.randrange(50), rng.random()
        tree.update(at, v, i)
        held[at] = max(held[at], v)
        q = rng.randrange(51)
        assert tree.query(q)[0] == max(held[:q], default=float("-inf"))


def test_minimizers_against_windows():
    rng = np.random.default_rng(5)
    for n in (0, 1, 4, 9, 30, 200):
        for w in (1, 6, 25):
            h = rng.integers(0, 50, n).astype(np.uint64)
            want = set()
            for i in range(max(1, n - w + 1) if n else 0):
                part = h[i:i + w]
                want |= {i + int(j) for j in np.flatnonzero(part == part.min())}
            assert set(minimizers(h, w).tolist()) == want


def test_minimizers_of_many_texts():
    rng = np.random.default_rng(6)
    for w in (1, 6, 25):
        for _ in range(20):
            sizes = rng.choice([0, 0, 1, 3, 5, 6, 24, 25, 26, 80], rng.integers(0, 9))
            h = rng.integers(0, 40, sizes.sum()).astype(np.uint64)
            ends = np.cumsum(sizes)
            want = [e - n + x for e, n in zip(ends, sizes) for x in minimizers(h[e - n:e], w)]
            assert all_minimizers(h, sizes, w).tolist() == want


def test_a_pair_is_one_row_however_many_chains():
    """Texts that repeat a block have a chain for every place of it: these stay together and meet each text once."""
    block = 30
    ups = np.arange(0, 3000, block)
    ties = pd.DataFrame({"u": 1, "up": np.append(ups, ups) * 2 + 1, "v": 2, "vp": np.append(ups, 0 * ups)})
    ties = pd.concat([ties, ties.assign(u=3, up=ties["up"] + 2)], ignore_index=True)
    got = list(_chains_of(iter([ties[:150], ties[150:]]), 25))
    assert [(u, v) for u, v, *_ in got] == [(1, 2), (3, 2)]
    for _, _, sizes, ups_, vps, ureach, vreach in got:
        assert len(sizes) > 90 and len(ups_) == len(vps) == 2 * sizes.sum()
        assert len(ureach) == len(vreach) == 2  # reaches that overlap are one


def test_pair_stretches_against_one_by_one():
    rng = np.random.default_rng(11)
    for trial in range(60):
        pad = int(rng.choice([0, 10, 25]))
        block = rng.integers(0, 10**9, 30)
        a, b = (np.concatenate([x for _ in range(6) for x in (rng.integers(0, 10**9, rng.integers(0, 90)), block)]) for _ in "ab")
        for x in (a, b):  # some words are changed
            x[rng.integers(0, len(x), rng.integers(0, 12))] = -1
        sizes, ups, vps = [], [], []
        for _ in range(rng.integers(1, 25)):
            i, j, at = int(rng.integers(0, len(a) - 60)), int(rng.integers(0, len(b) - 60)), 0
            if rng.random() < 0.7:  # places of the block
                i, j = (int(rng.choice(np.flatnonzero(x[:len(x) - 29] == block[0]))) if (x[:len(x) - 29] == block[0]).any() else 0 for x in (a, b))
                sizes.append(1)
                ups += [i, i + 20]
                vps += [j, j + 20]
                continue
            sizes.append(int(rng.integers(1, 4)))
            for _ in range(sizes[-1]):
                n = int(rng.integers(0, 12))
                ups += [i + at, i + at + n]
                vps += [j + at, j + at + n]
                at += n + int(rng.integers(1, 8))
        sizes, ups, vps = (np.array(x, dtype=np.int32) for x in (sizes, ups, vps))
        ur, vr = (parts(*bounds(sizes, x, pad)) for x in (ups, vps))
        cut = lambda x, r: np.concatenate([x[s:e] for s, e in r.reshape(-1, 2)])
        got = pair_stretches(cut(a, ur), cut(b, vr), sizes, ups, vps, ur, vr, pad)
        want, k = (set(), set()), 0
        for n in sizes:
            up, vp = ups[2 * k:2 * (k + n)], vps[2 * k:2 * (k + n)]
            k += n
            s, t = max(0, up[0] - pad), max(0, vp[0] - pad)
            x, y = equal_words(a[s:up[-1] + K + pad], b[t:vp[-1] + K + pad], up - s, vp - t)
            for c, d, e, f in stretches(x + s, y + t):
                if min(d - c, f - e) >= 25:
                    want[0].update(range(c, d))
                    want[1].update(range(e, f))
        for g, held in zip(got, want):
            assert {w for s, e in g.reshape(-1, 2) for w in range(s, e)} == held, trial


def test_blocks_repeated_in_long_texts(docs_of):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    block, own = text(30), [text(40), text(60), text(55)]
    rows = [(0, " ".join(own[0] + 80 * block)), (1, " ".join(own[1] + 70 * block + own[2])), (2, " ".join(text(90)))]
    got = repeated_passages(docs_of(rows + rows[:1])).collect()
    assert sorted((r["id"], r["start"], r["n_words"], r["partner"]) for r in got) == [(0, 40, 2400, 1), (1, 60, 2100, 0)]


def test_best_chain_against_quadratic():
    rng = random.Random(2)
    for _ in range(50):
        pts = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        segs = segments(np.array([p[0] for p in pts]), np.array([p[1] for p in pts])).tolist()
        score = []
        for u0, u1, v0, v1 in segs:
            own = u1 - u0 + K
            score.append(max([own] + [own + score[j] - GAP_COST * (u0 - segs[j][1] + v0 - segs[j][3])
                                      for j in range(len(score)) if segs[j][1] < u0 and segs[j][3] < v0]))
        best = [segs[i] for i in chains(segs)[0]]
        total = sum(s[1] - s[0] + K for s in best) - GAP_COST * sum(
            y[0] - x[1] + y[2] - x[3] for x, y in zip(best, best[1:]))
        assert abs(total - max(score)) < 1e-9
        assert all(x[1] < y[0] and x[3] < y[2] for x, y in zip(best, best[1:]))


def test_align_lengthens_and_counts():
    a, b = np.arange(100), np.arange(100)
    b[40] = 999
    assert align(a, b, np.array([10, 20, 50, 50]), np.array([10, 20, 50, 50])) == (0, 100, 0, 100, 99)
    c = np.insert(b, 30, [5, 5])  # two words more
    assert align(a, c, np.array([3, 20, 50, 60]), np.array([3, 20, 52, 62])) == (0, 100, 0, 102, 99)


def test_passages(docs_of):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, fuzzy, split = text(51), text(120), text(60)
    docs = {i: text(rng.randint(60, 200)) for i in range(30)}
    for i in (3, 9, 12):
        docs[i][20:20] = passage
    for i in (4, 15):
        f = list(fuzzy)
        for k in range(i, 120, 17):
            f[k] = "changed" + str(i)
        docs[i][10:10] = f
    docs[20][5:5] = split[:30]  # two halves elsewhere, the whole in two documents
    docs[21][5:5] = split[30:]
    docs[22][5:5] = split
    docs[23][9:9] = split
    rows = [(i, " ".join(w).title()) for i, w in docs.items()]
    rows += [(40, rows[0][1]), (41, None), (42, ""), (43, "same " * 3000), (44, "same " * 3000), (None, rows[1][1]),
             (2, rows[2][1]), (45, " ".join(text(30_000)))]
    got = repeated_passages(docs_of(rows)).collect()
    assert {r["id"] for r in got} == {3, 9, 12, 4, 15, 22, 23, 0, 40, 43, 44, None, 1}
    for r in got:
        assert r["n_words"] >= 50
        if r["id"] in (3, 9, 12):
            assert r["start"] <= 20 and r["start"] + r["n_words"] >= 71 and r["n_words"] < 56
    # no exact run of 50 words that another document has may be missed
    held, cover = {}, {}
    for r in got:
        cover.setdefault(r["id"], []).append((r["start"], r["start"] + r["n_words"]))
    for i, t in set(rows):
        w = words(t)
        for k in range(len(w) - 49):
            held.setdefault(tuple(w[k:k + 50]), set()).add((i, k))
    for places in held.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                assert any(a <= k and k + 50 <= b for a, b in cover[i]), (i, k)


def covered(got, i):
    return {k for r in got if r["id"] == i for k in range(r["start"], r["start"] + r["n_words"])}


def test_stretches_against_all_pairs():
    rng = random.Random(7)
    for _ in range(200):
        x, y, at, off = [], [], 0, 0
        for _ in range(rng.randrange(1, 9)):
            n = rng.randrange(1, 40)
            x += range(at, at + n)
            y += range(off, off + n)
            at, off = at + n + rng.randrange(0, 20), off + n + rng.randrange(1, 20)
        want = set()
        for i in range(len(x)):
            for j in range(i, len(x)):
                if (i == 0 or (x[i - 1], y[i - 1]) != (x[i] - 1, y[i] - 1)) and (
                        j + 1 == len(x) or (x[j + 1], y[j + 1]) != (x[j] + 1, y[j] + 1)):
                    if 5 * (j - i + 1) >= 4 * max(x[j] - x[i] + 1, y[j] - y[i] + 1):
                        want |= set(range(x[i], x[j] + 1))
        assert {k for s, e, _, _ in stretches(np.array(x), np.array(y)) for k in range(s, e)} == want


def test_chain_that_fails_as_a_whole(docs_of):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p, q, long_ = text(50), text(50), text(200)
    shared = [text(15) for _ in range(12)]
    form = lambda: [w for x in shared for w in x + text(25)]
    rows = [(i, " ".join(text(20) + p + text(30) + q + text(20))) for i in (1, 2)]
    rows += [(i, " ".join(long_ + text(25) + form())) for i in (3, 4)]
    got = repeated_passages(docs_of(rows)).collect()
    for i in (1, 2):
        assert covered(got, i) == {*range(20, 70), *range(100, 150)}
    for i in (3, 4):
        assert set(range(200)) <= covered(got, i) and max(covered(got, i)) < 320


def test_short_seeds_scattered(docs_of):
    """Exact passages of 50 to 58 words, each 5-gram of which other documents hold too."""
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(12):
        n = 50 + i % 9
        p = text(n)
        for side in (0, 1):
            rows.append((10 * i + side, " ".join(text(30) + p + text(30))))
            want[10 * i + side] = set(range(30, 30 + n))
        for other in range(2, 10):  # nearly always one of them has the smallest hash
            rows.append((10 * i + other, " ".join(w for k in range(n - 4) for w in p[k:k + 5] + text(50))))
    got = repeated_passages(docs_of(rows)).collect()
    assert all(covered(got, i) >= held for i, held in want.items())
    assert {r["id"] for r in got} == set(want)


def test_passage_twice_in_a_document(docs_of):
    """Whole or partial copies before and after a passage, with many texts so that both hash orders occur."""
    rng = random.Random(10)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(30):
        p = text(60)
        part = p[:35] if i % 3 == 1 else p[20:] if i % 3 == 2 else p
        rows.append((10 * i, " ".join(part + text(40) + p)))
        rows.append((10 * i + 1, " ".join(text(20) + p + (text(40) + part if i % 2 else text(5)))))
        want[10 * i] = set(range(len(part) + 40, len(part) + 100)) | (set(range(60)) if i % 3 == 0 else set())
        want[10 * i + 1] = set(range(20, 80)) | (set(range(120, 180)) if i % 2 and i % 3 == 0 else set())
    got = repeated_passages(docs_of(rows)).collect()
    assert not [i for i, held in want.items() if not covered(got, i) >= held]


def test_empty(docs_of):
    assert repeated_passages(docs_of([])).count() == 0
