"""Substring dedup: collinear chains of shared k-mers.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Every
text gives its minimizers: of each 6 neighbouring 5-word hashes the smallest, and
of each 25 neighbouring 25-word hashes the smallest. Each occurrence of a seed is tied to the first document that has it, not to all
the others, and further occurrences in that one to the next: two rows per occurrence
at most, however many documents share a passage; seeds
that repeat in a batch of documents are tied there, and one of them goes on. A
long seed counts as three short ones. Every 50 words hold a long seed, and a chain
is lengthened by 25 words a side, so one long seed that ties two documents covers
their common 50 words, however the short seeds are scattered. What no tie covers: words
whose every long seed is first held by a document that shares the seed but less than 50 words.

For each pair of tied documents the matches on a diagonal are joined into
segments, and these are chained: a chain runs forward in both texts, a segment
scores its words, and words between segments cost in proportion. The best
predecessor of a segment is a prefix maximum, kept in a Fenwick tree over the
second text's places. Chains of 25 words are aligned: the words of both texts are fetched once for all chains of the pair,
chains are lengthened at both ends while words are equal, and gaps are aligned word by word. Every stretch of a chain,
from one run of equal words to another, that has 80 % equal words is covered in
both documents: a chain that fails as a whole is not lost. Stretches of a document are united,
whichever partner they come from, and those of ``min_words`` words are reported.

Defined results. Null and empty texts have no words and no passages. Rows that
repeat (same id and text) are one document; texts repeated under other ids are
passages of each other. A null doc_id is reported as null. An empty table gives
no rows.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import table, written
from kiln.llm.tokens import PIECE_ROWS, PUNCTUATED, WordHasher, mix, pieces, runs, windows

K = 5
WINDOW = 6
LONG = 25
INSIDE = (0, 5, 10, 15, 20)  # short windows that a long one is made of
STANDS_FOR = np.array([0, 10, 20])  # short matches that a long one counts as
GAP_COST = 0.1
LEAST_MATCHES = 3
LEAST_SPAN = 25
WIDEST_GAP = 40  # a chain is two where it jumps further
JOIN_WORDS = 30  # matches on a diagonal that are so near make one segment
IDENTITY = 0.8
MERGE_SALTS = 64
PIECE_VALUES = 1 << 19  # words or places handled at once


def _hasher() -> WordHasher:
    return WordHasher(PUNCTUATED, lower=False)


def _lowered(texts):
    return (t.lower() if isinstance(t, str) else None for t in texts)


def _words(texts):
    return _hasher().words(_lowered(texts))


def _slide(pick, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum (``pick``) of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return x if span == width else pick(x[:span - width], x[width - span:])


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the hashes that are smallest in some window."""
    if not len(h):
        return np.zeros(0, np.int64)
    width = min(window, len(h))
    least = _slide(np.minimum, h, width)  # of each window; a place is chosen if it is the least of one that holds it
    pad = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(_slide(np.maximum, np.concatenate([pad, least, pad]), width) == h)


def all_minimizers(h: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """``minimizers`` of many texts at once: h holds the hashes of all, sizes how many each has."""
    ends = np.cumsum(sizes)
    few = np.flatnonzero((sizes > 0) & (sizes < window))
    found = [ends[i] - sizes[i] + minimizers(h[ends[i] - sizes[i]:ends[i]], window) for i in few]
    if len(h) >= window:
        least = _slide(np.minimum, h, window)
        least[np.arange(len(least)) + window > np.repeat(ends, sizes)[:len(least)]] = 0  # reaches into the next text
        pad = np.zeros(window - 1, dtype=np.uint64)
        chosen = _slide(np.maximum, np.concatenate([pad, least, pad]), window) == h
        found.append(np.flatnonzero(chosen & np.repeat(sizes >= window, sizes)))
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def seeds(words: np.ndarray, bounds: np.ndarray):
    """(text, place, hash) of the short seeds and of the long ones, which hash five short windows in a row, of all texts:
    ``words`` of text i are those from bounds[i] on."""
    short = windows(words, tuple(range(K)))
    long_ = windows(short, INSIDE, 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = bounds[1:][text] - np.arange(len(text))  # words from here to the end of the text
    for h, window, length in ((short, WINDOW, K), (long_, LONG, LONG)):
        whole = np.flatnonzero(left >= length)
        at = whole[all_minimizers(h[whole], np.bincount(text[whole], minlength=len(bounds) - 1), window)]
        yield text[at], at - bounds[text[at]], h[at]


def seed_ties(docs: DataFrame) -> DataFrame:
    """u, up, v, vp: a seed at word up // 2 of u is at word vp of v, the first document with it; up is odd for long
    seeds. docs: rk, text."""
    def sow(it):
        for pdf in it:
            pdf = pdf.sort_values("rk", kind="stable")
            rks, begin, rows = pdf["rk"].to_numpy(), 0, []
            for words, ends in _hasher().chunks(_lowered(pdf["text"])):
                for flag, (text, at, h) in zip((0, 2), seeds(words, ends)):
                    rows.append((text + begin, at, h.view(np.int64), np.full(len(at), flag, dtype=np.int64)))
                begin += len(ends) - 1
            text, at, seed, long_ = (np.concatenate(x) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
            if not len(seed):
                continue
            order = np.argsort(text, kind="stable")
            rk, at, seed, long_ = rks[text[order]], at[order], seed[order], long_[order]
            yield _batch_ties(seed, rk, at, long_)

    # place holds the word number and two flags: a long seed, a tie made in the batch
    schema = "route bigint, u bigint, place bigint, v bigint, vp bigint"
    sown = docs.select("rk", "text").mapInPandas(sow, schema)
    sorted_ = sown.repartition("route").sortWithinPartitions("route", "u", "place")

    def join(it):
        last = None
        for pdf in it:
            route, u, place, v, vp = (pdf[c].to_numpy() for c in ("route", "u", "place", "v", "vp"))
            tied = (place & 1) == 1
            out = []
            if tied.any():
                out.append(pd.DataFrame({"u": u[tied], "up": place[tied] >> 2, "v": v[tied], "vp": vp[tied], "long": place[tied] & 2}))
            if not tied.all():
                rows = (route, u, place) if not tied.any() else tuple(x[~tied] for x in (route, u, place))
                if last and last[0][0] == rows[0][0]:  # the run goes on from the batch before
                    rows = tuple(np.append(x, y) for x, y in zip(last, rows))
                run = rows[0] == rows[0][-1]
                run &= rows[1] == rows[1][run][0]
                last = tuple(x[run] for x in rows)
                same = rows[0][1:] == rows[0][:-1]  # most seeds occur once
                if same.any():
                    same = np.append(False, same) | np.append(same, False)
                    seed, doc, at = (x[same] for x in rows)
                    out.append(_ties(seed, doc, at >> 2, at & 2)[0])
            if not out:
                continue
            got = pd.concat(out, ignore_index=True)
            got["up"] = got["up"] * 2 + got["long"] // 2
            yield got[["u", "up", "v", "vp"]]

    return sorted_.mapInPandas(join, "u bigint, up int, v bigint, vp int")


def _matches(it):
    """Ties with those of long seeds as the short matches they stand for."""
    for pdf in it:
        u, up, v, vp = (pdf[c].to_numpy() for c in ("u", "up", "v", "vp"))
        times = np.where(up & 1, len(STANDS_FOR), 1)
        row = np.repeat(np.arange(len(u)), times)
        step = STANDS_FOR[np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
        yield pd.DataFrame({"u": u[row], "up": (up[row] >> 1) + step, "v": v[row], "vp": vp[row] + step})


def _ties(seed, rk, at, long_) -> tuple[pd.DataFrame, np.ndarray]:
    """From rows sorted by seed, document and place: ties of every row to its run's first document, and which rows
    are that document's. Where a seed repeats in both, the n-th place is tied to the n-th (or last) one and to the
    first one. Further places of the first document are tied to the first place of the next one: at most two ties a
    row, and every place has one to a first place."""
    new = np.concatenate([[True], seed[1:] != seed[:-1]])
    first = np.flatnonzero(new)
    rows = np.diff(first, append=len(seed))
    head, rows = np.repeat(first, rows), np.repeat(rows, rows)
    doc = np.flatnonzero(new | np.concatenate([[True], rk[1:] != rk[:-1]]))
    times = np.diff(doc, append=len(seed))
    nth = np.arange(len(seed)) - np.repeat(doc, times)
    held = times[np.searchsorted(doc, head)]  # places of the run's first document
    own = rk[head] == rk
    far = np.flatnonzero(~own)
    to = head[far] + np.minimum(nth, held - 1)[far]
    again = to > head[far]
    further = np.flatnonzero(own & (nth > 0) & (held < rows))
    far, to = (np.concatenate(x) for x in ((far, far[again], (head + held)[further]), (to, head[far[again]], further)))
    return pd.DataFrame({"u": rk[far], "up": at[far], "v": rk[to], "vp": at[to], "long": long_[far]}), own


def _batch_ties(seed, rk, at, long_) -> pd.DataFrame:
    """What a batch, whose rows come by document and place, sends on: its ties, dealt out by pair, and the rows of
    each seed's first document, still in the order of documents (which packs better)."""
    order = np.argsort(seed, kind="stable")
    ties, first = _ties(seed[order], rk[order], at[order], long_[order])
    u, v = ties["u"].to_numpy(), ties["v"].to_numpy()
    ties = pd.DataFrame({"route": mix((u ^ v).view(np.uint64)).view(np.int64), "u": u,
                         "place": ties["up"] * 4 + ties["long"] + 1, "v": v, "vp": ties["vp"]})
    own = np.zeros(len(seed), dtype=bool)
    own[order[first]] = True
    zero = np.zeros(int(own.sum()), dtype=np.int64)
    own = pd.DataFrame({"route": seed[own], "u": rk[own], "place": at[own] * 4 + long_[own], "v": zero, "vp": zero})
    return pd.concat([own, ties], ignore_index=True)


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def update(self, i: int, value: float, index: int):
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, index)
            i += i & -i

    def query(self, i: int) -> tuple[float, int]:
        """The best of the places before i."""
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def segments(up: np.ndarray, vp: np.ndarray) -> np.ndarray:
    """Matches on one diagonal that follow each other closely, as rows (first and last word of u, of v), by u."""
    diagonal = vp - up
    order = np.lexsort((up, diagonal))
    up, vp, diagonal = up[order], vp[order], diagonal[order]
    new = np.flatnonzero(np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (up[1:] - up[:-1] > JOIN_WORDS)]))
    last = np.append(new[1:], len(up)) - 1
    out = np.stack([up[new], up[last], vp[new], vp[last]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def chains(segs: list[list[int]]) -> list[list[int]]:
    """Indices of the segments in each chain, best chains first; segments are (first and last place in u, in v),
    sorted by u. A segment scores its words; words between two segments cost in proportion."""
    n = len(segs)
    if n == 1:
        return [[0]]
    rank = {p: i for i, p in enumerate(sorted({x for s in segs for x in (s[2], s[3])}))}
    tree = Fenwick(len(rank))
    score, back = [0.0] * n, [-1] * n
    # by place in u: a segment asks for the best one that ended before it, and offers itself once it has ended
    events = sorted([(s[0], 0, i) for i, s in enumerate(segs)] + [(s[1], 1, i) for i, s in enumerate(segs)])
    for _, ended, i in events:
        u0, u1, v0, v1 = segs[i]
        if ended:
            tree.update(rank[v1], score[i] + GAP_COST * (u1 + v1), i)
            continue
        value, before = tree.query(rank[v0])
        gain = value - GAP_COST * (u0 + v0)
        score[i], back[i] = (u1 - u0 + K + gain, before) if before >= 0 and gain > 0 else (float(u1 - u0 + K), -1)
    used, out = [False] * n, []
    for m in sorted(range(n), key=lambda x: -score[x]):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = back[m]
        if chain:
            out.append(chain[::-1])
    return out


def _gathered(rows, columns: list[str]):
    """Rows as frames of some size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(getattr(x, "size", 0) for x in row)
        if len(held) == PIECE_ROWS or size >= PIECE_VALUES:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _chains_of(it, pad: int):
    """A pair, the segments of all its chains, how many each chain has, and the parts of both texts they can reach."""
    for pdf in runs(_matches(it), ["u", "v"], LEAST_MATCHES):
        up, vp = pdf["up"].to_numpy(), pdf["vp"].to_numpy()
        if min(np.ptp(up), np.ptp(vp)) + K < LEAST_SPAN:
            continue
        segs = segments(up, vp)
        rows = segs.tolist()
        picked, sizes = [], []
        for c in chains(rows):
            begin = 0
            for end in range(1, len(c) + 1):
                u0, _, v0, _ = rows[c[begin]]
                _, u1, _, v1 = rows[c[end - 1]]
                if end < len(c) and max(rows[c[end]][0] - u1, rows[c[end]][2] - v1) <= WIDEST_GAP:
                    continue
                if min(u1 - u0, v1 - v0) + K >= LEAST_SPAN:
                    picked += c[begin:end]
                    sizes.append(end - begin)
                begin = end
        if sizes:
            sizes, held = np.array(sizes, dtype=np.int32), segs[picked].astype(np.int32)
            ups, vps = held[:, :2].ravel(), held[:, 2:].ravel()
            reach = [parts(*bounds(sizes, p, pad)) for p in (ups, vps)]
            yield int(pdf["u"].iat[0]), int(pdf["v"].iat[0]), sizes, ups, vps, *reach


def bounds(sizes: np.ndarray, places: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and the word after the last one of what each chain can reach in a text."""
    last = 2 * np.cumsum(sizes) - 1
    first = last - 2 * sizes + 1
    return np.maximum(0, places[first] - pad), places[last] + K + pad


def parts(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Stretches that overlap or touch made one: start and stop of each, one after the other."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
    return np.stack([first[new], last[np.append(new[1:], len(last)) - 1]], axis=1).ravel().astype(np.int32)


def equal_words(a: np.ndarray, b: np.ndarray, ups: np.ndarray, vps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the equal words of the chain, lengthened at both ends while words are equal. ``ups`` and
    ``vps`` hold the first and last place of each segment. Words in place of each other (in a segment, or in two
    gaps of one length) are compared; those of other gaps are matched in order."""
    s, t = int(ups[0]), int(vps[0])
    head = _equal_run(a[:s][::-1], b[:t][::-1])
    at, off = [np.arange(s - head, s)], [np.arange(t - head, t)]

    def compare(x, y, n):
        same = np.flatnonzero(a[x:x + n] == b[y:y + n])
        at.append(x + same)
        off.append(y + same)

    i, j = s, t  # words before i and j are counted
    for u0, u1, v0, v1 in zip(ups[::2], ups[1::2], vps[::2], vps[1::2]):
        if u0 < i or v0 < j:  # the segment before reaches into this one
            skip = max(i - u0, j - v0)
            u0, v0 = u0 + skip, v0 + skip
        if u0 - i == v0 - j:
            compare(i, j, u0 - i)
        else:
            for m in SequenceMatcher(None, a[i:u0].tolist(), b[j:v0].tolist(), autojunk=False).get_matching_blocks():
                at.append(np.arange(i + m.a, i + m.a + m.size))
                off.append(np.arange(j + m.b, j + m.b + m.size))
        i, j = max(i, int(u1) + K), max(j, int(v1) + K)
        compare(u0, v0, max(0, min(i - u0, j - v0)))
    tail = _equal_run(a[i:], b[j:])
    at.append(np.arange(i, i + tail))
    off.append(np.arange(j, j + tail))
    return np.concatenate(at), np.concatenate(off)


def align(a: np.ndarray, b: np.ndarray, ups: np.ndarray, vps: np.ndarray) -> tuple[int, int, int, int, int]:
    """(start, end) of the chain in a and b, from its first to its last equal word, and the equal words in it."""
    x, y = equal_words(a, b, ups, vps)
    return (int(x[0]), int(x[-1]) + 1, int(y[0]), int(y[-1]) + 1, len(x)) if len(x) else (0, 0, 0, 0, 0)


def stretches(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end) in both texts of the stretches of an alignment that have 80 % equal words, from its equal words.
    They begin and end with runs of equal words; of those that begin with one run the longest is given, and none
    that lies in another. A run without changes is one by itself, so no run is lost with what is around it."""
    if not len(x):
        return []
    new = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1)]))
    last = np.append(new[1:], len(x)) - 1
    equal = np.concatenate([[0], np.cumsum(last - new + 1)])
    # before a run and after it: the equal words less their share of all words, in x and in y
    before = np.stack([equal[:-1] - IDENTITY * z[new] for z in (x, y)])
    after = np.stack([equal[1:] - IDENTITY * (z[last] + 1) for z in (x, y)])
    out, reach = [], -1
    for i in range(len(new)):
        far = max(reach + 1, i)
        good = np.flatnonzero((after[:, far:] >= before[:, i:i + 1] - 1e-6).all(axis=0))
        if len(good):
            reach = far + int(good[-1])
            out.append((int(x[new[i]]), int(x[last[reach]]) + 1, int(y[new[i]]), int(y[last[reach]]) + 1))
        if reach == len(new) - 1:
            break
    return out


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from the start are equal."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _exact(a: np.ndarray, b: np.ndarray, u0, n, v0, heads, tails, pad: int) -> tuple[np.ndarray, ...]:
    """For chains of one segment, many at once: whether all its ``n`` words from u0 in a and v0 in b are equal, and how many
    equal words are before and after it, ``pad`` at most and no more than the ``heads`` and ``tails`` there are."""
    ends = np.cumsum(n)
    inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
    differ = a[np.repeat(u0, n) + inside] != b[np.repeat(v0, n) + inside]
    equal = np.add.reduceat(differ, ends - n, dtype=np.int64) == 0
    step = np.arange(pad)
    around = []
    for x, y, sign, room in ((u0 - 1, v0 - 1, -1, heads), (u0 + n, v0 + n, 1, tails)):
        there = step < room[:, None]
        i, j = (np.where(there, z[:, None] + sign * step, 0) for z in (x, y))
        same = there & (a[i] == b[j])
        around.append(np.where(same.all(axis=1), pad, same.argmin(axis=1)) if pad else np.zeros(len(n), np.int64))
    return equal, *around


def pair_stretches(a, b, sizes, ups, vps, ureach, vreach, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of two texts that the accepted stretches of their chains cover. a and b hold the words of ureach and vreach.
    Most chains are one segment of equal words, as texts that repeat a block have one for every place of it: these are
    compared many at once, the others are aligned one by one."""
    sides = []
    for words, places, reach in ((a, ups, ureach), (b, vps, vreach)):
        first, last = bounds(sizes, places, pad)
        part = np.searchsorted(reach[::2], first, side="right") - 1
        shift = (np.cumsum(reach[1::2] - reach[::2]) - reach[1::2])[part].astype(np.int64)  # from a place to its word in words
        sides.append((first + shift, np.minimum(last + shift, len(words)), shift))
    (afirst, alast, ashift), (bfirst, blast, bshift) = sides
    to = np.cumsum(sizes)
    found, rest = [], [np.flatnonzero(sizes != 1)]
    one = np.flatnonzero(sizes == 1)
    at = 2 * (to[one] - 1)
    u0, v0, n = ups[at] + ashift[one], vps[at] + bshift[one], ups[at + 1].astype(np.int64) - ups[at] + K
    some = np.cumsum(n + 2 * pad) // PIECE_VALUES
    for x in np.split(np.arange(len(one)), np.flatnonzero(np.diff(some)) + 1) if len(one) else ():
        c, i, j, k = one[x], u0[x], v0[x], n[x]
        equal, head, tail = _exact(a, b, i, k, j, np.minimum(i - afirst[c], j - bfirst[c]),
                                   np.minimum(alast[c] - i - k, blast[c] - j - k), pad)
        size = head + k + tail
        s, t = i - head - ashift[c], j - head - bshift[c]
        found.append(np.stack([s, s + size, t, t + size], axis=1)[equal & (size >= LEAST_SPAN)])
        rest.append(c[~equal])
    for c in np.concatenate(rest).tolist():
        places = slice(2 * int(to[c] - sizes[c]), 2 * int(to[c]))
        s, t = int(afirst[c]), int(bfirst[c])
        x, y = equal_words(a[s:alast[c]], b[t:blast[c]], ups[places] + (ashift[c] - s), vps[places] + (bshift[c] - t))
        got = [w for w in stretches(x + (s - ashift[c]), y + (t - bshift[c])) if min(w[1] - w[0], w[3] - w[2]) >= LEAST_SPAN]
        found.append(np.array(got, dtype=np.int64).reshape(-1, 4))
    got = np.concatenate(found)
    return tuple(parts(got[:, k], got[:, k + 1]) if len(got) else np.zeros(0, np.int32) for k in (0, 2))


def _aligned(it, pad: int):
    """The two sides of a pair meet; a row for each document and part of it that is covered."""
    pair, held = None, None
    for pdf in it:
        for u, v, side, sizes, ups, vps, reach, words in zip(
                *(pdf[c].tolist() for c in ("u", "v", "side")), *(pdf[c] for c in ("sizes", "ups", "vps", "reach", "words"))):
            words = np.frombuffer(words, dtype=np.int64)
            if side == 0:  # sorted by pair and side: the other side is next; documents may repeat
                pair, held = (u, v), (words, sizes, ups, vps, reach)
                continue
            if pair != (u, v):
                continue
            pair = None
            for own, other, got in zip((u, v), (v, u), pair_stretches(held[0], words, *held[1:], reach, pad)):
                for s, e in got.reshape(-1, 2).tolist():
                    yield own, s, e, other


def _unite(it):
    """Stretches of a document that overlap or touch, from rows sorted by it and by start."""
    key, cur = None, None
    for pdf in it:
        out = []
        for rk, salt, s, e, p in zip(*(pdf[c].tolist() for c in ("rk", "salt", "start", "stop", "partner"))):
            if key == (rk, salt) and s <= cur[2]:
                cur[2] = max(cur[2], e)
                cur[3] = min(cur[3], p)
                continue
            if cur:
                out.append(tuple(cur))
            key, cur = (rk, salt), [rk, s, e, p]
        if out:
            yield pd.DataFrame(out, columns=["rk", "start", "stop", "partner"])
    if cur:
        yield pd.DataFrame([tuple(cur)], columns=["rk", "start", "stop", "partner"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """id, start, n_words, partner (id of a document that shares a part of it) of every repeated passage."""
    base = docs.select(F.xxhash64(id_col, text_col).alias("rk"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pad = max(0, min_words - LONG)  # a passage of min_words reaches no further beyond a long seed of it
    ties = seed_ties(base)
    arrays = "sizes array<int>, ups array<int>, vps array<int>"
    linked = ties.repartition("u", "v").sortWithinPartitions("u", "v").mapInPandas(
        lambda it: _gathered(_chains_of(it, pad), ["u", "v", "sizes", "ups", "vps", "ureach", "vreach"]),
        f"u bigint, v bigint, {arrays}, ureach array<int>, vreach array<int>")
    linked = written(linked, "passage-chains")
    chained = ("sizes", "ups", "vps")  # go with one side
    sides = F.array(F.struct(F.col("u").alias("rk"), F.lit(0).alias("side"), F.col("ureach").alias("reach"), *chained),
                    F.struct(F.col("v").alias("rk"), F.lit(1).alias("side"), F.col("vreach").alias("reach"),
                             *(F.lit(None).cast("array<int>").alias(c) for c in chained)))
    wanted = linked.select("u", "v", F.explode(sides).alias("x")).select("u", "v", "x.*")
    joined = wanted.join(base.select("rk", "text"), "rk")

    def cut(it):
        known = (None, None)
        for pdf in pieces(it):
            out, size = [], 0
            for i, (rk, text, reach) in enumerate(zip(pdf["rk"].tolist(), pdf["text"], pdf["reach"])):
                if known[0] != rk:
                    known = (rk, next(_words([text])))
                out.append(b"".join(known[1][s:e].tobytes() for s, e in reach.reshape(-1, 2).tolist()))
                size += len(out[-1])
                if size >= 8 * PIECE_VALUES or i == len(pdf) - 1:
                    yield pdf[["u", "v", "side", "sizes", "ups", "vps", "reach"]].iloc[i + 1 - len(out):i + 1].assign(words=out)
                    out, size = [], 0

    sliced = joined.mapInPandas(cut, f"u bigint, v bigint, side int, {arrays}, reach array<int>, words binary")
    covered = sliced.repartition("u", "v").sortWithinPartitions("u", "v", "side").mapInPandas(
        lambda it: _gathered(_aligned(it, pad), ["rk", "start", "stop", "partner"]), "rk bigint, start int, stop int, partner bigint")
    # a document that shares a passage with a third of all others has as many stretches: unite them by salts first
    salted = covered.withColumn("salt", F.pmod("partner", F.lit(MERGE_SALTS)))
    for salts in (salted, None):
        rows = salts if salts is not None else merged.withColumn("salt", F.lit(0).cast("bigint"))
        merged = rows.repartition("rk", "salt").sortWithinPartitions("rk", "salt", "start").mapInPandas(
            _unite, "rk bigint, start int, stop int, partner bigint")
    passages = merged.where(F.col("stop") - F.col("start") >= min_words)
    names = base.groupBy("rk").agg(F.min("id").alias("id"))
    passages = passages.join(names, "rk").join(
        names.select(F.col("rk").alias("partner"), F.col("id").alias("partner_id")), "partner")
    return passages.select("id", "start", (F.col("stop") - F.col("start")).alias("n_words"),
                           F.col("partner_id").alias("partner"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each passage of 50 words or more of a document that is found in another one."""
    got = repeated_passages(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), "n_words",
                      F.col("partner").alias("partner_doc_id"))
