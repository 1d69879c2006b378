"""N-gram Jaccard join: exact groups of documents whose shingle sets link.

Two sets link when 100 * intersection >= 80 * union. Equal sets are one class
from the start. The classes that can link are brought together first, then
every class is searched by T-occurrence among those it was brought together
with.

Bringing together loses no link. Linked sets of sizes a <= b differ in at most
(a + b) / 9 shingles, and b <= 1.25 a. Size bands grow by 1.5625; a table for
each band holds its sets and those of the band below that are large enough, and
cuts the hash range into more parts than sets of that band may differ in. Two
linked sets then agree in a whole part, and share the hash of (table, part,
shingles in it). Empty parts agree by chance and are left out; a set with so
many of them that the count no longer proves a common part (it is rare) adds
its empty parts, which only such sets do. Parts of several shingles seldom
agree by chance. Most hashes occur once: they are shuffled in packed rows of about
eight bytes a hash, and only those that repeat go on. Classes that share a hash are compared by parity bitmaps: the
Hamming distance of two bitmaps is never above the number of shingles in which
the sets differ, and it is a metric. Of the classes with one hash some are
leaders; a class is compared with leaders only, connected with all of them within
the distance at which a class of theirs could link with it (by one tie to each
group of leaders not yet connected), and becomes a leader if none is near. Documents that merely share passages part there. Connected
components of the ties are the candidate groups.

T-occurrence runs inside a candidate group, over an inverted index of its
shingles: linked sets share T = 0.8 |x| shingles at least, so lists are split
into the L longest and the rest; the short lists are merged and counted, and
only sets with T - L occurrences are probed by binary search in the long lists.
A group of more than ``block_shingles`` shingles is split into blocks by size
band and hash, and each pair of blocks that sizes allow is searched, so no task
holds more than two blocks. Links inside a block are united at once; a task
returns a row per class, not per link.

Defined results. Words are runs of other than ASCII white space, A-Z folded.
Null, empty and blank texts: n_shingles 0, linked with nothing, a component of
their own. Fewer than five words make one shingle. Repeated rows and rows that
share an id are found by their sets; a component's name is its smallest non-null
doc_id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.bloom import may_hold
from kiln.llm.common import WORD_RE, shuffle_partitions, table, written
from kiln.llm.graph import connected_components
from kiln.llm.tokens import PIECE_ROWS, SPACE_BYTES, WordHasher, mix, pieces, runs, shingle_set

K = 5
PERCENT = 80
BAND = 1.5625
RUN_ROWS = 1_000_000
PACKED_ROWS = 1_000_000  # signatures that a task packs at once
BUCKET_ROWS = 1_000_000  # signatures of a bucket, about
NAME_BYTES = 5  # of a class's s1, the upper ones: its short name
SHORT = np.uint64(64 - 8 * NAME_BYTES)
LOWER_HALF = np.uint64(0xFFFFFFFF)


def _sets(pdf: pd.DataFrame):
    return (shingle_set(w, K) for w in WordHasher(SPACE_BYTES).words(pdf["text"]))


def _identity(s: np.ndarray) -> tuple[int, int]:
    a = mix(s ^ np.uint64(0x51ED270B0A1F39C1)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(np.int64(a.view(np.int64))), int(s.sum(dtype=np.uint64).view(np.int64))


def _band(n: int) -> int:
    t = max(0, int(np.log(n) / np.log(BAND)) - 1)
    while BAND ** (t + 1) <= n:
        t += 1
    return t


def _parts(t: int) -> int:
    largest = int(np.ceil(BAND ** (t + 1))) - 1  # of the band's sizes
    differ = 2 * largest * (100 - PERCENT) // (100 + PERCENT)
    return differ + 2 + differ // 32


def _differ(n: int) -> int:
    """The most shingles in which a set of n shingles differs from one linked with it."""
    return int((n + n * 100 / PERCENT) * (100 - PERCENT) / (100 + PERCENT) + 1e-9)


def signatures(s: np.ndarray) -> np.ndarray:
    """Hashes of (table, part, shingles of the part) of a sorted set."""
    n = len(s)
    home = _band(n)
    tables = [home] + [home + 1] * (n >= BAND ** (home + 1) * PERCENT / 100)
    out = []
    mixed = mix(s)
    for t in tables:
        parts = _parts(t)
        part = ((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        key = mix((part[cuts] + 1 + (t << 40)).astype(np.uint64))
        out.append(mix(np.add.reduceat(mixed, cuts) ^ key))
        if len(cuts) <= _differ(n):
            empty = np.setdiff1d(np.arange(parts), part[cuts])
            out.append(mix(~mix((empty + 1 + (t << 40)).astype(np.uint64))))
    return np.concatenate(out)


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap of twice as many bits as shingles or more, a power of two: each shingle flips one bit."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    at = (mix(s ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) brought to ``words`` words: a bit keeps its place modulo their length."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of text), n_shingles, s1, s2 (identity of the set), parity of every row."""
    base = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("th"),
                       F.col(text_col).alias("text"))  # ids may be null: they pass through pandas as text

    def identify(it):
        for pdf in pieces(it):
            got = [(len(s), *_identity(s), parity(s).tobytes()) for s in _sets(pdf)]
            out = pd.DataFrame(got, columns=["n_shingles", "s1", "s2", "parity"], index=pdf.index)
            yield pd.concat([pdf[["id", "th"]], out], axis=1)

    got = base.mapInPandas(identify, "id string, th bigint, n_shingles bigint, s1 bigint, s2 bigint, parity binary")
    return got.withColumn("id", F.col("id").cast(dict(docs.dtypes)[id_col]))


def packed(sig: np.ndarray, node: np.ndarray, buckets: int) -> pd.DataFrame:
    """bucket, rows: the signatures of a bucket and the short names of their classes, as bytes. A bucket is a range
    of the upper half of a signature; the lower half is what a row keeps, as its distance from the one before it, in
    as many bytes as the widest of them needs."""
    bucket = (sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(bucket << np.uint64(32) | sig & LOWER_HALF, kind="stable")
    bucket, sig, node = bucket[order], (sig & LOWER_HALF)[order], node[order]
    cuts = np.flatnonzero(np.diff(bucket.view(np.int64), prepend=-1))
    step = np.diff(sig, prepend=np.uint64(0))
    step[cuts] = sig[cuts]
    name = (node >> SHORT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]
    widths = np.maximum(1, (np.bitwise_count(_filled(np.maximum.reduceat(step, cuts))) + 7) // 8)
    step = step.astype("<u4").view(np.uint8).reshape(-1, 4)
    rows = [bytes([w]) + step[a:b, :w].tobytes() + name[a:b].tobytes()
            for a, b, w in zip(cuts, np.append(cuts[1:], len(sig)), widths.tolist())]
    return pd.DataFrame({"bucket": bucket[cuts].astype(np.int64), "rows": rows})


def _filled(x: np.ndarray) -> np.ndarray:
    """All bits below the highest one set as well (of 32)."""
    for n in (1, 2, 4, 8, 16):
        x = x | x >> np.uint64(n)
    return x


def unpacked(rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lower halves of the signatures, short names) of what ``packed`` made for a bucket."""
    w = rows[0]
    n = (len(rows) - 1) // (w + NAME_BYTES)
    step, name = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
    step[:, :w] = np.frombuffer(rows, np.uint8, n * w, 1).reshape(n, w)
    name[:, :NAME_BYTES] = np.frombuffer(rows, np.uint8, n * NAME_BYTES, 1 + n * w).reshape(n, NAME_BYTES)
    return np.cumsum(step.view("<u8").ravel()), name.view("<u8").ravel()


class Repeats:
    """A bucket's signatures as they come: the first class of each is held, and rows go on once a second class has
    the signature. What is held follows the distinct signatures of the bucket, however often one repeats."""

    def __init__(self):
        self.sig, self.node, self.told = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)

    def take(self, sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (signature, class) that go on; one may go on again when it comes again."""
        sig, node = np.concatenate([self.sig, sig]), np.concatenate([self.node, node])
        told = np.concatenate([self.told, np.zeros(len(sig) - len(self.sig), bool)])
        order = np.lexsort((node, sig))
        sig, node, told = sig[order], node[order], told[order]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(first, append=len(sig))
        repeats = node[first] != node[first + size - 1]
        on = np.repeat(repeats, size) & ~told
        self.sig, self.node = sig[first], node[first]
        self.told = repeats | np.logical_or.reduceat(told, first)
        # the class now held has gone on: it is in this round's rows, or was in those of an earlier one
        return sig[on], node[on]


def _repeated(it):
    """sig (bucket and lower half), node (short name) of the signatures that several classes have."""
    bucket, seen, held, size = None, Repeats(), [], 0

    def sent():
        sig, node = seen.take(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pd.DataFrame({"sig": (np.uint64(bucket) << np.uint64(32) | sig).view(np.int64),
                             "node": node.view(np.int64)})

    for pdf in it:
        for b, rows in zip(pdf["bucket"].tolist(), pdf["rows"]):
            if b != bucket:
                if held:
                    yield sent()
                bucket, seen, size = b, Repeats(), 0
            held.append(unpacked(rows))
            size += len(held[-1][0])
            if size >= max(BUCKET_ROWS, len(seen.sig)):
                yield sent()
                size = 0
    if held:
        yield sent()


def shared_signatures(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """run, node: the classes (short names) that share a signature; signatures with the same classes are one run.

    Most signatures occur once. They travel in packed rows of a bucket and only those that repeat there go on; with
    ``buckets`` in proportion to the signatures (about BUCKET_ROWS in each), the halves that are compared agree by
    chance once in 4,000 signatures, whatever the size, which costs a comparison and loses nothing."""
    base = docs.select(F.col(text_col).alias("text"))

    def sign(it):
        seen: set[int] = set()  # equal sets of a task sign once, as far as these are remembered
        sigs, nodes, size = [], [], 0
        for pdf in pieces(it):
            for s in _sets(pdf):
                node = _identity(s)[0]
                if len(s) and node not in seen:
                    if len(seen) == RUN_ROWS:
                        seen.clear()
                    seen.add(node)
                    sigs.append(signatures(s))
                    nodes.append(node)
                    size += len(sigs[-1])
                    if size >= PACKED_ROWS:
                        yield _pack(sigs, nodes, buckets)
                        sigs, nodes, size = [], [], 0
        if sigs:
            yield _pack(sigs, nodes, buckets)

    sown = base.mapInPandas(sign, "bucket bigint, rows binary").repartition("bucket").sortWithinPartitions("bucket")
    repeated = sown.mapInPandas(_repeated, "sig bigint, node bigint")
    grouped = repeated.repartition("sig").sortWithinPartitions("sig", "node")

    def members(it):
        sig, node, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for pdf in it:
            sig, node = np.append(sig, pdf["sig"].to_numpy()), np.append(node, pdf["node"].to_numpy())
            if not len(sig):
                continue
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
            sig, node = sig[new], node[new]
            last = int(np.flatnonzero(sig == sig[-1])[0])
            if last == 0 and len(sig) > RUN_ROWS:  # a run too long to hold goes out in pieces under one name
                open_ = sig[0]
                yield pd.DataFrame({"run": mix(sig.view(np.uint64)).view(np.int64), "node": node})[:-1]
                sig, node = sig[-1:], node[-1:]
                continue
            out = _named(sig[:last], node[:last], open_)
            if len(out):
                yield out
            sig, node = sig[last:], node[last:]
        if len(sig):
            out = _named(sig, node, open_)
            if len(out):
                yield out

    return grouped.mapInPandas(members, "run bigint, node bigint").distinct()


def _pack(sigs: list[np.ndarray], nodes: list[int], buckets: int) -> pd.DataFrame:
    names = np.array(nodes, dtype=np.int64).view(np.uint64)
    return packed(np.concatenate(sigs), np.repeat(names, [len(x) for x in sigs]), buckets)


def _named(sig: np.ndarray, node: np.ndarray, open_) -> pd.DataFrame:
    """Runs of two classes or more, named by their classes (by the signature, if a part of it is out)."""
    if not len(sig):
        return pd.DataFrame({"run": sig, "node": node})
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(first, append=len(sig))
    name = mix(np.add.reduceat(mix(node.view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)
    goes_on = sig[first] == open_ if open_ is not None else np.zeros(len(first), dtype=bool)
    name[goes_on] = mix(sig[first][goes_on].view(np.uint64)).view(np.int64)
    keep = np.repeat((size > 1) | goes_on, size)
    return pd.DataFrame({"run": np.repeat(name, size)[keep], "node": node[keep]})


class Leaders:
    """Leaders of one run. A few are kept as integers; many, by bitmap length, in arrays that double."""

    FEW = 16

    def __init__(self):
        self.few: list[tuple[int, int, int, int]] = []  # position, size, bits, bitmap
        self.many: dict[int, list] = {}  # words -> [count, positions, sizes, bitmaps]

    def add(self, at: int, size: int, bitmap: bytes):
        if len(self.few) < self.FEW:
            self.few.append((at, size, 8 * len(bitmap), int.from_bytes(bitmap, "little")))
            return
        row = np.frombuffer(bitmap, dtype=np.uint64)
        if len(row) not in self.many:
            self.many[len(row)] = [0, np.zeros(4, np.int64), np.zeros(4, np.int64), np.zeros((4, len(row)), np.uint64)]
        h = self.many[len(row)]
        if h[0] == len(h[1]):
            h[1:] = [np.concatenate([x, np.zeros_like(x)]) for x in h[1:]]
        n = h[0]
        h[1][n], h[2][n], h[3][n] = at, size, row
        h[0] += 1

    def near(self, size: int, bitmap: bytes) -> tuple[list[int], bool]:
        """Positions of the leaders to be tied, and whether one is so near that this class leads nothing."""
        # a class within a quarter of its size of a leader, and one linked with it, bound the distance
        ties, close = [], False
        bits, whole = 8 * len(bitmap), int.from_bytes(bitmap, "little")
        for at, s, b, m in self.few:
            x, y = whole, m
            width = max(bits, b)
            while width > min(bits, b):
                width //= 2
                x, y = (_halved(x, width), y) if bits > b else (x, _halved(y, width))
            far = (x ^ y).bit_count()
            if far <= min(0.5625 * size, 0.625 * s, 0.3125 * s + 0.25 * size):
                ties.append(at)
                close |= far <= 0.25 * size and PERCENT * size <= 100 * s and PERCENT * s <= 100 * size
        row = np.frombuffer(bitmap, dtype=np.uint64) if self.many else None
        for words, (n, at, sizes, maps) in self.many.items():
            m = min(words, len(row))
            a = maps[:n] if m == words else fold(maps[:n], m)
            b = row if m == len(row) else fold(row[None, :], m)[0]
            far = np.bitwise_count(a ^ b).sum(axis=1)
            s = sizes[:n]
            ties += at[:n][far <= np.minimum(np.minimum(0.5625 * size, 0.625 * s), 0.3125 * s + 0.25 * size)].tolist()
            close |= bool(((far <= 0.25 * size) & (PERCENT * size <= 100 * s) & (PERCENT * s <= 100 * size)).any())
        return ties, close


def _halved(x: int, width: int) -> int:
    """A bitmap of 2 * width bits folded to width."""
    return (x >> width) ^ (x & ((1 << width) - 1))


class Run:
    """Classes that share a signature, one after the other: only the leaders are held."""

    def __init__(self):
        self.leaders, self.nodes, self.label = Leaders(), [], []

    def take(self, node: int, size: int, bitmap: bytes):
        """Yield (node, leader) ties of the next class: as many as connect what is near, and no more."""
        ties, close = self.leaders.near(size, bitmap)
        groups: dict[int, int] = {}
        for t in ties:
            groups.setdefault(self.label[t], t)
        for t in groups.values():
            yield node, self.nodes[t]
        keep = next(iter(groups), len(self.nodes))
        if len(groups) > 1:
            self.label = [keep if x in groups else x for x in self.label]
        if not close:
            self.leaders.add(len(self.nodes), size, bitmap)
            self.nodes.append(node)
            self.label.append(keep)


def _tie(it):
    """u, v: ties of each run's classes, from rows sorted by run."""
    name, run = None, None
    for pdf in it:
        out = []
        for key, node, size, bitmap in zip(*(pdf[c].tolist() for c in ("run", "node", "n", "parity"))):
            if key != name:
                name, run = key, Run()
            out.extend(run.take(node, size, bitmap))
        if out:
            yield pd.DataFrame(out, columns=["u", "v"])


def candidate_ties(docs: DataFrame, known: DataFrame, text_col: str) -> DataFrame:
    """u, v: ties between classes (s1) whose components hold all links."""
    short = F.shiftrightunsigned("s1", int(SHORT))
    bitmaps = known.where("n_shingles > 0").dropDuplicates(["s1"]).select(
        F.col("s1").alias("node"), short.alias("short"), F.col("n_shingles").alias("n"), "parity")
    # a set has fewer signatures than shingles in a table, and is in one or two of them
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(4 * shuffle_partitions(docs.sparkSession), -(-total // BUCKET_ROWS))
    shared = shared_signatures(docs, text_col, buckets).select("run", F.col("node").alias("short"))
    held = shared.join(bitmaps, "short").select("run", "node", "n", "parity")
    ties = held.repartition("run").sortWithinPartitions("run", "node").mapInPandas(_tie, "u bigint, v bigint")
    # classes of one short name count as one above: they are tied as they are
    namesakes = bitmaps.groupBy("short").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last")
    return ties.unionByName(bitmaps.join(namesakes, "short").where("node <> v").select(
        F.col("node").alias("u"), "v")).distinct()


def linked_positions(sets: list[np.ndarray], queries: int | None = None, first: int = 0) -> np.ndarray:
    """T-occurrence search of the sets' inverted index: the sets before position ``queries`` are searched among
    those from position ``first`` on. Returns for each position the smallest one of its group."""
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    words = np.concatenate(sets[first:])
    owner = np.repeat(np.arange(first, len(sets)), sizes[first:])
    order = np.lexsort((owner, words))
    words, owner = words[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    keys, ends = words[starts], np.append(starts[1:], len(words))
    for x in range(len(sets) if queries is None else queries):
        if not label.any():  # all are one group already
            break
        s = sets[x]
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        at = at[keys[at] == s]
        need = -(-PERCENT * len(s) // 100)
        if len(at) < need:
            continue
        length = ends[at] - starts[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(length.max())
        n_long = min(need - 1, int(need / (0.02 * np.log2(longest + 1) + 1))) if longest > 8 else 0
        short, long_ = at[:len(at) - n_long], at[len(at) - n_long:]
        counts = np.bincount(np.concatenate([owner[starts[i]:ends[i]] for i in short]), minlength=len(sets))
        found = np.flatnonzero(counts >= need - n_long)
        found = found[(label[found] != label[x]) & (sizes[found] * 100 >= PERCENT * len(s))
                      & (PERCENT * sizes[found] <= 100 * len(s))]
        counts = counts[found]
        for i in long_:
            if not len(found):
                break
            post = owner[starts[i]:ends[i]]
            counts = counts + (post[np.minimum(np.searchsorted(post, found), len(post) - 1)] == found)
        for y in found[100 * counts >= PERCENT * (len(s) + sizes[found] - counts)]:
            low, high = sorted((label[x], label[y]))
            if low != high:
                label[label == high] = low
    return label


def _search(it):
    """Blocks of a candidate group, or pairs of blocks, each as one run of rows; a row for each linked class."""
    held: list[np.ndarray] = []
    for pdf in runs(it, ["key"]):
        pdf = pdf.sort_values(["side", "s1", "s2"], kind="stable").drop_duplicates(["side", "s1", "s2"])
        sets = [np.frombuffer(b, dtype=np.uint64) for b in pdf["shingles"]]
        left = int((pdf["side"] == 0).sum())
        if len(sets) < 2 or not left:
            continue
        root = linked_positions(sets) if left == len(sets) else linked_positions(sets, left, left)
        s1, s2 = pdf["s1"].to_numpy(), pdf["s2"].to_numpy()
        tied = np.flatnonzero(root != np.arange(len(sets)))
        r = root[tied]
        held.append(np.stack([s1[tied], s2[tied], s1[r], s2[r]], axis=1))
        if sum(map(len, held)) >= PIECE_ROWS:
            yield pd.DataFrame(np.concatenate(held), columns=["s1", "s2", "r1", "r2"])
            held = []
    if held:
        yield pd.DataFrame(np.concatenate(held), columns=["s1", "s2", "r1", "r2"])


def linked_classes(docs: DataFrame, known: DataFrame, text_col: str, id_col: str, block_shingles: int) -> DataFrame:
    """c (class), root for every class that links with another one; a class is the pair s1, s2 as text."""
    groups = connected_components(candidate_ties(docs, known, text_col), "ngram-candidates").select(
        F.col("node").alias("s1"), F.col("root").alias("grp"))
    classes = known.where("n_shingles > 0").groupBy("s1", "s2").agg(
        F.min("id").alias("rep"), F.max("n_shingles").alias("n"))
    members = classes.join(groups, "s1")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")
    members = written(members.withColumn("band", band), "ngram-members")
    totals = members.groupBy("grp").agg(F.sum("n").alias("total"))
    by_band = members.groupBy("grp", "band").agg(F.sum("n").alias("band_total"))
    blocks = by_band.join(totals.where(F.col("total") > block_shingles), "grp").select(
        "grp", "band", F.ceil(F.col("band_total") / (block_shingles / 2)).cast("int").alias("blocks"))
    above = blocks.select("grp", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = blocks.select("grp", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    split = blocks.join(above, ["grp", "band"], "left").join(below, ["grp", "band"], "left").na.fill(0, ["above", "below"])
    placed = members.join(split, ["grp", "band"], "left").withColumn(
        "block", F.pmod(F.xxhash64("s1", F.lit("block")), F.coalesce("blocks", F.lit(1))).cast("int"))

    def places(n, lower, upper, side):
        """For the blocks 0 to n - 1 of a band: the block pair, and the side that this row's block takes in it."""
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda j: n > 0), lambda j: (
            F.concat_ws(":", F.col("grp").cast("string"), *[c.cast("string") for c in [*lower(j), *upper(j)]],
                        F.lit(str(side)))))

    band, mine = F.col("band"), lambda j: [F.col("band"), F.col("block")]
    # inside a band the lower block searches the higher one; a block is searched against itself from one side
    low = F.slice(places(F.col("blocks"), mine, lambda j: [band, j], 0), F.col("block") + 1, F.col("blocks"))
    high = F.slice(places(F.col("blocks"), lambda j: [band, j], mine, 1), F.lit(1), F.col("block"))
    up = places(F.col("above"), mine, lambda j: [band + 1, j], 0)
    down = places(F.col("below"), lambda j: [band - 1, j], mine, 1)
    alone = F.array(F.concat_ws(":", F.col("grp").cast("string"), F.lit("0")))
    keyed = placed.withColumn("to", F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(low, high, up, down)))
    wanted = written(keyed.select("rep", "s1", "s2", "to"), "ngram-wanted")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def load(it):
        for pdf in pieces(it):
            found = list(_sets(pdf))
            ids = np.array([_identity(s) for s in found], dtype=np.int64).reshape(-1, 2)
            same = (ids[:, 0] == pdf["s1"].to_numpy()) & (ids[:, 1] == pdf["s2"].to_numpy())  # ids may repeat
            out = pdf.loc[same, ["s1", "s2", "to"]].copy()
            out["shingles"] = [s.tobytes() for s, ok in zip(found, same) if ok]
            yield out

    # only texts that may be wanted are shuffled
    texts = texts.where(may_hold(wanted.select(F.xxhash64("rep").alias("h")), F.xxhash64("id")))
    joined = texts.join(wanted, texts["id"].eqNullSafe(wanted["rep"])).select("text", "s1", "s2", "to")
    loaded = joined.mapInPandas(load, "s1 bigint, s2 bigint, to array<string>, shingles binary")
    spread = loaded.select("s1", "s2", "shingles", F.explode("to").alias("t")).select(
        F.expr("left(t, length(t) - 2)").alias("key"), F.expr("cast(right(t, 1) as int)").alias("side"),
        "s1", "s2", "shingles")
    searched = spread.repartition("key").sortWithinPartitions("key").mapInPandas(
        _search, "s1 bigint, s2 bigint, r1 bigint, r2 bigint")
    ties = searched.select(_name("s1", "s2").alias("u"), _name("r1", "r2").alias("v"))
    return connected_components(ties, "ngram-links").select(F.col("node").alias("c"), "root")


def _name(a: str, b: str):
    return F.concat_ws(":", F.col(a), F.col(b))


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_shingles: int = 2_000_000) -> DataFrame:
    """id, th (hash of text), n_shingles, component (name of the group, null without words), component_id for
    every row."""
    known = written(document_sets(docs, id_col, text_col), "ngram-sets")
    linked = linked_classes(docs, known, text_col, id_col, block_shingles)
    alone = F.col("n_shingles") == 0
    named = known.withColumn("c", _name("s1", "s2")).join(linked, "c", "left")
    named = named.withColumn("component", F.coalesce("root", "c"))
    # the class comes before its documents: a partial minimum for each class, then for each component
    least = named.where(~alone).groupBy("component").agg(F.min("id").alias("component_id"))
    full = named.where(~alone).join(least, "component").select(
        "id", "th", "n_shingles", "component", "component_id")
    return full.unionByName(known.where(alone).select(
        "id", "th", "n_shingles", F.lit(None).cast("string").alias("component"), F.col("id").alias("component_id")))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each group of linked texts the one with the
    smallest id (null last, then the smallest text hash), once. Rows without words stay."""
    groups = ngram_groups(docs, id_col, text_col).where("component is not null")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    first = groups.groupBy("component").agg(F.min(rank).alias("r")).select(
        F.col("r.id").alias("kept_id"), F.col("r.th").alias("kept_th"))
    worded = F.coalesce(F.regexp_like(F.col(text_col), F.lit(WORD_RE)), F.lit(False))
    th = F.xxhash64(docs[text_col])
    kept = docs.where(worded).join(first, docs[id_col].eqNullSafe(first["kept_id"]) & (th == first["kept_th"]), "left_semi")
    return kept.dropDuplicates([id_col, text_col]).unionByName(docs.where(~worded))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
         ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
