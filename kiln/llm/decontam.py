"""Benchmark decontamination by spaced seeds.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Fixed
masks look at two runs of 3 words, 3, 6, 9, 12 or 15 words apart, and ignore the
words between, so changed words there do not hide a copied passage. Every place of every
text is hashed under every mask. A Bloom filter of the benchmark's hashes, of a
fixed number of bits however large the benchmark is, is sent to the tasks;
places that pass it (nearly only true hits) leave the scan with the words
around them and are joined to the benchmark's hashes. Each (document, item,
diagonal) is then verified: word by word along the diagonal, some segment must
have at least 80 % equal words and at least 13 of them, or 80 % of a shorter
item's words. The best segment (+1 a match, -2 a change) is reported if it does,
else the one with most equal words among those of 80 %.

Items of 13 words or more are found if the copy agrees with them under one mask
somewhere. 15 words hold five runs of 3, of which three changes leave two, a
multiple of 3 words apart: every pattern of changes that the 80 % allow in 13 to
19 words is found, whichever words they fall on, and, by trying them all, so is
every one in 20 to 22 words (recall 1 at each length). A longer overlap is found
where a stretch of 15 words of it has three changes at most.

Items of 5 to 12 words are sought under masks that each leave out some blocks of
the item, so that as many changes as the 80 % allow, one or two, hide no copy,
also where it sticks out of the text; shorter items cannot identify a leak and
match nothing.

Defined results. Null and empty texts have no words and match nothing. Rows
that repeat (id and text) are each reported. Items that repeat are each reported.
A null doc_id is reported as null, an item without an id is not sought. Empty
tables give no rows. Further columns, whatever their names, are not looked at by
`find_leaks` and come out of `drop_leaks` as they are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.bloom import bloom_filter, passes
from kiln.llm.common import hash128, table, written
from kiln.llm.tokens import PUNCTUATED, WordHasher, pieces, windows

SPAN = 13
RUN = 3  # words of each of the two runs that a mask compares
APART = (3, 6, 9, 12, 15)
SHORTEST = 5
PAD = 64


def short_masks(n: int) -> list[tuple[int, ...]]:
    """The places to compare of an item of n words, under SPAN: all but the blocks that n // 5 changes can fall into."""
    changes = n // 5
    count = 5 if n == 5 else 2 + changes  # four words at least are compared
    blocks = np.array_split(np.arange(n), count)
    return [tuple(int(p) for k, b in enumerate(blocks) if k not in out for p in b)
            for out in combinations(range(count), changes)]


def _seeds(words: np.ndarray, short: range | tuple):
    """(places, hashes) under all masks, and under those of items of the lengths in ``short``."""
    places, hashes = [], []
    run = windows(words, tuple(range(RUN)))
    for apart in APART:
        h = windows(run, (0, apart), apart)
        places.append(np.arange(len(h)))
        hashes.append(h)
    for n in short:
        for h, at in _short_seeds(words, n):
            places.append(at)
            hashes.append(h)
    return np.concatenate(places), np.concatenate(hashes)


def _short_seeds(words: np.ndarray, n: int):
    """(hashes, places) under each mask for items of n words; a place is where the item would begin, maybe before the text."""
    for k, mask in enumerate(short_masks(n)):
        h = windows(words, tuple(p - mask[0] for p in mask), 100 + 16 * n + k)
        yield h, np.arange(len(h)) - mask[0]


def _texts(pdf: pd.DataFrame):
    hasher = WordHasher(PUNCTUATED, lower=False)
    return hasher.words(t.lower() if isinstance(t, str) else None for t in pdf["text"])


def benchmark_seeds(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, words) and (item, place, h) of the benchmark, written."""
    base = items.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).alias("text"))

    def words(it):
        for pdf in it:
            yield pd.DataFrame({"item": pdf["item"].astype("Int64"), "words": [w.view(np.int64) for w in _texts(pdf)]})

    def seeds(it):
        for pdf in it:
            for item, w in zip(pdf["item"], pdf["words"]):
                w = np.asarray(w, dtype=np.int64).view(np.uint64)
                if len(w) >= SHORTEST:
                    if len(w) >= SPAN:
                        places, h = _seeds(w, ())
                    else:  # of each mask the place where the item begins
                        h = np.array([x[at == 0][0] for x, at in _short_seeds(w, len(w))], dtype=np.uint64)
                        places = np.zeros(len(h), int)
                    yield pd.DataFrame({"item": item, "place": places, "h": h.view(np.int64)})

    known = written(base.where("item is not null").mapInPandas(words, "item bigint, words array<bigint>"), "bench-words")
    return known, written(known.mapInPandas(seeds, "item bigint, place int, h bigint"), "bench-seeds")


def best_segment(equal: np.ndarray) -> tuple[int, int]:
    """(start, end) of the segment with the highest score, +1 a match and -2 a change."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.argmin(total[:end + 1])), end


def widest_segment(equal: np.ndarray) -> tuple[int, int]:
    """(start, end) of the segment with the most matches among those with 80 % matches."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    rest = np.maximum.accumulate(total[::-1])  # ascending: the highest of the last sums
    end = len(equal) - np.searchsorted(rest, total)  # the last place with no lower sum
    count = np.concatenate([[0], np.cumsum(equal)])
    s = int(np.argmax(count[end] - count))
    at = s + np.flatnonzero(equal[s:end[s]])
    return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)


def verified_segment(equal: np.ndarray, least: int) -> tuple[int, int, bool]:
    """The segment to report, and whether it has ``least`` matches and 80 %."""
    for pick in (best_segment, widest_segment):
        s, e = pick(equal)
        same = int(equal[s:e].sum())
        if same >= least and 5 * same >= 4 * (e - s):
            return s, e, True
    return s, e, False


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", log_bits: int = 26) -> DataFrame:
    """k1, k2 (hashes of the row's id and text), id, item, start, n_words, n_equal: the longest verified overlap
    of each document and benchmark item."""
    spark = docs.sparkSession
    known, seeds = benchmark_seeds(items, item_col, item_text_col)
    sent = spark.sparkContext.broadcast(bloom_filter(seeds, log_bits))
    lengths = known.select(F.size("words").alias("n")).where(f"n >= {SHORTEST} and n < {SPAN}").distinct().collect()
    short = tuple(sorted(r["n"] for r in lengths))  # at most SPAN - SHORTEST numbers
    k1, k2 = hash128(id_col, text_col)
    base = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).cast("string").alias("id"),
                       F.col(text_col).alias("text"))

    def scan(it):
        for pdf in pieces(it):
            out = []
            for k, w in enumerate(_texts(pdf)):
                places, h = _seeds(w, short)
                at = np.flatnonzero(passes(sent.value, h, log_bits))
                if not len(at):
                    continue
                at = at[np.argsort(places[at], kind="stable")]
                p, h = places[at], h[at]
                for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p) > PAD) + 1):
                    start = max(0, int(p[part[0]]) - PAD)
                    out.append((k, start, w[start:int(p[part[-1]]) + SPAN + PAD].view(np.int64),
                                p[part].astype(np.int32), h[part].view(np.int64)))
            if out:
                rows = pdf.iloc[[o[0] for o in out]]
                yield pd.DataFrame({"k1": rows["k1"].array, "k2": rows["k2"].array, "id": rows["id"].array,
                                    "start": [o[1] for o in out], "words": [o[2] for o in out],
                                    "places": [o[3] for o in out], "hashes": [o[4] for o in out]})

    id_type = dict(docs.dtypes)[id_col]
    found = written(base.mapInPandas(scan, "k1 bigint, k2 bigint, id string, start int, words array<bigint>, "
                                           "places array<int>, hashes array<bigint>")
                    .groupBy("k1", "k2", "start").agg(
                        *[F.first(c).alias(c) for c in ("id", "words", "places", "hashes")],
                        F.count(F.lit(1)).cast("int").alias("copies")), "leak-places")
    hits = found.select("k1", "k2", "start", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select(
        "k1", "k2", "start", F.col("x.places").alias("at"), F.col("x.hashes").alias("h"))
    pairs = hits.join(seeds, "h").select("k1", "k2", "start", "item", (F.col("at") - F.col("place")).alias("diagonal"))
    pairs = pairs.distinct()
    ready = pairs.join(found.select("k1", "k2", "start", "id", "words", "copies"), ["k1", "k2", "start"]).join(
        known.withColumnRenamed("words", "item_words"), "item")

    def verify(it):
        for pdf in it:
            out = []
            for start, words, item_words, diagonal in zip(pdf["start"], pdf["words"], pdf["item_words"], pdf["diagonal"]):
                a, b = np.asarray(words), np.asarray(item_words)
                lo = max(0, start - diagonal)  # item places that meet the words at hand
                hi = min(len(b), start + len(a) - diagonal)
                equal = a[lo + diagonal - start:hi + diagonal - start] == b[lo:hi]
                s, e, ok = verified_segment(equal, min(SPAN, -(-4 * len(b) // 5)))
                same = int(equal[s:e].sum())
                out.append((ok, lo + diagonal + s, e - s, same))
            got = pd.DataFrame(out, columns=["ok", "first", "n_words", "n_equal"], index=pdf.index)
            got = pd.concat([pdf[["k1", "k2", "id", "item", "copies"]], got], axis=1)
            yield got[got["ok"]].drop(columns="ok")

    verified = ready.select("k1", "k2", "id", "item", "copies", "start", "words", "item_words", "diagonal").mapInPandas(
        verify, "k1 bigint, k2 bigint, id string, item bigint, copies int, first int, n_words int, n_equal int")
    best = F.max(F.struct("n_equal", "n_words", (-F.col("first")).alias("back"))).alias("best")
    longest = verified.groupBy("k1", "k2", "id", "item").agg(best, F.max("copies").alias("copies"))
    each = longest.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return each.select(
        "k1", "k2", F.col("id").cast(id_type).alias("id"), "item", (-F.col("best.back")).alias("start"),
        F.col("best.n_words").alias("n_words"), F.col("best.n_equal").alias("n_equal"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark passage."""
    leaks = find_leaks(docs, items, id_col, text_col, **kw).select(
        F.col("k1").alias("leak_k1"), F.col("k2").alias("leak_k2")).distinct()
    k1, k2 = hash128(docs[id_col], docs[text_col])
    return docs.join(leaks, (k1 == leaks["leak_k1"]) & (k2 == leaks["leak_k2"]), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", "n_equal")
