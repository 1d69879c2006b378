"""The divergence audit against a plain version, with one cell and with many."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kiln.llm import divergence
from kiln.llm.divergence import Shares, ranked_audit, term_counts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, min_docs, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms_of(text))
        docs[lang].update(set(terms_of(text)))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            near = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(near)]
            tell = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(tell[:top])]
    return sorted(out)


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    for clash in ("term", "n", "docs", "block", "place", "side", "p", "a.b"):
        df = df.withColumn(clash, F.lit(clash))
    return df.repartition(5)


def made(seed=1, n_sources=23):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "Émile", "naïve", "x1y", "中文", "ﬀ", "İ", "ſ", "a_b", "Z{z}"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(400):
        source = f"s{rng.randrange(n_sources)}" if i % 3 else "hot"
        text = " ".join(rng.choices(words[:3 + rng.randrange(len(words))], k=rng.randrange(30)))
        rows.append((rng.choice(["en", "fr", None]), source, text))
    rows += [("en", None, "the of"), (None, None, None), ("en", "empty", ""), ("en", "none", "qqq"), ("xx", "alone", "only one"),
             ("yy", "é", ""), ("yy", "z", None), ("yy", "Z", "1 2 3")]
    return rows + rows[:50]


@pytest.mark.parametrize("group_block,term_block", [(256, 2048), (4, 20)])
def test_brute_force(spark, group_block, term_block):
    rows = made()
    got = ranked_audit(Shares(docs_of(spark, rows), min_docs=12, term_block=term_block), 7, group_block).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == brute(rows, 12, 7)


def test_long_texts_and_small_pieces(spark, monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choices(["alpha", "Beta", "gamma-delta", "é" * 40, "w" * 500], k=60_000)) + " " + "u" * 3_000_000
    got = {r.term: (r.n, r.docs) for r in term_counts(docs_of(spark, [("en", "a", text), ("en", "a", "alpha alpha")])).collect()}
    want = Counter(terms_of(text)) + Counter(["alpha"] * 2)
    assert {t: n for t, (n, _) in got.items() if t} == dict(want)
    assert got["alpha"][1] == 2 and got["beta"][1] == 1 and got["u" * 3_000_000] == (1, 1)
    lists = list(divergence._term_lists(b"ab cd " * 400_000))
    assert len(lists) > 1 and sum(map(len, lists)) == 800_000


def test_empty(spark):
    assert ranked_audit(Shares(docs_of(spark, []).coalesce(1))).count() == 0
    assert ranked_audit(Shares(docs_of(spark, [(None, None, None)]))).count() == 0


def test_partial_counts_are_flushed():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["a", "b", "a", "b"], "text": ["x y", "y z", "x", ""]})
    rows = [r for b in divergence._counted([batch]) for r in b.to_pylist()]
    held, divergence.HELD = divergence.HELD, 1
    try:
        flushed = [r for b in divergence._counted([batch]) for r in b.to_pylist()]
    finally:
        divergence.HELD = held
    assert len(flushed) > len(rows)

    def total(rs):
        c = Counter()
        for r in rs:
            c[r["source"], r["term"], "n"] += r["n"]
            c[r["source"], r["term"], "docs"] += r["docs"]
        return {k: v for k, v in c.items() if v}
    assert total(rows) == total(flushed)
