"""Exact Levenshtein distance over code points, bit-parallel.

Preferred path: the JVM functions of ``kiln/jvm`` (same algorithm in Java,
64-bit words, no Python round trip), registered per session by
``kiln.functions.jvm``. The Python kernels below are the fallback when the
jar cannot be loaded.

Spark's built-in ``levenshtein`` is the plain O(n*m) dynamic programme (a
threshold only stops it early, it does not band it). For whole documents
(tens of thousands of characters) that dominates a metrics job, so long pairs
use the bit-vector algorithm (Myers 1999, in Hyyro's Levenshtein form):
O(n * m / w) word operations, here with Python integers as the bit vectors
inside an Arrow-batched pandas UDF. Short pairs stay on the JVM built-in.
Both are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kiln.functions import jvm

# pairs with len(a) * len(b) above this go to the bit-parallel path
LONG_PAIR_CELLS = 250_000


def levenshtein_bits(a: str, b: str) -> int:
    """Exact code-point Levenshtein distance, bit-parallel with Python integers
    as bit vectors (the fallback kernel)."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if m == 0:
        return len(b)
    # one bit mask per distinct pattern character, built with numpy
    cps = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32)
    peq = {}
    for cp in np.unique(cps):
        bits = np.packbits(cps == cp, bitorder="little")
        peq[chr(int(cp))] = int.from_bytes(bits.tobytes(), "little")
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    get = peq.get
    for ch in b:
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return score


def _encode(xs, ys) -> tuple[str, str]:
    """Tokens of a pair -> one private code point per distinct token."""
    codes: dict = {}
    a = "".join(chr(0x10000 + codes.setdefault(t, len(codes))) for t in xs)
    b = "".join(chr(0x10000 + codes.setdefault(t, len(codes))) for t in ys)
    return a, b


def token_levenshtein(xs, ys) -> int:
    """Levenshtein distance over two token sequences."""
    if not xs or not ys:
        return max(len(xs), len(ys))
    return levenshtein_bits(*_encode(xs, ys))


def _series_udf(fn):
    @F.pandas_udf(LongType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), dtype=np.int64)
        null = np.zeros(len(a), dtype=bool)
        for i, (x, y) in enumerate(zip(a, b)):
            if x is None or y is None:
                null[i] = True
            else:
                out[i] = fn(x, y)
        res = pd.Series(out)
        return res.astype("Int64").mask(null) if null.any() else res
    return run


_lev_udf = _series_udf(levenshtein_bits)
# word-level distance: Python's str.split() (Unicode whitespace runs) per side
_word_udf = _series_udf(lambda x, y: token_levenshtein(x.split(), y.split()))
# token arrays (e.g. HTML tags) arrive from Arrow as numpy object arrays
_tok_udf = _series_udf(lambda x, y: token_levenshtein(list(x), list(y)))


def edit_distance(a, b, method: str = "auto") -> Column:
    """Exact code-point Levenshtein distance.

    ``jvm``: the built-in. ``bits``: the bit-parallel UDF for every row.
    ``auto``: built-in for short pairs, bit-parallel beyond ``LONG_PAIR_CELLS``
    (the UDF only sees the long pairs' text; short ones pass null)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    if method == "jvm":
        return F.levenshtein(a, b)
    if method == "bits":
        return _lev_udf(a, b)
    if jvm.available():
        return F.call_function("kiln_levenshtein", a, b)
    long_pair = F.char_length(a).cast("bigint") * F.char_length(b).cast("bigint") > LONG_PAIR_CELLS
    return F.coalesce(F.when(~long_pair, F.levenshtein(a, b)),
                      _lev_udf(F.when(long_pair, a), F.when(long_pair, b)))


def word_edit_distance(a, b) -> Column:
    """T05 building block: Levenshtein over whitespace-split words."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    if jvm.available():
        return F.call_function("kiln_word_levenshtein", a, b)
    return _word_udf(a, b)


def token_edit_distance(xs, ys) -> Column:
    """Levenshtein over token arrays (``array<string>`` columns)."""
    xs = F.col(xs) if isinstance(xs, str) else xs
    ys = F.col(ys) if isinstance(ys, str) else ys
    if jvm.available():
        return F.call_function("kiln_token_levenshtein", xs, ys)
    return _tok_udf(xs, ys)


@F.pandas_udf(StructType([StructField("dist", LongType()), StructField("wdist", LongType())]))
def _pair_udf(a: pd.Series, b: pd.Series, long_pair: pd.Series) -> pd.DataFrame:
    """Character distance (long pairs only; short ones are left null for the
    JVM built-in) and word distance of each pair, one Python pass per batch."""
    d = np.zeros(len(a), dtype=np.int64)
    w = np.zeros(len(a), dtype=np.int64)
    dn = np.ones(len(a), dtype=bool)
    wn = np.zeros(len(a), dtype=bool)
    for i, (x, y, lp) in enumerate(zip(a, b, long_pair)):
        if x is None or y is None:
            wn[i] = True
            continue
        if lp:
            d[i] = levenshtein_bits(x, y)
            dn[i] = False
        w[i] = token_levenshtein(x.split(), y.split())
    return pd.DataFrame({"dist": pd.Series(d).astype("Int64").mask(dn),
                         "wdist": pd.Series(w).astype("Int64").mask(wn)})


def pair_edit_distances(a, b) -> Column:
    """``struct<dist, wdist>``: exact character and word Levenshtein of a pair
    in one Arrow pass (character distance via the JVM built-in for short
    pairs, the bit-parallel kernel for long ones)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    if jvm.available():
        return F.struct(F.call_function("kiln_levenshtein", a, b).alias("dist"),
                        F.call_function("kiln_word_levenshtein", a, b).alias("wdist"))
    long_pair = F.char_length(a).cast("bigint") * F.char_length(b).cast("bigint") > LONG_PAIR_CELLS
    r = _pair_udf(a, b, long_pair)
    return F.struct(F.coalesce(F.when(~long_pair, F.levenshtein(a, b)), r["dist"]).alias("dist"),
                    r["wdist"].alias("wdist"))
