"""Bloom filters of a fixed size: two bits for each 64-bit hash, whatever the number of hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 32_768


def bloom_filter(hashes: DataFrame, log_bits: int = 26) -> np.ndarray:
    """Filter of column ``h``, as 2 ** log_bits / 8 bytes: bounded by the parameter, built in Spark's bitmaps."""
    high = F.shiftrightunsigned(F.col("h"), 64 - log_bits)
    low = F.col("h").bitwiseAND(F.lit((1 << log_bits) - 1))
    bit = hashes.select(F.explode(F.array(high, low)).alias("bit")).select((F.col("bit") + 1).alias("bit"))
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((1 << log_bits) // 8, dtype=np.uint8)
    for r in parts.collect():
        at = (r["bucket"] - 1) * BUCKET // 8
        got = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)[:len(out) - at]
        out[at:at + len(got)] = got
    return out


def passes(table: np.ndarray, h: np.ndarray, log_bits: int) -> np.ndarray:
    """Which hashes (uint64) the filter may hold: none of its own is refused."""
    a, b = (h >> np.uint64(64 - log_bits)).astype(np.int64), (h & np.uint64((1 << log_bits) - 1)).astype(np.int64)
    return (table[a >> 3] >> (a & 7).astype(np.uint8)) & (table[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1


def may_hold(hashes: DataFrame, h: Column, log_bits: int = 26) -> Column:
    """Condition that keeps every row whose ``h`` is among ``hashes`` (column h), and few others."""
    sent = hashes.sparkSession.sparkContext.broadcast(bloom_filter(hashes, log_bits))

    @F.pandas_udf("boolean")
    def check(x: pd.Series) -> pd.Series:
        return pd.Series(passes(sent.value, x.to_numpy(dtype=np.int64).view(np.uint64), log_bits))

    return check(h)
