"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows are grouped by the hash of their text and the groups ordered by it; the
65,536 ranges of the top 16 hash bits are the atoms, so equal texts never part.
One aggregate gives size and row count of each atom: at most 65,536 numbers,
whatever the table's size, which the driver may hold. A binary search finds the
smallest capacity at which a greedy walk over the atoms needs no more shards
than there are (an atom above the capacity stands alone, so that one huge group
of copies does not stretch the others), and the walk cuts there.

Slots are gapless in each shard without sorting a shard in one task: rows are
numbered inside cells (an atom, or a hash part of an atom that holds more than
1/16,384 of the rows), and the offsets of the at most 81,920 cells are added.

Defined results. Null text: size 8, no checksum, one group of its own; empty
text: size 8. Repeated rows stay together and get slots of their own; null ids
are ordered first. An empty table gives no rows. Columns of any name may be
carried along as ``extra``; they come out as ``x_`` and their name.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiln.llm.common import table

ATOM_BITS = 16
CELLS = 16_384


def greedy_cuts(sizes: list[int], capacity: int) -> list[int]:
    """Ends of the shards that a greedy walk fills up to ``capacity``."""
    prefix = [0, *accumulate(sizes)]
    cuts, at = [], 0
    while at < len(sizes):
        at = max(at + 1, bisect_right(prefix, prefix[at] + capacity) - 1)
        cuts.append(at)
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search of the smallest capacity that ``shards`` shards can meet."""
    lo, hi = 0, sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if len(greedy_cuts(sizes, mid)) <= shards:
            hi = mid
        else:
            lo = mid + 1
    return lo


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = 8, extra: tuple[str, ...] = ()) -> DataFrame:
    """id, size, text_crc32, shard, slot (and the columns named in ``extra``, prefixed ``x_``) of every row."""
    spark = docs.sparkSession
    text = F.col(text_col)
    h = F.xxhash64(text)
    keyed = docs.select(
        F.col(id_col).alias("id"), h.alias("h"),
        F.shiftrightunsigned(h, 64 - ATOM_BITS).cast("int").alias("atom"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + overhead).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("bigint").alias("text_crc32"),
        *[F.col(f"`{c}`").alias(f"x_{c}") for c in extra])
    atoms = sorted(tuple(r) for r in keyed.groupBy("atom").agg(F.sum("size"), F.count(F.lit(1))).collect())
    rows = sum(a[2] for a in atoms)
    sizes = [a[1] for a in atoms]
    cuts = greedy_cuts(sizes, smallest_capacity(sizes, shards)) if atoms else []
    limit = max(1, rows // CELLS)
    plan = [(a, bisect_right(cuts, i), -(-n // limit)) for i, (a, _, n) in enumerate(atoms)]
    plan_df = spark.createDataFrame(plan, "atom int, shard int, parts int").coalesce(1)
    placed = keyed.join(F.broadcast(plan_df), "atom").withColumn(
        "part", F.pmod(F.xxhash64("id", F.lit("cell")), F.col("parts")).cast("int"))
    cells: list[tuple[int, int, int]] = []
    counts = {(a, 0): n for (a, _, n), (_, _, parts) in zip(atoms, plan) if parts == 1}
    if len(counts) < len(atoms):
        split = placed.where(F.col("parts") > 1).groupBy("atom", "part").count()
        counts |= {(r[0], r[1]): r[2] for r in split.collect()}
    shard_of, filled = {a: s for a, s, _ in plan}, [0] * (len(cuts) + 1)
    for (a, p), n in sorted(counts.items()):
        cells.append((a, p, filled[shard_of[a]]))
        filled[shard_of[a]] += n
    cell_df = spark.createDataFrame(cells, "atom int, part int, before bigint").coalesce(1)
    w = Window.partitionBy("atom", "part").orderBy("h", "id", "size")
    return placed.join(F.broadcast(cell_df), ["atom", "part"]).select(
        "id", "size", "text_crc32", "shard",
        (F.col("before") + F.row_number().over(w) - 1).cast("bigint").alias("slot"),
        *[F.col(f"`x_{c}`") for c in extra])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
