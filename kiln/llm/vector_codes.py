"""Vector codes: product quantisation in integers, with a trie over the distinct parts.

Components become integers ``floor(scale * x)`` and a vector is cut into equal consecutive parts. The distinct
parts, each with the number of vectors that hold it, are range-partitioned in lexicographic order and written once:
a part that a third of all vectors share is one row, however often it occurs. Each round a task walks the trie of
its parts depth first. A node stands for the first components of all parts below it and holds one accumulated
squared distance to every codebook entry; its children add one component each, so what parts have in common is
computed once. A leaf takes the nearest entry and adds its part, weighted, to that entry's sums. Tasks return a row
per part position and entry, so the driver receives ``parts * entries`` rows a round, and the codebooks sent with
the next round's tasks are as small (``parts * entries * width`` integers).

Frontiers of up to ``FRONTIER`` sibling nodes are expanded together in numpy; the walk stays depth first, so at most
one frontier a level is held. Distances are exact: in 64-bit floats while every sum stays below 2**53, in Python's
integers beyond. Sums of entries are Python integers throughout.

Defined results. Vectors that are null or hold a null or non-finite component get no row. Vectors shorter than the
longest (or whose length is no multiple of the number of parts) are taken as filled up with zeros. Equal ids: the
first entries are ordered by id, then by vector; null ids come last. Fewer vectors than entries: the codebook has as
many entries as there are vectors. Entries that no part takes stay. Distances tie to the lower entry. An empty table
gives no rows. Only the named columns are read, under names of their own, so others may have any name. An error or
sum of errors beyond 2**63 - 1 is given as that.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import table, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
FRONTIER = 512
MOST = 2 ** 63 - 1
_WHOLE = 2.0 ** 43  # doubles from here on are whole multiples of 1 / SCALE


@dataclass(frozen=True)
class Codebooks:
    """``books[part][entry][position]``, integers; ``width`` components a part; ``largest``: of any component."""

    books: list
    width: int
    largest: int

    def sha256(self) -> str:
        """Of all components in decimal, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for e in b for x in e).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The vector of integers that a code stands for."""
        return [x for p, b in enumerate(self.books) for x in b[int(code[2 * p:2 * p + 2], 16)]]


def grid_vectors(df: DataFrame, vec_col: str, **names: str | Column) -> DataFrame:
    """Rows whose vector is whole and finite: the named columns, and ``grid``, the components rounded down to
    multiples of 1 / SCALE, as doubles (exact, whatever their size)."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    down = F.transform(x, lambda v: F.when(F.abs(v) < _WHOLE, F.floor(v * SCALE).cast("double") / SCALE).otherwise(v))
    return df.where(x.isNotNull() & finite).select(
        *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in names.items()], down.alias("grid"))


def _integers(grid: np.ndarray, exact_floats: bool) -> np.ndarray:
    """The integers that grid values stand for: as floats where these are exact, else Python's own."""
    if exact_floats:
        return grid * SCALE
    out = np.empty(grid.shape, dtype=object)
    out.ravel()[:] = [int(v) * SCALE if abs(v) >= _WHOLE else int(v * SCALE) for v in grid.ravel().tolist()]
    return out


def _filled(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` doubles from lists, filled up with zeros."""
    out = np.zeros((len(lists), width))
    out[np.arange(width) < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` (sorted, so that equal beginnings are neighbours): the index of the nearest row of
    ``book``, the lower one of equals, and the squared distance. Walks the trie of the rows depth first."""
    n, width = parts.shape
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=parts.dtype)
    differs = parts[1:] != parts[:-1]
    opens = np.zeros(n, dtype=np.int64)  # the first component in which a row leaves the one before it
    opens[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width) if width else width
    leaf_of = np.cumsum(np.concatenate([[True], opens[1:] < width])) - 1
    entry = np.zeros(leaf_of[-1] + 1, dtype=np.int64)
    error = np.zeros(leaf_of[-1] + 1, dtype=parts.dtype)
    # depth, first rows of the nodes, row after the last node, parents' distances, each node's parent
    stack = [(0, np.zeros(1, dtype=np.int64), n, np.zeros((1, len(book)), dtype=parts.dtype), np.zeros(1, dtype=np.int64))]
    while stack:
        depth, first, end, above, parent = stack.pop()
        if depth:
            step = parts[first, depth - 1][:, None] - book[:, depth - 1][None, :]
            step *= step
            step += above[parent]
        else:
            step = above
        if depth == width:
            at = leaf_of[first]
            entry[at] = best = step.argmin(axis=1)
            error[at] = step[np.arange(len(first)), best]
            continue
        begins = opens[first[0]:end] <= depth
        begins[first - first[0]] = True
        child = np.flatnonzero(begins) + first[0]
        parent = np.searchsorted(first, child, side="right") - 1
        for a in range((len(child) - 1) // FRONTIER * FRONTIER, -1, -FRONTIER):  # the last pushed is walked first
            b = a + FRONTIER
            stack.append((depth + 1, child[a:b], int(child[b]) if b < len(child) else end, step, parent[a:b]))
    return entry[leaf_of], error[leaf_of]


def _arrays(books: Codebooks, exact_floats: bool) -> list[np.ndarray]:
    return [np.array(b, dtype=np.float64 if exact_floats else object).reshape(len(b), books.width) for b in books.books]


def _exact_floats(books: Codebooks) -> bool:
    return books.width * (2 * books.largest + 2) ** 2 < 2 ** 53


def distinct_parts(vectors: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """part (position), grid (its components), copies (vectors that hold it), in lexicographic order."""
    filled = F.concat("grid", F.array_repeat(F.lit(0.0), F.lit(width * parts) - F.size("grid")))
    cut = F.array(*[F.struct(F.lit(p).alias("part"), F.slice(filled, p * width + 1, width).alias("grid"))
                    for p in range(parts)])
    counted = vectors.select(F.inline(cut)).groupBy("part", "grid").agg(F.count(F.lit(1)).alias("copies"))
    return written(counted.repartitionByRange("part", "grid").sortWithinPartitions("part", "grid"), "code-parts")


def _entry_sums(books: Codebooks):
    """Batches of distinct parts -> for each position and entry: sums of components and count, as decimal text."""
    exact = _exact_floats(books)

    def run(batches):
        arrays = _arrays(books, exact)
        sums: dict = {}
        for batch in batches:
            part = batch.column("part").to_numpy()
            grid, all_copies = _filled(batch.column("grid"), books.width), batch.column("copies").to_numpy()
            for p in np.unique(part):
                whole, copies = _integers(grid[part == p], exact), all_copies[part == p]
                entry, _ = nearest_entries(whole, arrays[p])
                small = exact and (books.largest + 1) * int(copies.sum()) < 2 ** 62
                weight = copies.astype(np.int64 if small else object)
                values = whole.astype(np.int64) if small else np.array([[int(v) for v in r] for r in whole], dtype=object)
                order = np.argsort(entry, kind="stable")
                starts = np.flatnonzero(np.diff(entry[order], prepend=-1))
                values = np.add.reduceat((values * weight[:, None])[order], starts, axis=0) if books.width else values[:len(starts)]
                for e, s, c in zip(entry[order][starts], values, np.add.reduceat(weight[order], starts)):
                    held = sums.setdefault((int(p), int(e)), [[0] * books.width, 0])
                    held[0] = [a + int(b) for a, b in zip(held[0], s)]
                    held[1] += int(c)
        yield _sum_rows(sums)

    return run


def _sum_rows(sums: dict) -> pa.RecordBatch:
    rows = [(p, e, ",".join(map(str, s)), str(n)) for (p, e), (s, n) in sums.items()]
    kinds = {"part": pa.int32(), "entry": pa.int32(), "sums": pa.string(), "n": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())],
                                      names=list(kinds))


def _added(batches):
    """Sums of equal positions and entries, added up: at most ``parts * entries`` are held."""
    sums: dict = {}
    for batch in batches:
        for p, e, s, n in zip(*(c.to_pylist() for c in batch.columns)):
            values = [int(x) for x in s.split(",")] if s else []
            held = sums.setdefault((p, e), [[0] * len(values), 0])
            held[0] = [a + b for a, b in zip(held[0], values)]
            held[1] += int(n)
    yield _sum_rows(sums)


_SUMS = "part int, entry int, sums string, n string"


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the rows of ``vectors`` (id, grid). The driver receives ``entries`` vectors to begin with and
    ``parts * entries`` sums a round."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: an index is two hex digits")
    longest, largest = vectors.agg(F.max(F.size("grid")), F.max(F.array_max(F.transform("grid", F.abs)))).first()
    if longest is None:
        return Codebooks([[] for _ in range(parts)], 0, 0)
    width = -(-longest // parts)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "grid").limit(entries).collect()
    whole = _integers(_filled(pa.array([r["grid"] for r in first], pa.list_(pa.float64())), width * parts), False)
    largest = int(_integers(np.array([largest or 0.0]), False)[0]) + 1
    books = Codebooks([[list(v[p * width:(p + 1) * width]) for v in whole] for p in range(parts)], width, largest)
    distinct = distinct_parts(vectors, width, parts)
    for _ in range(rounds):
        sums = (distinct.mapInArrow(_entry_sums(books), _SUMS).repartition("part", "entry").mapInArrow(_added, _SUMS))
        new = [list(b) for b in books.books]
        for r in sums.collect():
            n = int(r["n"])
            new[r["part"]][r["entry"]] = [int(x) // n for x in r["sums"].split(",")] if r["sums"] else []
        books = Codebooks(new, width, largest)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vectors`` with ``code`` (two hex digits a part) and ``error`` (squared distance over all parts) instead of
    ``grid``. Each batch walks the trie of its own distinct parts."""
    exact = _exact_floats(books)
    width, n_parts = books.width, len(books.books)

    def run(batches):
        arrays = _arrays(books, exact)
        for batch in batches:
            grid = _filled(batch.column(batch.schema.get_field_index("grid")), width * n_parts)
            code = np.full(len(grid), "", dtype=object)
            error = np.zeros(len(grid), dtype=object)
            for p in range(n_parts):
                cut = grid[:, p * width:(p + 1) * width]
                order = np.lexsort(cut.T[::-1]) if width else np.arange(len(cut))
                entry, off = nearest_entries(_integers(cut[order], exact), arrays[p])
                back = np.empty(len(order), dtype=np.int64)
                back[order] = np.arange(len(order))
                code += np.array([f"{e:02x}" for e in entry], dtype=object)[back]
                error += np.array([int(x) for x in off], dtype=object)[back]
            rest = batch.select([c for c in batch.schema.names if c != "grid"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(code, pa.string()), pa.array([min(x, MOST) for x in error], pa.int64())],
                names=[*rest.schema.names, "code", "error"])

    kept = [f for f in vectors.schema.fields if f.name != "grid"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", code string, error bigint"
    return vectors.mapInArrow(run, schema)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = grid_vectors(table(spark, sf_dir, "embeddings"), "embedding", id="vec_id", label="label")
    books = fit_codebooks(vectors)
    codes = written(encode(vectors, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    labels = written(codes.groupBy("label").agg(total.alias("label_error")), "code-labels")
    other = labels.select(F.col("label").alias("same"), "label_error")
    return codes.join(other, F.col("label").eqNullSafe(F.col("same"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    part = f"q[g.p * (len(q) // {PARTS}) + 1 : (g.p + 1) * (len(q) // {PARTS})]"
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, g.p AS part, {part} AS c FROM v, (SELECT unnest(range({PARTS})) AS p) g),
b0 AS MATERIALIZED (
  SELECT part, e AS entry, c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p)
  WHERE e < {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, any_value(c) AS c, min(d) AS d, arg_min(entry, d * {ENTRIES} + entry) AS entry FROM (
    SELECT p.vec_id, p.part, p.c, b.entry,
           list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM p JOIN b{r} b ON p.part = b.part) GROUP BY vec_id, part)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS (
  SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM (
    SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM a{r}) GROUP BY part, entry, pos),
n{r} AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM s{r} GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN n{r} n ON b.part = n.part AND b.entry = n.entry)""")
    last = ROUNDS
    return f"""WITH {",".join(steps)},
h AS (
  SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM b{last}),
c AS (
  SELECT vec_id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{last} GROUP BY vec_id)
SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY v.label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN v ON c.vec_id = v.vec_id, h
"""


SQL = _sql()
