"""Embedding near-dedup by collision counting over one-dimensional projections.

Unit vectors are projected on fixed Gaussian directions. Two vectors of cosine
``threshold`` differ in a projection by a normal variable of known deviation, so
a window of half-width r around a query's value holds the other one with a
known probability. The projections are dealt into lists of d; two vectors meet
in a list if each lies in the other's window in all d. Vectors are sorted into
wide cells of each list, and those close above a cell's lower edge go to the
cell below as well, so that every pair that meets shares a cell. In a cell, the
pairs that meet have their collisions over all projections counted; pairs with
the calibrated count are verified by the cosine in double precision. d grows
with the logarithm of the number of vectors, r and the number of lists follow
from d: the recall at the threshold stays above 0.98, cells stay small.

A pair is counted once, in the first list where it meets and the lowest cell it
shares there: tasks return a count of links and one tie per vector, never
pairs. Cells are searched in blocks of 2,048 rows, pair by pair of blocks, so a
cell with a third of all vectors is spread over many tasks. Equal vectors are
one from the start and weigh as many as they are.

Defined results. Null, empty and zero vectors and those with null or non-finite
components link with nothing; so do vectors of different lengths. Components are
kept as given, floats or doubles (other numbers as doubles). Rows that
repeat, or share a vec_id, are vectors of their own. Component names are the
smallest non-null vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import hash128, table, written
from kiln.llm.graph import connected_components
from kiln.llm.tokens import pieces, runs

BLOCK = 2_048
COUNTED = 32
MEET = 0.7  # chance of meeting in one list at the threshold
LISTS = 4
CELL_ROWS = 4_000


class Plan:
    """Directions, window, cell width and counts for ``n`` vectors of ``dim`` numbers."""

    def __init__(self, n: int, dim: int, threshold: float, seed: int = 11):
        normal, self.dim, self.threshold = NormalDist(), dim, threshold
        far = math.sqrt(2 - 2 * threshold)  # distance of unit vectors at the threshold
        self.d = 0
        while True:
            self.d += 1
            one = MEET ** (1 / self.d)
            self.r = far * normal.inv_cdf((1 + one) / 2)
            self.width = 4 * self.r
            shared = self.width / math.sqrt(4 * math.pi + self.width**2)  # about the chance to share a cell
            if n * shared**self.d <= CELL_ROWS or self.d == 24:
                break
        self.counted = max(COUNTED, self.d * LISTS)
        tail, self.least = 0.0, 0
        for k in range(self.counted + 1):  # the largest count that 99.5 % of pairs at the threshold reach
            tail += math.comb(self.counted, k) * one**k * (1 - one) ** (self.counted - k)
            if tail > 0.005:
                self.least = k
                break
        self.directions = np.random.default_rng(seed).normal(size=(dim, self.counted))

    def project(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.directions

    def list_of(self, k: int) -> slice:
        return slice(k * self.d, (k + 1) * self.d)


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(plan: Plan, p: np.ndarray):
    """(row, list, cell) of every cell that a row goes to: its own and the ones just below."""
    for k in range(LISTS):
        q = p[:, plan.list_of(k)]
        cell = np.floor(q / plan.width).astype(np.int64)
        near = q - cell * plan.width <= plan.r * (1 + 1e-9)
        rows, cells = np.arange(len(q)), cell
        for j in range(plan.d):
            low = cells[near[rows, j]].copy()
            low[:, j] -= 1
            rows, cells = np.concatenate([rows, rows[near[rows, j]]]), np.concatenate([cells, low])
        yield k, rows, cells


def _pairs(plan: Plan, k: int, cell: np.ndarray, a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, same: bool):
    """Linked (row of a, row of b) whose first list is k and whose lowest shared cell is this one."""
    top = (cell + 1) * plan.width
    sl = plan.list_of(k)
    qa, qb = pa[:, sl], pb[:, sl]
    for s in range(0, len(a), 256):
        meets = np.ones((min(256, len(a) - s), len(b)), dtype=bool)
        for j in range(plan.d):
            x, y = qa[s:s + 256, j, None], qb[None, :, j]
            meets &= np.abs(x - y) <= plan.r
            meets &= ~((x >= top[j]) & (y >= top[j]))  # else they share a higher cell
        i, o = np.nonzero(meets)
        i += s
        if same:
            i, o = i[o > i], o[o > i]
        for c in range(0, len(i), 100_000):
            u, v = i[c:c + 100_000], o[c:c + 100_000]
            hit = np.abs(pa[u] - pb[v]) <= plan.r
            keep = hit.sum(axis=1) >= plan.least
            for other in range(k):
                keep &= ~hit[:, plan.list_of(other)].all(axis=1)
            u, v = u[keep], v[keep]
            ok = np.einsum("ij,ij->i", a[u], b[v]) >= plan.threshold
            yield u[ok], v[ok]


def _groups(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest row of each row's group, by spreading minima along the links."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def link_counts(vectors: DataFrame, plan: Plan) -> DataFrame:
    """node, links (weighted count), tie from vectors (node, weight, e): a row per node and block pair at most."""
    def deal(it):
        for pdf in pieces(it):
            p = plan.project(_unit(pdf["e"]))
            for k, rows, cells in _cells(plan, p):
                names = [f"{k}:" + ",".join(map(str, c)) for c in cells.tolist()]
                got = pdf.iloc[rows].reset_index(drop=True)
                yield pd.DataFrame({"cell": names, "node": got["node"], "weight": got["weight"], "e": got["e"]})

    dealt = vectors.mapInPandas(
        deal, f"cell string, node string, weight bigint, e {vectors.schema['e'].dataType.simpleString()}")
    counts = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = dealt.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(F.col("block"), j).alias("lo"), F.greatest(F.col("block"), j).alias("hi")))
    spread = placed.withColumn("to", F.explode(to)).select(
        F.concat_ws("|", "cell", F.col("to.lo").cast("string"), F.col("to.hi").cast("string")).alias("key"),
        (F.col("block") == F.col("to.hi")).alias("upper"), (F.col("to.lo") == F.col("to.hi")).alias("same"),
        "node", "weight", "e")

    def search(it):
        for pdf in runs(it, ["key"]):
            if len(pdf) < 2:
                continue
            pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
            k, cell = pdf["key"].iloc[0].split("|")[0].split(":")
            k, cell = int(k), np.array([int(c) for c in cell.split(",")])
            x = _unit(pdf["e"])
            p = plan.project(x)
            same = bool(pdf["same"].iloc[0])
            side = np.zeros(len(x), dtype=bool) if same else pdf["upper"].to_numpy()
            left = np.flatnonzero(~side)
            right = left if same else np.flatnonzero(side)
            us, vs = [np.zeros(0, int)], [np.zeros(0, int)]
            weight, links = pdf["weight"].to_numpy(), np.zeros(len(x), dtype=np.int64)
            for u, v in _pairs(plan, k, cell, x[left], x[right], p[left], p[right], same):
                u, v = left[u], right[v]
                np.add.at(links, u, weight[v])
                np.add.at(links, v, weight[u])
                us.append(u)
                vs.append(v)
            label = _groups(len(x), np.concatenate(us), np.concatenate(vs))
            got = links > 0
            if got.any():
                node = pdf["node"].to_numpy()
                yield pd.DataFrame({"node": node[got], "links": links[got], "tie": node[label[got]]})

    return spread.repartition("key").sortWithinPartitions("key").mapInPandas(
        search, "node string, links bigint, tie string")


def near_duplicates(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = 0.95) -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    given = vecs.schema[vec_col].dataType.elementType.simpleString()
    e = F.col(vec_col).cast("array<float>" if given == "float" else "array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce((F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    h1, h2 = hash128(e)
    base = vecs.select(F.col(id_col).alias("id"), e.alias("e"), usable.alias("usable"),
                       F.concat_ws("-", F.hex(h1), F.hex(h2)).alias("node"))
    classes = written(base.where("usable").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.min("id").alias("least_id"), F.first("e").alias("e")), "embed-classes")
    found = None
    for r in classes.groupBy(F.size("e").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        one = classes.where(F.size("e") == r["dim"]).select("node", "weight", "e")
        part = link_counts(one, Plan(r["n"], r["dim"], threshold))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = written(found, "embed-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("tie").alias("v")), "embed")
    named = classes.select("node", "weight", "least_id").join(counts, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    good = base.where("usable").select("id", "node").join(named, "node").select("id", "n_links", "component_id")
    bad = base.where("not usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op7_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")
