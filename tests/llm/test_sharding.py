import zlib
from itertools import combinations

from kiln.llm.sharding import greedy_cuts, shard_by_bytes, smallest_capacity


def brute_capacity(sizes, shards):
    """Smallest largest shard over all contiguous partitions."""
    best = sum(sizes)
    for k in range(shards):
        for cut in combinations(range(1, len(sizes)), k):
            edges = [0, *cut, len(sizes)]
            best = min(best, max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])))
    return best


def test_smallest_capacity_is_minimax():
    for sizes in ([3, 1, 4, 1, 5, 9, 2, 6], [7], [1] * 9, [2, 2, 2, 3, 3, 8, 1]):
        for shards in (1, 2, 3, 4):
            cap = max(smallest_capacity(sizes, shards), max(sizes))
            assert cap == brute_capacity(sizes, shards)
            assert len(greedy_cuts(sizes, cap)) <= shards


def test_groups_slots_and_sizes(spark, docs_of):
    rows = [(i, f"text {i % 97} " + "é" * (i % 13)) for i in range(3000)]
    rows += [(5000 + i, "the same text") for i in range(1500)] + [(None, None), (7, None), (7, "a"), (7, "a"), (9, "")]
    out = [r.asDict() for r in shard_by_bytes(docs_of(rows), 24).collect()]
    assert len(out) == len(rows) and all(0 <= r["shard"] < 24 for r in out)
    by_text, by_shard = {}, {}
    texts = {}
    for i, t in rows:
        texts.setdefault((i, None if t is None else zlib.crc32(t.encode())), t)
    for r in out:
        t = texts[r["id"], r["text_crc32"]]
        assert r["size"] == len((t or "").encode()) + 8
        by_text.setdefault(t, set()).add(r["shard"])
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    again = [r.asDict() for r in shard_by_bytes(docs_of(rows).repartition(7), 24).collect()]
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_empty_and_extra(docs_of):
    assert shard_by_bytes(docs_of([])).count() == 0
    got = shard_by_bytes(docs_of([(1, "a", "s")]), 3, extra=("source", "size")).collect()
    assert [tuple(got[0])[k] for k in (3, 4, 5, 6)] == [0, 0, "s", "size"]


def test_any_column_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6), (2, "b", 7, 8)], "doc_id long, text string, `a.b` int, size_in int")
    got = shard_by_bytes(docs, 3, extra=("a.b", "size_in", "doc_id"))
    assert got.columns == ["id", "size", "text_crc32", "shard", "slot", "x_a.b", "x_size_in", "x_doc_id"]
    assert sorted((r["x_doc_id"], r["x_a.b"], r["x_size_in"]) for r in got.collect()) == [(1, 5, 6), (2, 7, 8)]


def test_very_long_text(spark, docs_of):
    rows = [(1, "long " * 400_000), (2, "b"), (3, None)]
    got = {r["id"]: r for r in shard_by_bytes(docs_of(rows), 3).collect()}
    assert got[1]["size"] == 2_000_008 and got[1]["slot"] == 0
    assert got[1]["text_crc32"] == zlib.crc32(rows[0][1].encode())
