import random

from kiln.llm.graph import connected_components


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1200)]
    edges += [(2000, k) for k in range(2001, 2300)] + [(5, 5)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            break
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in connected_components(df, "test").collect()}
    assert got == {k: v for k, v in label.items() if k != 5 or 5 in got}
    assert connected_components(df.limit(0), "test").count() == 0
