"""The stages against what they must keep, and the whole run on the smallest tables."""

from collections import Counter

import corpus_pipeline
from kiln.llm import quality
from kiln.llm.ngram_join import ngram_groups
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    (_, classify), (_, join), (_, leaks), (_, mix), (_, shard) = corpus_pipeline.STAGES

    kept = classify(spark, docs, SF).cache()
    model = quality.fit_quality(docs, labels)
    want = [r["doc_id"] for r in docs.where(quality.quality_score(F.col("text"), model) >= 0.3).collect()]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and kept.columns == columns

    one = join(spark, kept, SF).cache()
    groups = ngram_groups(kept).collect()
    assert one.count() == len({r["component"] for r in groups if r["component"]}) + sum(not r["component"] for r in groups)
    assert one.columns == columns

    clean = leaks(spark, one, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    gone = set(texts) - {r["doc_id"] for r in clean.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    quoted = {i for i, t in texts.items() if any(q in (t or "") for q in items)}
    assert quoted <= gone and len(gone) <= len(quoted) + 1 and clean.columns == columns

    mixture = mix(spark, clean, SF).cache()
    counts = Counter(r["doc_id"] for r in mixture.collect())
    assert max(counts.values()) <= 3 and mixture.columns == columns

    out = shard(spark, mixture, SF)
    rows = out.collect()
    assert set(columns) < set(out.columns) and Counter(r["doc_id"] for r in rows) == counts
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_run_and_empty(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 3 * 200
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
