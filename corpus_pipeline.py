"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixture, shards.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``,
what the stage before it kept; its result is written as Parquet and read again.
All but the last return the columns of ``documents``.

Defined results. Null, empty, very long and repeated texts and null ids are
handled as the operators' docstrings say; an empty table passes through all
stages; further columns of ``docs`` are carried along, and one that is called
like a column of the last stage comes out with ``_in`` behind its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import decontam, mixing, ngram_join, quality, sharding
from kiln.llm.common import table, written
from kiln.session import ensure_conf


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score is 0.3 or more."""
    ensure_conf(spark)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(F.col("text"), model) >= 0.3)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ensure_conf(spark)
    return ngram_join.one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ensure_conf(spark)
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    ensure_conf(spark)
    return mixing.mixed(docs)


def sharding_by_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, shard and slot."""
    ensure_conf(spark)
    out = sharding.shard_by_bytes(docs, 24, extra=tuple(docs.columns))
    own = ["size", "text_crc32", "shard", "slot"]
    given = [F.col(f"`x_{c}`").alias(c + "_in" * (c in own)) for c in docs.columns]
    return out.select(*given, *own)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_weights", mixing_to_weights),
    ("sharding", sharding_by_bytes),
]

#: Learned scores, set joins and balanced draws have no SQL: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_conf(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
