"""Small helpers the operators share: table access, written intermediates,
key columns that survive nulls, and the word pattern of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.session import scratch_path

# The white space of the contracts, and what words are made of.
ASCII_SPACE = " \t\n\u000b\u000c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: the lineage
    is cut at files that survive a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hash128(*cols) -> list[Column]:
    """Two 64-bit hashes of the same columns (differently seeded), as h1, h2."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *cols).alias("h2")]
