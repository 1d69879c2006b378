import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with an extra column that clashes with inner names."""
    def make(rows, schema="doc_id bigint, text string, source string"):
        rows = [(*r, None) if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(rows, schema)
        for name in ("id", "h1", "th", "size", "shard", "k1", "component", "copies"):
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit(name))
        return df
    return make
