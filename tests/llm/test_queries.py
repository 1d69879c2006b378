"""Every registered query of the subpackage on the smallest tables; those with SQL against it."""

import pytest

from kiln.llm import registry
from kiln.session import ensure_conf
from oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    ensure_conf(spark)
    r = compare(registry.QUERIES[name](spark, SF), duck(SF), registry.ORACLE_SQL[name])
    assert r["cols_match"] and r["hash_match"], r


COLUMNS = {
    "op1_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op2_quality": {"doc_id", "held_out", "score", "predicted"},
    "op4_html_extract": {"page_id", "url", "text", "n_chars"},
    "op7_embed_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op9_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}
ROWS = {"op4_html_extract": 50, "op7_embed_dedup": 500}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(df.columns)
    assert df.count() == ROWS.get(name, 200)
