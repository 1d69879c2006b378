"""The subpackage's queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from kiln.llm import chat_format, decontam, divergence, embed_dedup, html_extract, line_dedup, mixing, ngram_join, quality,\
    sharding, substring_dedup, vector_codes, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality": quality.op2_quality,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_embed_dedup": embed_dedup.op7_embed_dedup,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_sharding": sharding.op9_sharding,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_divergence": divergence.op11_divergence,
    "op12_warc": warc.op12_warc,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLE_SQL = {
    "op5_line_dedup": line_dedup.SQL,
    "op8_ngram_join": ngram_join.SQL,
    "op10_chat_format": chat_format.SQL,
    "op11_divergence": divergence.SQL,
    "op12_warc": warc.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
