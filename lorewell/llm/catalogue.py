"""Queries of the training-data operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import bpe, collocations, decontamination, jaccard_join, lexical_search, ordinal_quality, pii, quality_rules, sharding, substring_dedup, token_files, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_query,
    "op2_substring_dedup": substring_dedup.op2_query,
    "op3_ordinal_quality": ordinal_quality.op3_query,
    "op4_decontamination": decontamination.op4_query,
    "op5_quality_rules": quality_rules.op5_query,
    "op6_jaccard_join": jaccard_join.op6_query,
    "op7_bpe": bpe.op7_query,
    "op8_sharding": sharding.op8_query,
    "op9_url_filter": url_filter.op9_query,
    "op10_token_files": token_files.op10_query,
    "op11_lexical_search": lexical_search.op11_query,
    "op12_pii": pii.op12_query,
    "op13_collocations": collocations.op13_query,
}
ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op6_jaccard_join": jaccard_join.OP6_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op12_pii": pii.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
