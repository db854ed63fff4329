"""Registered queries of the operators, and their DuckDB equivalents."""

from __future__ import annotations

from lookout.llm import (
    collocations, decontamination, language, lexical_search, mixing, oracle, phrases, pii, quality, secrets, simhash, site_quality, substrings, tokens,
)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op4_training_order": mixing.op4_training_order,
    "op5_language_id": language.op5_language_id,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_quality_classifier": site_quality.op7_quality_classifier,
    "op8_suffix_array_dedup": substrings.op8_suffix_array_dedup,
    "op9_benchmark_decontamination": decontamination.op9_benchmark_decontamination,
    "op10_token_counts": tokens.op10_token_counts,
    "op11_phrase_dedup": phrases.op11_phrase_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
SQL = oracle.SQL
