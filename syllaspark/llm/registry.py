"""The queries of this subpackage and their SQL, as __spark_entry__ adds them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, jaccard_join, language_id, packing, quality, substring_dedup, token_counts, url_filter, warc_audit

_MODULES = {
    "op1_merkle_audit": warc_audit,
    "op2_jaccard_join": jaccard_join,
    "op3_substring_dedup": substring_dedup,
    "op4_quality_gam": quality,
    "op5_language_id": language_id,
    "op6_url_trie": url_filter,
    "op7_best_fit_packing": packing,
    "op8_token_counts": token_counts,
    "op9_decontaminate": decontaminate,
    "op10_exact_dedup": exact_dedup,
}


def queries():
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql():
    return {name: m.SQL for name, m in _MODULES.items() if m.SQL}
