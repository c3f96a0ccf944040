"""Queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from importlib import import_module

#: query name -> module, function, attribute with the SQL (or None: see tests/llm for the brute-force version)
TABLE = {
    "op1_license_scan": ("license_scan", "op1", "ORACLE"),
    "op2_ann_forest": ("ann_forest", "op2", None),
    "op3_jump_shard": ("jump_shard", "op3", "ORACLE"),
    "op4_language_id": ("language_id", "op4", None),
    "op5_html_mincut": ("html_mincut", "op5", None),
    "op6_source_mix": ("source_mix", "op6", "ORACLE"),
    "op7_token_counts": ("token_counts", "op7", None),
    "op8_decontaminate": ("decontaminate", "op8", "ORACLE"),
    "op9_ngram_jaccard": ("ngram_jaccard", "op9", None),
    "op10_quality_mil": ("quality_mil", "op10", None),
}


def queries():
    return {name: getattr(import_module(f"quarry.llm.{module}"), function) for name, (module, function, _) in TABLE.items()}


def oracle_sql():
    return {name: getattr(import_module(f"quarry.llm.{module}"), sql) for name, (module, _, sql) in TABLE.items() if sql}
