"""The queries that apply each corpus operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_simhash_near_dedup": "op1_simhash",
    "op2_cover_tree_near_dedup": "op2_cover_tree",
    "op3_hypergeometric_shards": "op3_shards",
    "op4_one_bit_search": "op4_one_bit_search",
    "op5_html_crf": "op5_html_crf",
    "op6_license_scan": "op6_licenses",
    "op7_mix_sources": "op7_mix",
    "op8_context_mixing_lm": "op8_mixing_lm",
    "op9_best_fit_packing": "op9_packing",
    "op10_toxicity": "op10_toxicity",
    "op11_language_id": "op11_language_id",
    "op12_collocations": "op12_collocations",
    "op13_hard_negatives": "op13_hard_negatives",
}


def queries() -> dict:
    return {name: import_module(f"acrelens.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"acrelens.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
