"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import importlib

#: Query name to the module of this subpackage that defines ``query`` and perhaps ``ORACLE_SQL``.
MODULES = {
    "op1_ngram_join": "ngram_join",
    "op2_hilbert_ann": "hilbert_ann",
    "op3_quality_rules": "quality_rules",
    "op4_chat_tree": "chat",
    "op5_license_scan": "licenses",
    "op6_token_counts": "token_counts",
    "op7_bpe_tree": "bpe_tree",
    "op8_language_id": "langid",
    "op9_quality_classifier": "quality_classifier",
    "op10_packing": "packing",
    "op11_bloom_lm": "bloom_lm",
    "op12_merkle_manifest": "merkle",
    "op13_source_divergence": "divergence",
}


def queries() -> dict:
    return {name: importlib.import_module(f".{module}", __package__).query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
