"""The registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import importlib

#: Query name -> module that holds a function of that name.
MODULES = {
    "op1_embeddings": "embeddings",
    "op2_sentencepiece": "pieces",
    "op3_quality_rules": "quality_rules",
    "op4_language": "language",
    "op5_simhash": "simhash",
    "op6_mixing": "mixing",
    "op7_suffix_dedup": "suffix_dedup",
    "op8_quality_classifier": "quality_classifier",
    "op9_language_model": "language_model",
    "op10_token_counts": "token_counts",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
