"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: query name -> module that defines a function of that name, and perhaps ORACLE_SQL
OPERATORS = {
    "op1_byte_bpe": "byte_bpe",
    "op2_near_dedup": "near_dedup",
    "op3_sharding": "sharding",
    "op4_toxicity": "toxicity",
    "op5_language_id": "language_id",
    "op6_html_extract": "html_extract",
    "op7_fingerprints": "fingerprints",
    "op8_chat_format": "chat_format",
    "op9_packing": "packing",
    "op10_quality_rules": "quality_rules",
    "op11_simhash": "simhash",
    "op12_spelling": "spelling",
    "op13_whitening": "whitening",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in OPERATORS.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}
