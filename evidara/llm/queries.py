"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

OPERATORS = {
    "op1_secret_scan": "secrets",
    "op2_decontamination": "decontamination",
    "op3_language_id": "language_id",
    "op4_knn_join": "knn_join",
    "op5_simhash_near_dedup": "simhash",
    "op6_suffix_dedup": "suffix_dedup",
    "op7_token_file": "huffman",
    "op8_substring_dedup": "substring_dedup",
    "op9_packing": "packing",
    "op10_chat_collapse": "chat",
    "op11_resampling": "resampling",
    "op12_token_alignment": "alignment",
    "op13_lm_scoring": "lm_scoring",
}


def queries() -> dict:
    return {name: importlib.import_module(f"evidara.llm.{module}").query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"evidara.llm.{module}"), "ORACLE_SQL", None) for name, module in OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}
