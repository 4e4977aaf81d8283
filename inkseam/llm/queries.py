"""Queries of the corpus operators over the driver's tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module; the module has a function of that name and, where SQL can say it, ORACLE.
QUERIES = {
    "op1_lm_scoring": "lm_scoring",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_toxicity": "toxicity",
    "op4_sentencepiece": "sentencepiece_merge",
    "op5_warc": "warc",
    "op6_quality_classifier": "weak_quality",
    "op7_url_filter": "url_filter",
    "op8_quality_rules": "quality_rules",
    "op9_minhash": "minhash",
    "op10_decontamination": "decontaminate",
}


def queries() -> dict:
    return {name: getattr(import_module(f"inkseam.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"inkseam.llm.{module}"), "ORACLE", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
