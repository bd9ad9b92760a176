"""The subpackage's queries and their SQL, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_licence_scans": "licences",
    "op2_best_fit_packing": "packing",
    "op3_token_counts": "token_counts",
    "op4_toxicity": "toxicity",
    "op5_quality_rules": "quality_rules",
    "op6_jaccard_join": "jaccard_join",
    "op7_secret_scans": "secrets",
    "op8_chat_formatting": "chat",
    "op9_decontamination": "decontaminate",
    "op10_suffix_dedup": "suffix_dedup",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f".{module}", __package__).query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
