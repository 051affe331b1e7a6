"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this package that holds it
HOMES = {
    "op1_quality_rules": "quality_rules",
    "op2_packing": "packing",
    "op3_imatch": "imatch",
    "op4_warc": "warc",
    "op5_byte_bpe": "byte_bpe",
    "op6_lm_score": "lm_score",
    "op7_secrets": "secrets",
    "op8_importance": "importance",
    "op9_near_dup": "near_dup",
    "op10_licenses": "licenses",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"textloom.llm.{home}"), name) for name, home in HOMES.items()}


def oracle_sql() -> dict[str, str]:
    return {}
