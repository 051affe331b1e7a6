"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import extras, records, structure, texts, views

ALL = texts.QUERIES | records.QUERIES | structure.QUERIES | extras.QUERIES | views.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for name, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in ALL.items() if q[1]}
