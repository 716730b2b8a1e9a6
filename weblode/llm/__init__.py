"""Corpus operators for training data; nothing outside this package imports them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: One module per operator; each has QUERIES and ORACLE_SQL.
MODULES = ("toxicity", "bytespans", "decontaminate", "licences", "vectors", "simhash", "lines", "mixing", "sharding", "passages")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").ORACLE_SQL
    return found
