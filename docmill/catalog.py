"""Every named query of the engine with its SQL twin, gathered from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("corpus", "relational", "parsing", "records", "resolving", "walking", "checking", "landing")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= importlib.import_module(f"docmill.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(f"docmill.plans.{name}").ORACLE_SQL
    return found
