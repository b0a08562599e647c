"""All queries over the tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def load() -> None:
    """Imports every module that registers queries."""
    from meridia.plans import formulas, markets, relational, research  # noqa: F401
