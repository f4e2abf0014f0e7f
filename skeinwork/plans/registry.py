"""Registry of the engine's queries: name -> callable and name -> SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.plans import boxes, experiments, groups, quality, tracks

_MODULES = (quality, boxes, experiments, groups, tracks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, (_, text) in m.QUERIES.items() if text}
