"""Every query over the reference tables, by name, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.plans import inputs, overview, profiles, programs, records, reviews, state, structure, surroundings, texts, versions

MODULES = [overview, state, versions, texts, structure, reviews, inputs, programs, surroundings, records, profiles]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
