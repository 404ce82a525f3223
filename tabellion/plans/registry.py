"""Collects the queries and oracles of the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabellion.plans.binding import Estate
from tabellion.plans.oracle import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def oracles() -> dict[str, str]:
    """The oracle of every query that has one, as complete SQL."""
    return {name: with_tables(sql) for name, sql in _ORACLES.items()}


def register(name: str, build: Callable[[Estate], DataFrame], oracle: str | None = None) -> None:
    """Adds a query over the bound estate; ``oracle`` may use the shared table expressions."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = lambda spark, folder: build(Estate(spark, folder))
    if oracle is not None:
        _ORACLES[name] = oracle


def query(name: str, oracle: str | None = None):
    """Decorator form of ``register``."""

    def add(build: Callable[[Estate], DataFrame]) -> Callable[[Estate], DataFrame]:
        register(name, build, oracle)
        return build

    return add
