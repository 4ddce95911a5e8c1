"""Registered queries: a Spark callable and, where SQL can state it, its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldglass.catalog.tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = function
        if sql is not None:
            _ORACLE[name] = sql
        return function

    return add


def _bound(function):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(Tables(spark, folder))

    return run


def queries():
    return {name: _bound(function) for name, function in _QUERIES.items()}


def oracle_sql():
    return dict(_ORACLE)
