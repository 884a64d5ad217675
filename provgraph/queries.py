"""Registered queries of the engine, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import analytics, claims, graph, resolution, retrieval, security, sources, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (graph, text, claims, resolution, analytics, retrieval, security, sources):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
