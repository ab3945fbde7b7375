"""The registered queries: operators bound to tables, each with the same statement in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.jobs import citations, lifecycles, paragraphs, records, rendering, sources, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (citations, texts, records, rendering, sources, paragraphs, lifecycles):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
