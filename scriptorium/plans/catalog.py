"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunks, documents, records, search, vectors

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: run for module in (vectors, chunks, records, documents, search) for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in (vectors, chunks, records, documents, search) for name, (_, sql) in module.QUERIES.items() if sql}
