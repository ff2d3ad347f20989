"""Every query of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_answers, queries_catalog, queries_files, queries_index, queries_requests, queries_rows, queries_search, queries_streams, queries_tables, queries_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (queries_search, queries_index, queries_text, queries_catalog, queries_requests, queries_files, queries_tables, queries_streams, queries_answers, queries_rows):
    for _name, (_query, _sql) in _module.QUERIES.items():
        QUERIES[_name] = _query
        if _sql:
            SQL[_name] = _sql
