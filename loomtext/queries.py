"""All queries of the library by name, with the DuckDB SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import document_queries, phrase_queries, proofread_queries, search_queries, stream_queries, table_queries

MODULES = (search_queries, table_queries, document_queries, proofread_queries, phrase_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
