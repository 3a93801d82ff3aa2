"""All registered queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import assembly_queries, retrieval_queries, stored_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval_queries.Q, **table_queries.Q, **assembly_queries.Q, **stored_queries.Q}
ORACLES: dict[str, str] = {**retrieval_queries.SQL, **table_queries.SQL, **assembly_queries.SQL, **stored_queries.SQL}
