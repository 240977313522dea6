"""All queries on the driver's tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import analytics, corpus, readers, replies, samples, sequences

_PLANS = (corpus, analytics, readers, replies, sequences, samples)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
