"""The engine's registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import answering, curation, running

FLAGSHIP = "merge_support"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return curation.QUERIES | answering.QUERIES | running.QUERIES


def oracle_sql() -> dict[str, str]:
    return curation.ORACLE | answering.ORACLE | running.ORACLE
