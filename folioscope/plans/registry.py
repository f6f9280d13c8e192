"""All queries of the document engine and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import element_queries, text_queries, validation_queries

_PARTS = (element_queries, text_queries, validation_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the whole pipeline, one row per document."""
    return element_queries.QUERIES["pipeline_document"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for part in _PARTS for k, f in part.SQL.items()}
