"""Names of the queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) function under a name, with its SQL if it has any."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def load() -> None:
    """Registers all queries."""
    from importlib import import_module

    for name in ("insight_queries", "search_queries", "graph_queries", "state_queries", "more_queries", "retrieve_queries", "classify_queries", "review_queries", "code_queries", "record_queries", "report_queries"):
        import_module(f"tessella.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language: the share of each in rows and characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
