"""Registered queries: each has a Spark form and, where SQL can say it, a SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import joins

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Collects queries with their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents, spread over the cores if they come as one small file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *columns)
    return joins.spread(docs, "doc_id")


def full_catalog() -> Catalog:
    from textloom.catalog import cleaning, files, mixing, ordering, scans, tokens

    out = Catalog()
    for module in (scans, cleaning, ordering, tokens, mixing, files):
        out.queries.update(module.catalog.queries)
        out.sql.update(module.catalog.sql)
    return out
