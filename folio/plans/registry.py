"""Registered queries of the region, pair and job operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.plans import batch_queries, box_queries, enrich_queries, job_queries, source_queries, stream_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (text_queries, batch_queries, job_queries, box_queries, source_queries, stream_queries, enrich_queries)


def queries() -> dict[str, Query]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
