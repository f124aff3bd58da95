"""Collects the queries of the library's modules and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import answer_queries, comparison_queries, curation_queries, extra_queries, graph_queries, metric_queries, rank_queries, set_queries, tag_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES: tuple = (text_queries, tag_queries, rank_queries, metric_queries, set_queries, graph_queries, answer_queries, extra_queries, curation_queries, comparison_queries)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found.update(module.ORACLE_SQL)
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rk22_rank_pages"](spark, sf_dir)
