"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.annotation_queries import ANNOTATION_QUERIES
from corpusloom.plans.flow_queries import FLOW_QUERIES
from corpusloom.plans.graph_queries import GRAPH_QUERIES, lexical_rank
from corpusloom.plans.payload_queries import PAYLOAD_QUERIES
from corpusloom.plans.report_queries import REPORT_QUERIES
from corpusloom.plans.rollup_queries import ROLLUP_QUERIES
from corpusloom.plans.scan_queries import SCAN_QUERIES
from corpusloom.plans.statute_queries import STATUTE_QUERIES
from corpusloom.plans.text_queries import TEXT_QUERIES
from corpusloom.plans.workflow_queries import WORKFLOW_QUERIES

ALL = TEXT_QUERIES | REPORT_QUERIES | GRAPH_QUERIES | WORKFLOW_QUERIES | ANNOTATION_QUERIES | STATUTE_QUERIES | PAYLOAD_QUERIES | ROLLUP_QUERIES | FLOW_QUERIES | SCAN_QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
