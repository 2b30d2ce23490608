"""Named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafwork.operators import pii_run_tables
from sheafwork.plans import layout_plans, more_plans, pii_plans, run_plans, search_plans, spans_plans, table_plans
from sheafwork.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_run_tables.run_nodes(table(spark, sf_dir, "pii_run_raw"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_plans.span_summary(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, **spans_plans.QUERIES, **table_plans.QUERIES, **pii_plans.QUERIES, **search_plans.QUERIES, **layout_plans.QUERIES, **run_plans.QUERIES, **more_plans.QUERIES}
ORACLES: dict[str, str] = {**spans_plans.ORACLES, **table_plans.ORACLES, **pii_plans.ORACLES, **search_plans.ORACLES, **layout_plans.ORACLES, **run_plans.ORACLES, **more_plans.ORACLES}
