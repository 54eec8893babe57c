"""All queries by name, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return queries()["pair_counts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def _load() -> None:
    # when asked, not on import: the modules of queries import this one
    from corvane.plans import bootstrap_queries, core_queries, cue_queries, dataset_queries, judge_queries, model_queries, protocol_queries, report_queries, review_queries, text_queries  # noqa: F401  fill the two tables

