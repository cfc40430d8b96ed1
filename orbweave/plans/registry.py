"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.plans import detection_queries, domain_queries, relational_queries, report_queries, schedule_queries, source_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (relational_queries, detection_queries, schedule_queries, report_queries, domain_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items from events, dealt to the passes that follow them, sent first-in-first-out, summed by kind."""
    return QUERIES["nobuffer_day"](spark, sf_dir)
