"""Totals, time span and sources of a set of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions import predicates as P
from logweir.operators.facts import facts_by


def overview(entries: DataFrame) -> DataFrame:
    """One row: total, errors and warnings by level, error rate in percent."""
    return overview_of(
        entries.agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(P.level_error()).alias("errors"),
            F.count_if(P.level_warning()).alias("warnings"),
        )
    )


def overview_of(totals: DataFrame) -> DataFrame:
    rate = F.round(F.col("errors") / F.col("total") * 100, 2)
    return totals.select(
        "*", F.when(F.col("total") > 0, rate).otherwise(F.lit(0.0)).alias("error_rate")
    )


def time_span(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time")
    )


def sources(entries: DataFrame) -> DataFrame:
    """Distinct sources with their entry counts, by name."""
    return entries.groupBy("source").agg(F.count(F.lit(1)).alias("total")).orderBy("source")


def source_list(entries: DataFrame) -> DataFrame:
    """One row with the sorted names of the sources. They are few: one per format."""
    return entries.agg(F.array_sort(F.collect_set("source")).alias("sources"))


def totals_of_hours(hours: DataFrame) -> DataFrame:
    """Overview, time span and sources in one row, from facts per hour and source."""
    totals = hours.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("level_errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
        F.min("first_time").alias("start_time"),
        F.max("last_time").alias("end_time"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    return overview_of(totals).select(
        "total", "errors", "warnings", "error_rate", "start_time", "end_time", "sources"
    )


def summary(entries: DataFrame) -> DataFrame:
    return totals_of_hours(facts_by(entries, "hour", "source"))
