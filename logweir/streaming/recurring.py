"""Recurring analysis: take in what has landed, analyse, record, alert.

One call is one run. When to call it is up to an outside scheduler.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.plans.history import append_run
from logweir.plans.state import report as report_of
from logweir.streaming.live import start_ingest


def run_alert(
    run: int | None, totals: DataFrame, anomalies: DataFrame, brute_force: DataFrame
) -> DataFrame:
    """One row to alert with if a run found any anomaly or brute force, else none."""

    def count(findings: DataFrame):
        return findings.agg(F.count(F.lit(1))).scalar()

    return totals.select(
        F.lit(run).cast("bigint").alias("run"),
        count(anomalies).alias("anomalies"),
        count(brute_force).alias("brute_force"),
        "errors",
        "total",
    ).where((F.col("anomalies") > 0) | (F.col("brute_force") > 0))


def recurring_run(
    spark: SparkSession,
    directory: str,
    fmt: str,
    table: str,
    checkpoint: str,
    history: str,
    config: Mapping | None = None,
    format_options: Mapping | None = None,
    source_options: Mapping[str, str] | None = None,
    state: str | None = None,
    **report_options,
) -> tuple[int | None, DataFrame]:
    """Ingest new files, report on the whole table, append the run.

    ``fmt`` is any format or ``auto``; ``source_options`` bound a batch of files. What the report needs is kept
    for each load in ``state`` (beside the table unless it is given), so a run reads the entries that
    are new and the aggregates of the others. Returns the run number and the alert
    rows (one or none). Without any entries there is nothing to report: no run is
    recorded, and its number is None.
    """
    kept = state or f"{table.rstrip('/')}-state"
    start_ingest(
        spark, directory, fmt, table, checkpoint, kept, config=config, format_options=format_options,
        source_options=source_options, availableNow=True,
    ).awaitTermination()
    report = report_of(spark, kept, **report_options)
    found = report.meta.first()["total"] > 0
    run = append_run(report, history, directory) if found else None
    return run, run_alert(run, report.meta, report.anomalies, report.brute_force)
