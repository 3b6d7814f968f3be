"""Run history: a table of runs, and the findings of each run.

``<folder>/runs`` has a row per run with its figures and its report as JSON.
``<folder>/findings`` has all rows of all report lists, also those that are no part of
the report record. A run is written in two steps: the findings under its number, then its
row, which is the mark that it is whole. A run that was cut off between them has no row,
so its number is given again and its findings are replaced.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.plans.report import REPORT_DDL, ROWS_SCHEMA, Report
from logweir.plans.shared import read_table
from logweir.schema import RUN_SCHEMA

_FINDING_SCHEMA = f"{ROWS_SCHEMA}, run_id bigint"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/runs", RUN_SCHEMA)


def findings(spark: SparkSession, folder: str, run_id: int) -> DataFrame:
    """All rows of all lists of a whole run: (section, position, item as JSON text)."""
    found = read_table(spark, f"{folder}/findings", _FINDING_SCHEMA)
    whole = runs(spark, folder).select(F.col("id").alias("run_id"))
    return found.where(F.col("run_id") == run_id).join(whole, "run_id", "left_semi").drop("run_id")


def append_run(
    report: Report,
    folder: str,
    target: str,
    run_at: datetime | None = None,
    duration_ms: float = 0.0,
) -> int:
    """Add a run and return its number. One writer at a time: numbers count up.

    ``log_start`` is the first time in the log, or the time of the run if the
    log has none.
    """
    spark = report.spark
    last = runs(spark, folder).agg(F.max("id")).first()[0]
    run_id = (last or 0) + 1
    numbered = report.rows().withColumn("run_id", F.lit(run_id).cast("bigint"))
    # Only the folder of this number is replaced.
    writer = numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(f"{folder}/findings")
    _append_row(report, folder, target, run_id, run_at, duration_ms)
    return run_id


def _append_row(
    report: Report, folder: str, target: str, run_id: int, run_at: datetime | None, duration_ms: float
) -> None:
    now = F.lit((run_at or datetime.now()).isoformat()).cast("timestamp_ntz")
    row = report.document().select(F.to_json(F.struct("*")).alias("result_json"), "meta")
    values = {
        "id": F.lit(run_id),
        "target": F.lit(target),
        "run_at": now,
        "log_start": F.coalesce(F.col("meta.start_time").cast("timestamp_ntz"), now),
        "duration_ms": F.lit(duration_ms),
        "result_json": F.col("result_json"),
    }
    record = row.select(
        *(
            values.get(f.name, F.col(f"meta.{f.name}")).cast(f.dataType).alias(f.name)
            for f in RUN_SCHEMA
        )
    )
    record.coalesce(1).write.mode("append").parquet(f"{folder}/runs")


def latest_runs(spark: SparkSession, folder: str, limit: int = 10) -> DataFrame:
    """The newest runs first, without their reports."""
    return runs(spark, folder).drop("result_json").orderBy(F.desc("id")).limit(limit)


def run_result(spark: SparkSession, folder: str, run_id: int) -> DataFrame:
    """The report of one run as a nested record; no row for an unknown run."""
    wanted = runs(spark, folder).where(
        (F.col("id") == run_id) & F.col("result_json").isNotNull()
    )
    parsed = wanted.select(
        "id", "target", "log_start", F.from_json("result_json", REPORT_DDL).alias("result")
    )
    return parsed.select("id", "target", "log_start", "result.*")
