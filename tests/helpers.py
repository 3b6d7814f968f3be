"""Shorthands of the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.schema import ENTRY_SCHEMA, PARSED
from logweir.sources.lines import lines_of
from logweir.sources.registry import entries_of, line_format


def tagged(spark: SparkSession, fmt: str, lines: list[str], config=None, **options):
    rows = spark.createDataFrame(list(enumerate(lines)), "n bigint, value string")
    parse = line_format(fmt, config, **options)
    return {r["mid"]: r for r in parse(lines_of(rows, order="n")).collect()}


def parse(spark: SparkSession, fmt: str, lines: list[str], config=None, **options):
    """Entry of each line by its position; None for a dropped line."""
    rows = tagged(spark, fmt, lines, config, **options)
    return [rows[i] if i in rows and rows[i][PARSED] else None for i in range(len(lines))]


def entries(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Entries from dicts; what a dict leaves out takes its default."""
    defaults = {f.name: None for f in ENTRY_SCHEMA}
    defaults.update(source="nginx", raw="", level="INFO", message="", extra={}, file="f", block_start=0)
    full = [{**defaults, "mid": i, **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in ENTRY_SCHEMA) for r in full], ENTRY_SCHEMA)


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


__all__ = ["F", "entries", "entries_of", "parse", "rows", "tagged"]
