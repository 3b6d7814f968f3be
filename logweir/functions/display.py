"""Derived labels and proportions that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severity(value: Column, high_above: float) -> Column:
    """HIGH above the bound, else MEDIUM."""
    return F.when(value > high_above, "HIGH").otherwise("MEDIUM")


def status_class(status: Column) -> Column:
    return (
        F.when(status >= 500, "Server Error")
        .when(status >= 400, "Client Error")
        .when(status >= 300, "Redirect")
        .otherwise("Success")
    )


def error_rate_band(rate: Column) -> Column:
    return F.when(rate > 10, "error").when(rate > 5, "warn").otherwise("ok")


def bar_share(rows: DataFrame, width: int, count: str = "count") -> Column:
    """Length of a bar scaled to the largest count of the rows."""
    largest = rows.agg(F.max(count)).scalar()
    return F.floor(F.col(count) / largest * width).cast("int")


def one_decimal(value: Column) -> Column:
    """Text of a number already rounded to one place."""
    return F.round(value, 1).cast("string")


def time_label(timestamp: Column) -> Column:
    return F.coalesce(F.substring(timestamp.cast("string"), 12, 8), F.lit("--:--:--"))
