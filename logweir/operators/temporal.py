"""Traffic over time: hours, weekdays, timeline and error spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions import predicates as P
from logweir.functions import times
from logweir.operators.facts import facts_by

# What makes an hour an error spike.
SPIKE_MULTIPLIER = 3.0
SPIKE_MIN_ENTRIES = 5
SPIKE_MIN_ERRORS = 3


def _per_hour(entries: DataFrame) -> DataFrame:
    return facts_by(entries.where(P.has_time()), "hour")


def hours_of_day(hours: DataFrame) -> DataFrame:
    """Counts per hour of the day (0-23) from facts per calendar hour."""
    return (
        hours.where(F.col("hour").isNotNull())
        .groupBy(times.hour(F.col("hour")).alias("hour"))
        .agg(F.sum("total").alias("count"))
    )


def weekdays_of(hours: DataFrame) -> DataFrame:
    return (
        hours.where(F.col("hour").isNotNull())
        .groupBy(times.weekday(F.col("hour")).alias("weekday"))
        .agg(F.sum("total").alias("count"))
    )


def by_hour(entries: DataFrame) -> DataFrame:
    """Entries per hour of the day, hours without any left out."""
    return (
        entries.where(P.has_time())
        .groupBy(times.hour(F.col("timestamp")).alias("hour"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("hour")
    )


def by_weekday(entries: DataFrame) -> DataFrame:
    # The day is cut first: a name is then formatted per day, not per entry.
    days = (
        entries.where(P.has_time())
        .groupBy(F.col("timestamp").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return (
        days.groupBy(times.weekday(F.col("day")).alias("weekday"))
        .agg(F.sum("count").alias("count"))
        .orderBy("weekday")
    )


def peaks(hour_counts: DataFrame, weekday_counts: DataFrame) -> DataFrame:
    """One row: the busiest hour and weekday; ties go to the first hour, the first name."""
    hour = hour_counts.agg(
        F.max_by("hour", F.struct(F.col("count"), -F.col("hour"))).alias("peak_hour")
    )
    day = weekday_counts.agg(
        F.min_by("weekday", F.struct(-F.col("count"), F.col("weekday"))).alias("peak_weekday")
    )
    return hour.select("peak_hour", day.scalar().alias("peak_weekday"))


def peak_times(entries: DataFrame) -> DataFrame:
    hours = _per_hour(entries)
    return peaks(hours_of_day(hours), weekdays_of(hours))


def hour_profile(hour_counts: DataFrame) -> DataFrame:
    """All 24 hours in order, with 0 where there is no entry."""
    day = hour_counts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    # At most 24 rows on the broadcast side.
    filled = day.join(F.broadcast(hour_counts), "hour", "left")
    return filled.select("hour", F.coalesce("count", F.lit(0)).alias("count")).orderBy("hour")


def weekday_profile(weekday_counts: DataFrame) -> DataFrame:
    """All seven days from Monday on, with 0 where there is no entry."""
    names = F.array(*map(F.lit, times.WEEKDAYS))
    week = weekday_counts.sparkSession.range(1).select(F.posexplode(names).alias("day", "weekday"))
    # At most seven rows on the broadcast side.
    filled = week.join(F.broadcast(weekday_counts), "weekday", "left")
    return filled.select(
        "day", "weekday", F.coalesce("count", F.lit(0)).alias("count")
    ).orderBy("day")


def timeline_of(hours: DataFrame) -> DataFrame:
    """From facts with one row per calendar hour, in no order."""
    return hours.where(F.col("hour").isNotNull()).select(
        times.hour_label(F.col("hour")).alias("time"),
        "total",
        F.col("level_errors").alias("errors"),
        "warnings",
    )


def timeline(entries: DataFrame) -> DataFrame:
    """Per calendar hour with entries: total, errors by level, warnings."""
    return timeline_of(_per_hour(entries)).orderBy("time")


def spikes(entries: DataFrame, **bounds) -> DataFrame:
    """Hours with far more errors (by level or status) than the average hour."""
    return spikes_of(_per_hour(entries), **bounds).orderBy(F.desc("errors"), "window")


def spikes_of(
    hours: DataFrame,
    multiplier: float = SPIKE_MULTIPLIER,
    min_entries: int = SPIKE_MIN_ENTRIES,
    min_errors: int = SPIKE_MIN_ERRORS,
) -> DataFrame:
    """Spikes from facts with one row per calendar hour, in no order.

    The average is over the hours that have entries. It is a scalar subquery on
    the same hourly aggregate, which is thereby computed once.
    """
    # The number of hours, counted by `total`, which is at least 1: so the subquery
    # takes the same measures as the outer query, and both share one shuffle.
    count = F.sum(F.signum("total"))
    average = hours.agg((F.sum("any_errors") / count).alias("average")).scalar()
    errors, total = F.col("any_errors"), F.col("total")
    hot = (total >= min_entries) & (errors > average * multiplier) & (errors >= min_errors)
    return (
        hours.where((average > 0) & hot)
        .select(
            times.hour_label(F.col("hour")).alias("window"),
            errors.alias("errors"),
            "total",
            F.round(errors / total * 100, 1).alias("error_rate"),
            F.round(errors / average, 1).alias("vs_average"),
        )
    )
