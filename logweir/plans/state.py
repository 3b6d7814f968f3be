"""Aggregates kept per load, so that a run reads what has landed since the last one.

A load of entries leaves its facts (``operators.facts``), the minutes of its failed logins and
HTTP errors by IP, and their instants. All of these merge: a report over the whole table is
made from the aggregates of all loads, and no entry is read twice. Facts are
summed; minutes that several loads share are reduced again from their instants, which lie by
day and are read for the days of such minutes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators import correlation
from logweir.operators.facts import all_facts, merged_facts
from logweir.plans.report import Report
from logweir.plans.shared import read_table
from logweir.plans.store import read_entries

_FACTS = (
    "hour timestamp_ntz, source string, ip string, path string, status int, method string, user_agent string, "
    "total bigint, level_errors bigint, warnings bigint, any_errors bigint, ssh_failures bigint, http_failures bigint, "
    "scan_hits bigint, bans bigint, first_time timestamp_ntz, last_time timestamp_ntz, load string, facts string"
)
_INSTANTS = "ip string, at bigint, ssh_count bigint, http_count bigint, day date, load string"
_MINUTES = (
    "ip string, minute bigint, ssh_count bigint, http_count bigint, ssh_first bigint, ssh_last bigint, "
    "http_first bigint, http_last bigint, gap bigint, load string"
)


_DAY = 86_400_000_000


def _day(at: str) -> Column:
    """The day of an instant, whatever the session's zone: instants are wall-clock times."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(at) / _DAY).cast("int"))


def _replaced(df: DataFrame, path: str, *by: str) -> None:
    """Write the folders of one load; those of others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def add_load(spark: SparkSession, table: str, state: str, load: str) -> None:
    """Keep the aggregates of one load of the table; to do it again replaces them."""
    entries = read_entries(spark, table, load)
    named = F.lit(load)
    _replaced(all_facts(entries).withColumn("load", named), f"{state}/facts", "load", "facts")
    counted = correlation.instants(entries).select("*", _day("at").alias("day"), named.alias("load"))
    _replaced(counted, f"{state}/instants", "day", "load")
    own = _instants(spark, state).where(F.col("load") == load).drop("load", "day")
    _replaced(correlation.minutes_of(own).withColumn("load", named), f"{state}/minutes", "load")


def _instants(spark: SparkSession, state: str) -> DataFrame:
    return read_table(spark, f"{state}/instants", _INSTANTS)


def facts(spark: SparkSession, state: str) -> DataFrame:
    """The facts of all loads, as ``all_facts`` gives them for all entries."""
    return merged_facts(read_table(spark, f"{state}/facts", _FACTS).drop("load"))


def gaps(spark: SparkSession, state: str) -> DataFrame:
    """The closest gaps per IP over all loads."""
    minutes = read_table(spark, f"{state}/minutes", _MINUTES).drop("load")
    shared = minutes.groupBy("ip", "minute").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # One row for each day: only their folders are read.
    wanted = [r["day"] for r in shared.select(_day("minute").alias("day")).distinct().collect()]
    counted = _instants(spark, state).where(F.col("day").isin(wanted)).drop("load", "day")
    return correlation.gaps_of(correlation.merged_minutes(minutes, counted))


def report(spark: SparkSession, state: str, **options) -> Report:
    """The report over all loads, from their aggregates alone."""
    return Report(facts=facts(spark, state), gaps=gaps(spark, state), **options)
