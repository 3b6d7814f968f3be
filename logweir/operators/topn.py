"""Rankings: the n most frequent values of a column.

Counting combines on the map side, so a value that holds a third of all rows
costs one row per task; the ranking keeps n rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions import predicates as P
from logweir.schema import ORDER_COLUMNS


def rank(counts: DataFrame, column: str, n: int, measure: str = "total") -> DataFrame:
    """The n largest of counted values; ties go by the value, ascending."""
    return (
        counts.where(P.has(column) & (F.col(measure) > 0))
        .select(column, F.col(measure).cast("bigint").alias("count"))
        .orderBy(F.desc("count"), F.asc(column))
        .limit(n)
    )


def top_values(entries: DataFrame, column: str, n: int = 10, ties: str = "key") -> DataFrame:
    """The n most frequent values of ``column``, absent ones left out.

    ``ties="key"`` orders equal counts by value, ``ties="first_seen"`` by where
    the value first stands in the input (this needs the line order columns).
    """
    groups = entries.where(P.has(column)).groupBy(column)
    if ties == "key":
        return rank(groups.agg(F.count(F.lit(1)).alias("total")), column, n)
    if ties != "first_seen":
        raise ValueError(f"Unknown ties '{ties}'. Available: key, first_seen")
    # First by split, where the place is a number and needs no sort; then over few rows.
    by_split = entries.where(P.has(column)).groupBy(column, "file", "block_start").agg(
        F.count(F.lit(1)).alias("count"), F.min("mid").alias("mid")
    )
    counted = by_split.groupBy(column).agg(
        F.sum("count").alias("count"), F.min(F.struct(*ORDER_COLUMNS)).alias("first_seen")
    )
    return counted.orderBy(F.desc("count"), "first_seen").limit(n).drop("first_seen")


def top_ips(entries: DataFrame, n: int = 10, ties: str = "key") -> DataFrame:
    return top_values(entries, "ip", n, ties)


def top_error_ips(entries: DataFrame, n: int = 10, ties: str = "key") -> DataFrame:
    """By entries whose level is an error; a status alone does not count."""
    return top_values(entries.where(P.level_error()), "ip", n, ties)


def top_paths(entries: DataFrame, n: int = 10, ties: str = "key") -> DataFrame:
    return top_values(entries, "path", n, ties)


def top_status_codes(entries: DataFrame, n: int = 10, ties: str = "key") -> DataFrame:
    return top_values(entries, "status", n, ties)


def top_methods(entries: DataFrame, n: int = 10, ties: str = "key") -> DataFrame:
    return top_values(entries, "method", n, ties)


def top_user_agents(entries: DataFrame, n: int = 10, ties: str = "key") -> DataFrame:
    return top_values(entries, "user_agent", n, ties)


def banned_ips(entries: DataFrame, n: int = 10, ties: str = "key") -> DataFrame:
    """By ban actions, as the ban log records them."""
    return top_values(entries.where(P.banned()), "ip", n, ties)
