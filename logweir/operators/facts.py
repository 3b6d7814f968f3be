"""The few aggregates from which the analyses derive.

Most questions ask about the same small groups: per hour, per IP, per path and
so on. ``all_facts`` computes every group in one pass over the entries, so that
a full report reads the entries once for all of them. A single analysis groups
only by what it needs; the optimizer drops the measures it does not use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import predicates as P
from logweir.functions.times import hour_bucket

_FLAGS = {
    "level_errors": P.level_error,
    "warnings": P.level_warning,
    "any_errors": P.is_error,
    "ssh_failures": P.ssh_failure,
    "http_failures": P.http_auth_failure,
    "scan_hits": P.scanner_path,
    "bans": P.banned,
}

#: Sets of keys, by the name under which ``all_facts`` lists them.
GROUPS = {
    "hour": ["hour", "source"],
    "ip": ["ip"],
    "path": ["path"],
    "status_method": ["status", "method"],
    "user_agent": ["user_agent"],
}
_KEYS = ["hour", "source", "ip", "path", "status", "method", "user_agent"]


def _flagged(entries: DataFrame) -> DataFrame:
    """Keys and 0/1 flags, computed once per entry before any grouping."""
    return entries.select(
        hour_bucket(F.col("timestamp")).alias("hour"),
        "timestamp",
        *_KEYS[1:],
        *(flag().cast("int").alias(name) for name, flag in _FLAGS.items()),
    )


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        *(F.sum(name).alias(name) for name in _FLAGS),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    ]


def facts_by(entries: DataFrame, *keys: str) -> DataFrame:
    """Measures per group of keys, out of hour, source, ip, path, status, method, user_agent."""
    return _flagged(entries).groupBy(*keys).agg(*_measures())


def all_facts(entries: DataFrame) -> DataFrame:
    """Measures for every set of ``GROUPS`` in one pass; ``facts`` names the set of a row."""
    flagged = _flagged(entries)
    sets = list(GROUPS.values())
    grouped = flagged.groupingSets(sets, *_KEYS).agg(
        *_measures(), F.grouping_id().alias("set_id")
    )
    # grouping_id has a bit per key, the first key highest: 1 where it is rolled up.
    ids = {
        name: sum(1 << (len(_KEYS) - 1 - i) for i, k in enumerate(_KEYS) if k not in keys)
        for name, keys in GROUPS.items()
    }
    chain = reduce(
        lambda c, item: c.when(F.col("set_id") == item[1], item[0]),
        list(ids.items())[1:],
        F.when(F.col("set_id") == ids["hour"], "hour"),
    )
    return grouped.withColumn("facts", chain).drop("set_id")


def facts_of(all_rows: DataFrame, name: str) -> DataFrame:
    """The rows of one set out of ``all_facts``."""
    others = [k for k in _KEYS if k not in GROUPS[name]]
    return all_rows.where(F.col("facts") == name).drop("facts", *others)


def regroup(facts: DataFrame, *keys: str) -> DataFrame:
    """Roll facts up to fewer keys."""
    return facts.groupBy(*keys).agg(
        *(F.sum(name).alias(name) for name in ("total", *_FLAGS)),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )


def merged_facts(rows: DataFrame) -> DataFrame:
    """Facts of several parts of the entries as those of all of them."""
    return regroup(rows, "facts", *_KEYS)
