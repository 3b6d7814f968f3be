"""Cross-source correlation: failed logins and HTTP errors of one IP, close in time.

The smallest gap between the two sides is found without comparing pairs. In
time order, the closest event of the other side is either in the same minute or
is the last one before it. So minutes are reduced first, each to the first and
last time of both sides and its smallest gap, and then the minutes of an IP are
reduced the same way. A busy IP is thereby spread over its minutes, and repeats
of one instant are combined before any of it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions import predicates as P
from logweir.functions.display import severity
from logweir.functions.times import wall_micros
from logweir.operators.detections import BRUTE_FORCE_THRESHOLD

WINDOW_MINUTES = 10
_MINUTE = 60_000_000


def instants(entries: DataFrame) -> DataFrame:
    """Events per IP and instant. An entry on both sides counts on both."""
    events = entries.where(P.has("ip") & P.has_time() & (P.ssh_failure() | P.http_error()))
    return (
        events.select(
            "ip",
            wall_micros(F.col("timestamp")).alias("at"),
            P.ssh_failure().cast("int").alias("ssh"),
            P.http_error().cast("int").alias("http"),
        )
        .groupBy("ip", "at")
        .agg(F.sum("ssh").alias("ssh_count"), F.sum("http").alias("http_count"))
    )


def _marked(counted: DataFrame) -> DataFrame:
    """Instants as pieces of time; one with both sides has no gap."""
    ssh_at = F.when(F.col("ssh_count") > 0, F.col("at"))
    http_at = F.when(F.col("http_count") > 0, F.col("at"))
    return counted.select(
        "*",
        ssh_at.alias("ssh_first"),
        ssh_at.alias("ssh_last"),
        http_at.alias("http_first"),
        http_at.alias("http_last"),
        F.when((F.col("ssh_count") > 0) & (F.col("http_count") > 0), 0).cast("bigint").alias("gap"),
    )


def minute_of(at: str) -> Column:
    """The start of the minute of an instant."""
    return F.col(at) - F.pmod(F.col(at), F.lit(_MINUTE))


def minutes_of(counted: DataFrame) -> DataFrame:
    """Instants reduced to one piece per IP and minute."""
    return _reduce(_marked(counted.withColumn("minute", minute_of("at"))), ["ip", "minute"], "at")


def gaps_of(minutes: DataFrame) -> DataFrame:
    """The closest gaps per IP from one piece per IP and minute."""
    return (
        _reduce(minutes, ["ip"], "minute")
        .where(F.col("gap").isNotNull())
        .select("ip", "ssh_count", "http_count", "gap")
    )


def merged_minutes(minutes: DataFrame, counted: DataFrame) -> DataFrame:
    """One piece per IP and minute out of the pieces of several loads.

    Pieces of one minute may interleave, so a minute with several is reduced again from
    its instants; ``counted`` are those of all loads, of which only shared minutes are needed.
    """
    shared = minutes.groupBy("ip", "minute").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    alone = minutes.join(shared, ["ip", "minute"], "left_anti")
    again = counted.withColumn("minute", minute_of("at")).join(shared, ["ip", "minute"], "left_semi")
    summed = again.groupBy("ip", "at").agg(F.sum("ssh_count").alias("ssh_count"), F.sum("http_count").alias("http_count"))
    return alone.unionByName(minutes_of(summed))


def _reduce(pieces: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Merge ordered pieces of time into one row per key."""
    before = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    after_ssh = F.col("http_first") - F.max("ssh_last").over(before)
    after_http = F.col("ssh_first") - F.max("http_last").over(before)
    return (
        pieces.withColumn("gap", F.least("gap", after_ssh, after_http))
        .groupBy(*keys)
        .agg(
            F.sum("ssh_count").alias("ssh_count"),
            F.sum("http_count").alias("http_count"),
            F.min("ssh_first").alias("ssh_first"),
            F.max("ssh_last").alias("ssh_last"),
            F.min("http_first").alias("http_first"),
            F.max("http_last").alias("http_last"),
            F.min("gap").alias("gap"),
        )
    )


def closest_gaps(entries: DataFrame) -> DataFrame:
    """Per IP active on both sides: events per side and the smallest gap in microseconds."""
    return gaps_of(minutes_of(instants(entries)))


def correlations(
    entries: DataFrame,
    window_minutes: float = WINDOW_MINUTES,
    several_sources: Column | None = None,
) -> DataFrame:
    """IPs whose failed logins and HTTP errors come within ``window_minutes``.

    Counts are of all events, not of those in the window. There are none unless
    the entries hold more than one source; pass ``several_sources`` if known.
    """
    if several_sources is None:
        several_sources = entries.agg(F.min("source") < F.max("source")).scalar()
    found = correlations_of(closest_gaps(entries).where(several_sources), window_minutes)
    return found.orderBy("closest_gap_minutes", "ip")


def correlations_of(gaps: DataFrame, window_minutes: float = WINDOW_MINUTES) -> DataFrame:
    """From the closest gaps per IP, in no order."""
    minutes = F.round(F.col("gap") / 1_000_000 / 60, 1)
    return gaps.where(F.col("gap") <= int(window_minutes * _MINUTE)).select(
        "ip",
        F.array(F.lit("ssh"), F.lit("nginx/apache")).alias("sources"),
        F.col("ssh_count").alias("ssh_event_count"),
        F.col("http_count").alias("http_event_count"),
        minutes.alias("closest_gap_minutes"),
        # The sentence of a correlation.
        F.concat(
            "ip", F.lit(": "), F.col("ssh_count").cast("string"),
            F.lit(" SSH auth failure(s) and "), F.col("http_count").cast("string"),
            F.lit(" HTTP 4xx/error request(s), closest pair "), minutes.cast("string"),
            F.lit(" min apart"),
        ).alias("description"),
        severity(F.col("ssh_count"), BRUTE_FORCE_THRESHOLD - 1).alias("severity"),
    )
