"""Suspicious behaviour: brute force, high volume, error rate, scanners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions import predicates as P
from logweir.functions.display import one_decimal, severity
from logweir.operators.facts import facts_by
from logweir.operators.topn import rank

# The bounds of each finding.
BRUTE_FORCE_THRESHOLD = 10
BRUTE_FORCE_HIGH = 50
VOLUME_PERCENT = 20
VOLUME_HIGH = 40
ERROR_PERCENT = 10
ERROR_HIGH = 25
SCANNER_TOP = 5
SCANNER_HITS = 3


def brute_force(entries: DataFrame, threshold: int = BRUTE_FORCE_THRESHOLD) -> DataFrame:
    """IPs with many failed logins, over SSH or as denied HTTP requests."""
    failures = entries.where(P.has("ip") & (P.ssh_failure() | P.http_auth_failure()))
    found = brute_force_of(facts_by(failures, "ip"), threshold)
    return found.orderBy(F.desc("count"), "ip", "type")


def brute_force_of(ips: DataFrame, threshold: int = BRUTE_FORCE_THRESHOLD) -> DataFrame:
    """From facts per IP, in no order."""
    kinds = F.stack(
        F.lit(2),
        F.lit("ssh_brute_force"), F.col("ssh_failures"),
        F.lit("http_brute_force"), F.col("http_failures"),
    ).alias("type", "count")
    return (
        ips.where(P.has("ip"))
        .select("ip", kinds)
        .where(F.col("count") >= threshold)
        .withColumn("severity", severity(F.col("count"), BRUTE_FORCE_HIGH))
    )


def high_volume(entries: DataFrame) -> DataFrame:
    """IPs behind more than a fifth of all entries, those without an IP included."""
    return high_volume_of(facts_by(entries, "ip")).orderBy(F.desc("count"), "ip")


def high_volume_of(ips: DataFrame) -> DataFrame:
    """From facts per IP with the group of entries that have none.

    The total is a scalar subquery over the same aggregate, not a second scan.
    """
    total = ips.agg(F.sum("total").alias("total")).scalar()
    # The IP is tested with the count: a test of the IP alone would be moved below
    # the grouping, which would then no longer be the one that the total is of.
    percent = F.when(P.has("ip"), F.col("total") / total * 100)
    return (
        ips.select("ip", F.col("total").alias("count"), percent.alias("percent"))
        .where(F.col("percent") > VOLUME_PERCENT)
        .select(
            F.lit("high_volume_ip").alias("type"),
            "ip",
            "count",
            F.round("percent", 1).alias("pct"),
            # The sentences of findings, here and below.
            F.concat(
                "ip", F.lit(" accounts for "), one_decimal(F.col("percent")),
                F.lit("% of all requests"),
            ).alias("description"),
            severity(F.col("percent"), VOLUME_HIGH).alias("severity"),
        )
    )


def error_rate_anomaly(entries: DataFrame) -> DataFrame:
    """One row if more than a tenth of all entries are errors by level or status."""
    return error_rate_anomaly_of(
        entries.agg(
            F.count(F.lit(1)).alias("total"), F.count_if(P.is_error()).alias("any_errors")
        )
    )


def error_rate_anomaly_of(totals: DataFrame) -> DataFrame:
    count, total = F.col("any_errors"), F.col("total")
    percent = F.when(total > 0, count / total * 100)
    return (
        totals.withColumn("percent", percent)
        .where(F.col("percent") > ERROR_PERCENT)
        .select(
            F.lit("high_error_rate").alias("type"),
            count.alias("count"),
            F.round("percent", 1).alias("pct"),
            F.concat(
                F.lit("Error rate is "), one_decimal(F.col("percent")), F.lit("% ("),
                count.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"),
            ).alias("description"),
            severity(F.col("percent"), ERROR_HIGH).alias("severity"),
        )
    )


def scanners(entries: DataFrame) -> DataFrame:
    """Of the five IPs that asked most for telltale paths, those with at least three hits."""
    return scanners_of(facts_by(entries.where(P.has("ip") & P.scanner_path()), "ip"))


def scanners_of(ips: DataFrame) -> DataFrame:
    return (
        rank(ips, "ip", SCANNER_TOP, "scan_hits")
        .where(F.col("count") >= SCANNER_HITS)
        .select(
            F.lit("scanner_detected").alias("type"),
            "ip",
            "count",
            F.concat(
                "ip", F.lit(" appears to be scanning for vulnerabilities ("),
                F.col("count").cast("string"), F.lit(" hits)"),
            ).alias("description"),
            F.lit("HIGH").alias("severity"),
        )
    )


def anomalies(entries: DataFrame) -> DataFrame:
    """All three kinds in one list; what a kind does not have is NULL."""
    return anomalies_of(facts_by(entries, "ip"))


def anomalies_of(ips: DataFrame) -> DataFrame:
    totals = ips.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("any_errors"), F.lit(0)).alias("any_errors"),
    )
    found = (
        high_volume_of(ips)
        .unionByName(error_rate_anomaly_of(totals), allowMissingColumns=True)
        .unionByName(scanners_of(ips), allowMissingColumns=True)
    )
    return found.select("type", "ip", "count", "pct", "description", "severity")
