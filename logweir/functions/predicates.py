"""Boolean Columns over entries. All are false, never NULL, on absent values.

There are two notions of error. ``level_error`` looks at the level only and
drives totals, error rate, top error IPs and the timeline. ``is_error`` also
counts every status from 400 on, and drives spikes, the error-rate anomaly and
alerts. A 404 is a WARNING: the second counts it, the first does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.text import present

# Levels, sources and words that the detections look for.
ERROR_LEVELS = ["ERROR", "CRITICAL"]
SSH_SOURCES = ["ssh", "syslog", "systemd"]
SSH_FAILURE_LEVELS = ["WARNING", "ERROR"]
SSH_FAILURE_WORDS = ["failed", "invalid user", "authentication failure"]
HTTP_DENIED = [401, 403]
SCAN_PATHS = (
    r"(\.env|\.git|wp-admin|wp-login|phpmyadmin|\.php|/etc/passwd|"
    r"eval\(|base64_decode|union\s+select|<script)"
)


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def level_error() -> Column:
    return _sure(F.col("level").isin(ERROR_LEVELS))


def level_warning() -> Column:
    return _sure(F.col("level") == "WARNING")


def http_error() -> Column:
    return _sure(F.col("status") >= 400)


def is_error() -> Column:
    return http_error() | level_error()


def is_client_error() -> Column:
    return _sure(F.col("status").between(400, 499))


def is_server_error() -> Column:
    return _sure(F.col("status") >= 500)


def ssh_failure() -> Column:
    """A failed login: marked so by its format, or told by level and words."""
    message = F.lower(F.col("message"))
    words = F.lit(False)
    for word in SSH_FAILURE_WORDS:
        words = words | message.contains(word)
    marked = _sure(F.element_at("extra", "event") == "failed")
    told = _sure(F.col("level").isin(SSH_FAILURE_LEVELS) & words)
    return _sure(F.col("source").isin(SSH_SOURCES)) & (marked | told)


def http_auth_failure() -> Column:
    return _sure(F.col("status").isin(HTTP_DENIED))


def scanner_path() -> Column:
    return _sure(F.col("path").rlike(f"(?iU){SCAN_PATHS}"))


def banned() -> Column:
    return _sure((F.col("source") == "fail2ban") & (F.element_at("extra", "event") == "ban"))


def has_time() -> Column:
    return F.col("timestamp").isNotNull()


def has(column: str) -> Column:
    """The value is there: not NULL, not '' and, for a status, not 0."""
    if column == "status":
        return _sure(F.col(column) != 0)
    return _sure(present(F.col(column)))
