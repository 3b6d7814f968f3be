"""Severity levels: from status codes, level names, priorities and message words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.text import lookup

# How each format's own level names map to the common levels.
WEB_LEVELS = {
    "debug": "DEBUG",
    "info": "INFO",
    "notice": "INFO",
    "warn": "WARNING",
    "error": "ERROR",
    "crit": "CRITICAL",
    "alert": "CRITICAL",
    "emerg": "CRITICAL",
}
FAIL2BAN_LEVELS = {
    "debug": "DEBUG",
    "info": "INFO",
    "warning": "WARNING",
    "error": "ERROR",
    "critical": "CRITICAL",
}
BROWSER_LEVELS = {
    "error": "ERROR",
    "warn": "WARNING",
    "warning": "WARNING",
    "info": "INFO",
    "log": "INFO",
    "debug": "DEBUG",
}
CUSTOM_LEVELS = {
    "debug": "DEBUG",
    "info": "INFO",
    "warn": "WARNING",
    "warning": "WARNING",
    "error": "ERROR",
    "critical": "CRITICAL",
    "fatal": "CRITICAL",
}
WINDOWS_LEVELS = {
    "0": "INFO",
    "1": "CRITICAL",
    "2": "ERROR",
    "3": "WARNING",
    "4": "INFO",
    "5": "DEBUG",
}
SYSLOG_PRIORITIES = {
    "0": "CRITICAL",
    "1": "CRITICAL",
    "2": "CRITICAL",
    "3": "ERROR",
    "4": "WARNING",
    "5": "INFO",
    "6": "INFO",
    "7": "DEBUG",
}
ERROR_WORDS = ["error", "failed", "failure"]
WARNING_WORDS = ["warning", "warn"]
CRITICAL_WORDS = ["critical"]

# Windows security events with a known meaning.
WINDOWS_EVENTS = [
    (4625, "Failed logon attempt", "WARNING"),
    (4648, "Explicit credentials logon", "WARNING"),
    (4719, "System audit policy changed", "ERROR"),
    (4720, "User account created", "INFO"),
    (4722, "User account enabled", "INFO"),
    (4724, "Password reset attempt", "WARNING"),
    (4726, "User account deleted", "WARNING"),
    (4740, "User account locked out", "WARNING"),
    (4756, "Member added to security group", "INFO"),
    (4771, "Kerberos pre-authentication failed", "WARNING"),
    (1102, "Audit log cleared", "CRITICAL"),
    (7045, "New service installed", "WARNING"),
]


def named_level(table: dict[str, str], name: Column) -> Column:
    """Level of a name; INFO for one the table does not know."""
    return F.coalesce(lookup(table, F.lower(name)), F.lit("INFO"))


def status_level(status: Column) -> Column:
    """Level of an HTTP status; an absent one is INFO."""
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO")


def _any_word(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def priority_level(digit: Column) -> Column:
    return F.coalesce(lookup(SYSLOG_PRIORITIES, digit), F.lit("INFO"))


def message_level(level: Column, message: Column) -> Column:
    """Sharpen an INFO level by the words of the message."""
    text = F.lower(message)
    inferred = (
        F.when(_any_word(text, ERROR_WORDS), "ERROR")
        .when(_any_word(text, WARNING_WORDS), "WARNING")
        .when(_any_word(text, CRITICAL_WORDS), "CRITICAL")
        .otherwise("INFO")
    )
    return F.when(level == "INFO", inferred).otherwise(level)


def windows_events(spark: SparkSession) -> DataFrame:
    """The known events as a table of twelve rows."""
    rows = ", ".join(f"({i}, '{text}', '{level}')" for i, text, level in WINDOWS_EVENTS)
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(known_id, description, known_level)"
    )


def with_windows_event(df: DataFrame, event_id: Column) -> DataFrame:
    """Add ``description`` and ``known_level`` of the event; NULL if unknown.

    The broadcast side has twelve rows, always.
    """
    known = F.broadcast(windows_events(df.sparkSession))
    return df.join(known, event_id == known["known_id"], "left").drop("known_id")
