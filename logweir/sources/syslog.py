"""Syslog-shaped lines: system journal, syslog, SSH logins, bans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.levels import FAIL2BAN_LEVELS, message_level, named_level, priority_level
from logweir.functions.text import (
    anywhere,
    captures,
    group,
    optional_group,
    strip,
    tag,
    with_captures,
)
from logweir.functions.times import SYSLOG_TIME, from_parts, syslog_time
from logweir.schema import empty_extra, to_entries

# The line formats.
_SYSLOG = SYSLOG_TIME + r"\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s+(.+)"
_PRIORITY = r"(?:<(\d)>)?+"
_ACCEPTED = r"Accepted (\S+) for (\S+) from (\S+) port \d+"
_FAILED = r"(?:Failed \S+|Invalid user (\S+)?) (?:for (\S+) )?from (\S+) port \d+"
# Also reads the two words `invalid user` before the name.
_FAILED_WIDE = (
    r"(?:Failed \S+|Invalid user (\S+)?) (?:for (?:invalid user )?(\S+) )?from (\S+) port \d+"
)
_DISCONNECTED = (
    r"Disconnected from (?:authenticating |invalid )?user (\S+) (\S+) port \d+"
)
_SSH_WORDS = ["sshd", "Accepted", "Failed", "Invalid user", "Disconnected", "Connection closed"]
_FAIL2BAN = (
    r"(\d{4})-(\d{2})-(\d{2}) (\d{2}:\d{2}:\d{2}),\d+\s+"
    r"fail2ban\.(\S+)\s+\[\d+\]:\s+(\w+)\s+(.+)"
)


def _journal(lines: DataFrame, source: str, year: int | None) -> DataFrame:
    """Journal lines. No line is dropped: one of another shape is all message."""
    cases = [("log", _PRIORITY + _SYSLOG, 8), ("text", _PRIORITY, 1)]
    df = with_captures(lines, "parts", captures(F.col("value"), cases))
    parts = F.col("parts")
    is_log = tag(parts) == "log"
    priority = optional_group(parts, 1)
    # The prefix <N> belongs neither to the stored line nor to the message.
    rest = F.when(priority.isNotNull(), F.substring(F.col("value"), 4, 2**31 - 1)).otherwise(
        F.col("value")
    )
    level = F.when(priority.isNull(), "INFO").otherwise(priority_level(priority))
    message = strip(group(parts, 8))
    fields = {
        "source": F.lit(source),
        "raw": rest,
        "timestamp": F.when(
            is_log, syslog_time(group(parts, 2), group(parts, 3), group(parts, 4), year)
        ),
        "level": F.when(is_log, message_level(level, message)).otherwise(level),
        "message": F.when(is_log, message).otherwise(rest),
        "extra": F.when(
            is_log,
            F.create_map(
                F.lit("host"), group(parts, 5),
                F.lit("service"), strip(group(parts, 6)),
                F.lit("pid"), optional_group(parts, 7),
            ),
        ).otherwise(empty_extra()),
    }
    return to_entries(df, F.lit(True), fields)


def systemd(lines: DataFrame, year: int | None = None) -> DataFrame:
    return _journal(lines, "systemd", year)


def syslog(lines: DataFrame, year: int | None = None) -> DataFrame:
    return _journal(lines, "syslog", year)


def _mentions(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def ssh(lines: DataFrame, year: int | None = None, ssh_invalid_user: bool = False) -> DataFrame:
    """SSH login lines; others are dropped.

    ``Failed password for invalid user X from IP`` is, as in the format's
    definition, not taken as a failure. ``ssh_invalid_user=True`` takes it as one.
    """
    df = with_captures(lines, "parts", captures(F.col("value"), [("log", _SYSLOG, 7)]))
    parts = F.col("parts")
    is_log = tag(parts) == "log"
    text = F.when(is_log, strip(group(parts, 7))).otherwise(F.col("value"))
    cases = [
        ("accepted", anywhere(_ACCEPTED), 3),
        ("failed", anywhere(_FAILED_WIDE if ssh_invalid_user else _FAILED), 3),
        ("disconnect", anywhere(_DISCONNECTED), 2),
    ]
    df = df.withColumn("text", text)
    df = with_captures(df, "login", captures(F.col("text"), cases))
    login = F.col("login")
    event = tag(login)
    user = (
        F.when(event == "accepted", group(login, 2))
        .when(
            event == "failed",
            F.coalesce(optional_group(login, 2), optional_group(login, 1), F.lit("unknown")),
        )
        .otherwise(group(login, 1))
    )
    ip = F.when(event == "disconnect", group(login, 2)).otherwise(group(login, 3))
    message = (
        F.when(
            event == "accepted",
            F.concat(F.lit("SSH login accepted: "), user, F.lit(" via "), group(login, 1)),
        )
        .when(event == "failed", F.concat(F.lit("SSH login failed: "), user, F.lit(" from "), ip))
        .when(event == "disconnect", F.concat(F.lit("SSH disconnect: "), user))
        .otherwise(F.col("text"))
    )
    who = [F.lit("user"), user]
    how = [F.lit("auth_method"), group(login, 1)]
    what = [F.lit("event"), event]
    fields = {
        "source": F.lit("ssh"),
        "raw": F.col("value"),
        "timestamp": F.when(
            is_log, syslog_time(group(parts, 1), group(parts, 2), group(parts, 3), year)
        ),
        "level": F.when(event == "failed", "WARNING").otherwise("INFO"),
        "ip": ip,
        "message": message,
        "extra": F.when(event == "accepted", F.create_map(*who, *how, *what))
        .when(event.isNotNull(), F.create_map(*who, *what))
        .otherwise(empty_extra()),
    }
    relevant = _mentions(F.col("text"), _SSH_WORDS) | F.col("value").contains("sshd")
    return to_entries(df, relevant, fields)


def fail2ban(lines: DataFrame) -> DataFrame:
    df = with_captures(lines, "parts", captures(F.col("value"), [("log", _FAIL2BAN, 7)]))
    parts = F.col("parts")
    df = df.withColumn("text", strip(group(parts, 7)))
    cases = [("unban", anywhere(r"Unban (\S+)"), 1), ("ban", anywhere(r"Ban (\S+)"), 1)]
    df = with_captures(df, "action", captures(F.col("text"), cases))
    action = F.col("action")
    # A ban raises the level even where the same message lifts another.
    bans = F.col("text").rlike(r"(?U)Ban \S")
    fields = {
        "source": F.lit("fail2ban"),
        "raw": F.col("value"),
        "timestamp": from_parts(*(group(parts, i) for i in range(1, 5))),
        "level": F.when(bans, "WARNING").otherwise(
            named_level(FAIL2BAN_LEVELS, group(parts, 6))
        ),
        "ip": group(action, 1),
        "message": F.col("text"),
        "extra": F.create_map(
            F.lit("component"), group(parts, 5),
            F.lit("event"), F.coalesce(tag(action), F.lit("info")),
        ),
    }
    return to_entries(df, F.size(parts) > 1, fields)
