"""Web server logs: access and error lines of two servers.

One file may mix both kinds of line, so both patterns are tried on each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.levels import WEB_LEVELS, named_level, status_level
from logweir.functions.text import (
    captures,
    clean,
    group,
    optional_group,
    safe_int,
    strip,
    tag,
    with_captures,
)
from logweir.functions.times import ACCESS_TIME, access_time, from_parts
from logweir.schema import empty_extra, to_entries

# The two log formats. A time that does not parse is still a time
# field, so the line is kept without a timestamp.
_TIME_FIELD = rf"\[(?:{ACCESS_TIME}|[^\]]+)\]"
_REQUEST = (
    r'\s+"(\S+)\s+(\S+)\s+\S+"\s+'
    r"(\d{3})\s+(\S+)"
    r'(?:\s+"([^"]*)"\s+"([^"]*)")?'
)
NGINX_ACCESS = rf"(\S+)\s+-\s+\S+\s+{_TIME_FIELD}{_REQUEST}"
NGINX_ERROR = (
    r"(\d{4})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+"
    r"(\d+)#\d+: \*?\d* ?(.+)"
)
APACHE_ACCESS = rf"(\S+)\s+\S+\s+\S+\s+{_TIME_FIELD}{_REQUEST}"
APACHE_ERROR = (
    r"\[[^\]]+\]\s+\[([^:]+):(\w+)\]\s+\[pid (\d+)\]"
    r"(?:\s+\[client ([^\]]+)\])?\s+(.+)"
)

# Groups of an access line.
_IP, _DAY, _MONTH, _YEAR, _CLOCK, _METHOD, _PATH, _STATUS, _SIZE, _REFERER, _AGENT = range(1, 12)


def _access(parts) -> dict:
    status = safe_int(group(parts, _STATUS))
    return {
        "timestamp": access_time(
            group(parts, _DAY), group(parts, _MONTH), group(parts, _YEAR), group(parts, _CLOCK)
        ),
        "level": status_level(status),
        "ip": group(parts, _IP),
        "method": group(parts, _METHOD),
        "path": group(parts, _PATH),
        "status": status,
        "size": safe_int(group(parts, _SIZE), "bigint"),
        "user_agent": clean(group(parts, _AGENT)),
        "message": F.concat_ws(
            " ", group(parts, _METHOD), group(parts, _PATH), status.cast("string")
        ),
    }


def _either(is_access, access: dict, error: dict) -> dict:
    """Fields by kind of line; a field of one kind is NULL on the other."""
    null = F.lit(None)
    return {
        name: F.when(is_access, access.get(name, null)).otherwise(error.get(name, null))
        for name in {**access, **error}
    }


def nginx(lines: DataFrame) -> DataFrame:
    cases = [("access", NGINX_ACCESS, 11), ("error", NGINX_ERROR, 7)]
    df = with_captures(lines, "parts", captures(F.col("value"), cases))
    parts = F.col("parts")
    is_access = tag(parts) == "access"
    error = {
        "timestamp": from_parts(*(group(parts, i) for i in range(1, 5))),
        "level": named_level(WEB_LEVELS, group(parts, 5)),
        "message": strip(group(parts, 7)),
        "extra": F.create_map(F.lit("pid"), group(parts, 6)),
    }
    access = _access(parts)
    access["extra"] = F.create_map(F.lit("referer"), clean(optional_group(parts, _REFERER)))
    fields = _either(is_access, access, error)
    return to_entries(
        df, F.size(parts) > 1, {"source": F.lit("nginx"), "raw": F.col("value"), **fields}
    )


def apache(lines: DataFrame) -> DataFrame:
    cases = [("access", APACHE_ACCESS, 11), ("error", APACHE_ERROR, 5)]
    df = with_captures(lines, "parts", captures(F.col("value"), cases))
    parts = F.col("parts")
    is_access = tag(parts) == "access"
    error = {
        # The time of an error line is not read, so these entries have none.
        "level": named_level(WEB_LEVELS, group(parts, 2)),
        "ip": F.nullif(F.substring_index(group(parts, 4), ":", 1), F.lit("")),
        "message": strip(group(parts, 5)),
        "extra": F.create_map(
            F.lit("module"), group(parts, 1), F.lit("pid"), group(parts, 3)
        ),
    }
    access = _access(parts)
    access["extra"] = empty_extra()
    fields = _either(is_access, access, error)
    return to_entries(
        df, F.size(parts) > 1, {"source": F.lit("apache"), "raw": F.col("value"), **fields}
    )
