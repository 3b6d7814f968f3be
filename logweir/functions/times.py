"""Wall-clock times from log texts.

Every time is TIMESTAMP_NTZ and built by casting an ISO text, which neither
depends on the session time zone nor fails under ANSI mode: a text that is no
valid time gives NULL. UTC offsets are read and dropped, never applied.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.text import captures, group, lookup, optional_group

# English month names, as log formats write them.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

#: A UTC offset as access logs and ISO texts write it.
OFFSET = r"(?:[+-]\d{2}:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?|Z)"

#: Access-log time, e.g. ``10/Oct/2024:13:55:36 +0000``; 4 groups. The offset is required.
ACCESS_TIME = (
    r"(\d{1,2})/(\w{3})/(\d{4}):(\d{1,2}:\d{1,2}:\d{1,2})\s+" + OFFSET
)

#: Syslog time without a year, e.g. ``Oct  1 13:55:36``; 3 groups.
SYSLOG_TIME = r"(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})"


def month_number(name: Column) -> Column:
    """Two-digit month of an English abbreviation in any case, else NULL."""
    table = {month[:3]: f"{i:02d}" for i, month in enumerate(MONTHS, 1)}
    return lookup(table, F.lower(name))


def from_parts(year: Column, month: Column, day: Column, clock: Column) -> Column:
    """Time from year, month and day numbers and a ``HH:mm:ss[.f]`` text."""
    dash, blank = F.lit("-"), F.lit(" ")
    return F.concat(year, dash, month, dash, day, blank, clock).try_cast("timestamp_ntz")


def access_time(day: Column, month: Column, year: Column, clock: Column) -> Column:
    return from_parts(year, month_number(month), day, clock)


def syslog_time(month: Column, day: Column, clock: Column, year: int | None) -> Column:
    """Syslog lines carry no year: take the given one, or the current one."""
    when = F.lit(year) if year is not None else F.year(F.current_date())
    return from_parts(F.lpad(when.cast("string"), 4, "0"), month_number(month), day, clock)


# Extended and basic calendar dates, any one character before the time, a
# fraction of any length (six digits kept), an optional offset.
_ISO = (
    r"(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:[\x{0}-\x{10FFFF}](\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r" ?(?:[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?|Z)?)?\z"
)


def iso_time(text: Column) -> Column:
    """ISO 8601 calendar time (``2024-10-10T13:55:36.123Z`` and its shorter forms)."""
    parts = captures(text, [("iso", _ISO, 9)])

    def number(i: int) -> Column:
        return F.coalesce(optional_group(parts, i), F.lit("00"))

    clock = F.concat_ws(":", number(5), number(7), number(8))
    fraction = F.concat(F.lit("."), F.coalesce(optional_group(parts, 9), F.lit("0")))
    return from_parts(group(parts, 1), group(parts, 3), group(parts, 4), F.concat(clock, fraction))


def _names(values: list[str]) -> str:
    return "|".join(sorted(values, key=len, reverse=True))


# What each strptime code reads. A number keeps the ranges strptime allows, so
# adjacent codes such as %Y%m%d split as they should; second 60 is no valid time.
_CODES = {
    "Y": r"(\d{4})",
    "y": r"(\d{2})",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "d": r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])",
    "H": r"(2[0-3]|[01]\d|\d)",
    "I": r"(1[0-2]|0[1-9]|[1-9])",
    "M": r"([0-5]\d|\d)",
    "S": r"([0-5]\d|\d)",
    "f": r"(\d{1,6})",
    "b": f"((?i:{_names([m[:3] for m in MONTHS])}))",
    "B": f"((?i:{_names(MONTHS)}))",
    "p": r"((?i:am|pm))",
}
_SKIPPED = {
    "z": OFFSET,
    "a": f"(?i:{_names([d[:3] for d in WEEKDAYS])})",
    "A": f"(?i:{_names(WEEKDAYS)})",
    "%": "%",
}
_SHORTHAND = {"T": "%H:%M:%S", "R": "%H:%M", "F": "%Y-%m-%d", "D": "%m/%d/%y"}


def compile_time_format(time_format: str) -> tuple[str, list[str]]:
    """Regex for a strptime format, and the code that each of its groups holds."""
    time_format = re.sub(r"%([TRFD])", lambda m: _SHORTHAND[m.group(1)], time_format)
    regex, codes = "", []
    for token in re.findall(r"%.|\s+|[^%\s]+|%$", time_format):
        code = token[1:]
        if token.isspace():
            regex += r"\s+"
        elif not token.startswith("%"):
            regex += "".join(f"\\x{{{ord(c):x}}}" for c in token)
        elif code in _SKIPPED:
            regex += _SKIPPED[code]
        elif code in _CODES and code not in codes:
            regex += _CODES[code]
            codes.append(code)
        else:
            raise ValueError(f"Unsupported time format code {token!r} in {time_format!r}")
    if not codes:
        raise ValueError(f"No time in format {time_format!r}")
    return f"(?i:{regex})\\z", codes


def parse_time(text: Column, time_format: str) -> Column:
    """Time by a strptime format; the whole text must match it, else NULL."""
    regex, codes = compile_time_format(time_format)
    parts = captures(text, [("time", regex, len(codes))])
    value = {code: group(parts, i) for i, code in enumerate(codes, 1)}

    if "Y" in value:
        year = value["Y"]
    elif "y" in value:
        short = value["y"].try_cast("int")
        year = (short + F.when(short < 69, 2000).otherwise(1900)).cast("string")
    else:
        year = F.lit("1900")
    if "m" in value:
        month = value["m"]
    elif "b" in value or "B" in value:
        month = month_number(F.substring(value.get("b", value.get("B")), 1, 3))
    else:
        month = F.lit("01")
    day = F.ltrim(value["d"]) if "d" in value else F.lit("01")
    if "I" in value and "H" not in value:
        hour_12 = value["I"].try_cast("int") % 12
        evening = F.lower(value["p"]) == "pm" if "p" in value else F.lit(False)
        hour = F.when(evening, hour_12 + 12).otherwise(hour_12).cast("string")
    else:
        hour = value.get("H", F.lit("00"))
    minute = value.get("M", F.lit("00"))
    second = value.get("S", F.lit("00"))
    # concat, not concat_ws: without a match the parts are NULL, and so is the time.
    clock = F.concat(hour, F.lit(":"), minute, F.lit(":"), second)
    if "f" in value:
        clock = F.concat(clock, F.lit("."), value["f"])
    return from_parts(year, month, day, clock)


def hour(timestamp: Column) -> Column:
    return F.hour(timestamp)


def weekday(timestamp: Column) -> Column:
    """English name of the day."""
    return F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(timestamp.cast("date")))


def hour_bucket(timestamp: Column) -> Column:
    """Start of the calendar hour.

    date_trunc and date_format work on zoned times only, which would move a
    wall-clock time that the session's zone skips; so neither is used here.
    """
    zero = F.lit(0)
    within = F.make_dt_interval(
        zero, zero, F.minute(timestamp), F.extract(F.lit("SECOND"), timestamp)
    )
    return timestamp - within


def hour_label(bucket: Column) -> Column:
    """Bucket as ``yyyy-MM-dd HH:00``. Format after grouping, not before."""
    return F.concat(F.substring(bucket.cast("string"), 1, 13), F.lit(":00"))


def iso_text(timestamp: Column) -> Column:
    """ISO text; the fraction is written, with six digits, only if there is one."""
    text = F.translate(timestamp.cast("string"), " ", "T")
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def wall_micros(timestamp: Column) -> Column:
    """Microseconds since 1970 on the wall clock, whatever the session time zone."""
    day = F.unix_date(timestamp.cast("date")).cast("bigint")
    minutes = (day * 24 + F.hour(timestamp)) * 60 + F.minute(timestamp)
    seconds = F.extract(F.lit("SECOND"), timestamp)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")
