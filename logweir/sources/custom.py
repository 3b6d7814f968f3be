"""A user's own line format, defined by a regular expression with named groups."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.levels import CUSTOM_LEVELS, named_level
from logweir.functions.text import captures, group, optional_group, safe_int, with_captures
from logweir.functions.times import parse_time
from logweir.schema import to_entries

_KEYS = {
    "name", "pattern", "time_field", "time_format", "level_field", "ip_field",
    "message_field", "status_field", "path_field", "method_field", "level_map",
}

# What differs between the pattern language of the config and that of Spark.
# Escapes and character classes are matched first, to be left as they are.
_TOKENS = re.compile(r"\\Z|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<(\w+)>|\(\?P=(\w+)\)")


def spark_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """Pattern with numbered groups, and the number of each named group."""
    numbers = dict(re.compile(pattern).groupindex)

    def token(m: re.Match) -> str:
        if m.group(1):
            return "("
        if m.group(2):
            return f"(?:\\{numbers[m.group(2)]})"
        return r"\z" if m.group() == r"\Z" else m.group()

    return _TOKENS.sub(token, pattern), numbers


def load_config(config: Mapping | str) -> dict:
    """Config given as a mapping or as JSON text."""
    loaded = json.loads(config) if isinstance(config, str) else dict(config)
    if "pattern" not in loaded:
        raise ValueError("A custom format needs a pattern")
    unknown = set(loaded) - _KEYS
    if unknown:
        raise ValueError(f"Unknown keys of a custom format: {', '.join(sorted(unknown))}")
    return loaded


def custom(lines: DataFrame, config: Mapping | str) -> DataFrame:
    """Entries by the config's pattern; lines it does not match are dropped.

    Keys: ``pattern``, and optionally ``name``, ``time_field`` with
    ``time_format`` (strptime codes), ``level_field`` with ``level_map``, and
    ``ip_field``, ``message_field``, ``status_field``, ``path_field``,
    ``method_field``. A missing message group makes the line the message.
    """
    cfg = load_config(config)
    pattern, numbers = spark_pattern(cfg["pattern"])
    total = re.compile(cfg["pattern"]).groups
    df = with_captures(lines, "parts", captures(F.col("value"), [("line", pattern, total)]))
    parts = F.col("parts")

    def field(key: str, default: str | None = None):
        name = cfg.get(key, default)
        return optional_group(parts, numbers[name]) if name in numbers else None

    fields = {"source": F.lit(cfg.get("name", "custom")), "raw": F.col("value")}
    time, time_format = field("time_field"), cfg.get("time_format")
    if time is not None and time_format:
        fields["timestamp"] = parse_time(time, time_format)
    level = field("level_field")
    if level is not None:
        fields["level"] = named_level(cfg.get("level_map", CUSTOM_LEVELS), level)
    for key in ("ip", "method", "path", "status"):
        value = field(f"{key}_field")
        if value is not None:
            fields[key] = safe_int(value) if key == "status" else value
    message_name = cfg.get("message_field", "message")
    if message_name in numbers:
        fields["message"] = group(parts, numbers[message_name])
    else:
        fields["message"] = F.col("value")

    taken = {cfg.get(k) for k in ("time_field", "level_field", "ip_field")} | {message_name}
    rest = [
        x
        for name, i in numbers.items()
        if name not in taken
        for x in (F.lit(name), optional_group(parts, i))
    ]
    if rest:
        fields["extra"] = F.create_map(*rest)
    return to_entries(df, F.size(parts) > 1, fields)
