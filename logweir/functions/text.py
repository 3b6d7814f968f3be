"""Text helpers as native Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A Unicode noncharacter, reserved for internal use by the standard. Text that
# holds one anyway has it shown as the replacement character while it is parsed.
_MARK = "\ufdd0"
_REPLACEMENT = "\ufffd"

# `d`: only \n ends a line for `.`, as the log formats need. `U`: \s, \w and \d
# know all of Unicode, so that a no-break space still separates fields.
_FLAGS = "(?dU)"

#: Characters counted as blank at both ends of a text: ASCII and Unicode white space.
BLANKS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def captures(text: Column, cases: Sequence[tuple[str, str, int]]) -> Column:
    """Capture groups of the first case whose pattern matches the start of ``text``.

    ``cases`` lists ``(tag, pattern, number of groups)``. A match is rewritten to
    its groups with a mark between them and then split once, so a line costs one
    regex run per case tried, however many fields are taken. Read the result with
    ``tag`` and ``group``; without a match both give NULL.
    """
    out = F.when(
        text.contains(_MARK), F.replace(text, F.lit(_MARK), F.lit(_REPLACEMENT))
    ).otherwise(text)
    for tag_name, pattern, groups in cases:
        whole = f"{_FLAGS}^(?!{_MARK})(?:{pattern})(?s:.*)\\z"
        parts = ["", tag_name, *(f"${i}" for i in range(1, groups + 1))]
        out = F.regexp_replace(out, whole, _MARK.join(parts))
    return F.split(out, _MARK, -1)


def anywhere(pattern: str) -> str:
    """Let a pattern of ``captures`` match at any place, leftmost first."""
    return f"(?s:.*?){pattern}"


def with_captures(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add the captures as a column that is computed once per row.

    A plain projection would be inlined into every filter and field that uses it.
    The optimizer does not move expressions through a generated column.
    """
    return df.select("*", F.explode(F.array(expression)).alias(name))


def tag(parts: Column) -> Column:
    return F.get(parts, F.lit(1))


def group(parts: Column, index: int) -> Column:
    """Capture group ``index`` (from 1); '' if the group took no part."""
    return F.get(parts, F.lit(index + 1))


def optional_group(parts: Column, index: int) -> Column:
    return F.nullif(group(parts, index), F.lit(""))


def strip(text: Column) -> Column:
    """Remove blanks at both ends, Unicode blanks included."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def present(value: Column) -> Column:
    """Neither NULL nor the empty text."""
    return value.isNotNull() & (value != "")


def clean(text: Column) -> Column:
    """'-' and '' become NULL; surrounding quotes and blanks go."""
    return F.when(~text.isin("-", ""), strip(F.btrim(text, F.lit('"'))))


def safe_int(text: Column, data_type: str = "int") -> Column:
    """Whole number, or NULL for anything else ('-', '', words, overflow)."""
    return text.try_cast(data_type)


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small fixed table, NULL for an unknown key."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


def text_of(value: Column) -> Column:
    """Text of a value that may be absent, written as ``None`` then."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def last_wins_map(pairs: Column) -> Column:
    """Map from an array of (key, value) structs; a later key replaces an earlier one."""
    kept = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == p["key"]
        ),
    )
    return F.map_from_entries(kept)


def url_path(url: Column) -> Column:
    """Path of a URL: query cut off, scheme and host removed; NULL for no URL."""
    head = F.substring_index(url, "?", 1)
    pieces = F.split(head, "/", -1)
    rest = F.concat(F.lit("/"), F.array_join(F.slice(pieces, 4, F.size(pieces)), "/"))
    return F.when(present(url), F.when(head.contains("://"), rest).otherwise(head))


def header_value(headers: Column, name: str) -> Column:
    """First value of a header in an array of (name, value) structs, any case."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.get(hits, F.lit(0))["value"]
