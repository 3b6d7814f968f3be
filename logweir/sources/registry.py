"""Formats by name, format detection and the ingest entry points."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.text import with_captures
from logweir.schema import ENTRY_COLUMNS, ORDER_COLUMNS, PARSED, to_entries
from logweir.sources import custom as custom_format
from logweir.sources import documents, syslog, web, xml
from logweir.sources.lines import Paths, scan_lines

#: A reader gives the tagged entries of files: (spark, paths, files filter, **options).
Reader = Callable[..., DataFrame]

_LINE_FORMATS: dict[str, Callable[..., DataFrame]] = {
    "nginx": web.nginx,
    "apache": web.apache,
    "systemd": syslog.systemd,
    "syslog": syslog.syslog,
    "ssh": syslog.ssh,
    "fail2ban": syslog.fail2ban,
}
_FILE_FORMATS: dict[str, Reader] = {
    "browser": documents.read_browser,
    "har": documents.read_har,
    "windows": xml.read_windows,
}

# Which file names mean which format, first match first.
_BY_SUFFIX = [(".har", "har"), (".xml", "windows"), (".json", "browser")]
_BY_WORD = [
    (["nginx"], "nginx"),
    (["apache", "httpd"], "apache"),
    (["auth", "secure", "ssh"], "ssh"),
    (["fail2ban"], "fail2ban"),
    (["syslog", "messages"], "syslog"),
    (["journal", "systemd"], "systemd"),
]
_DEFAULT_FORMAT = "nginx"


def formats() -> list[str]:
    return [*_LINE_FORMATS, *_FILE_FORMATS, "custom"]


def register_format(
    name: str, fields: Callable[[Column], Mapping[str, Column]], parsed: Callable[[Column], Column]
) -> None:
    """Add a line format of one's own.

    ``fields`` maps the line to entry columns, ``parsed`` says which lines the
    format accepts. Both are built from Column expressions.
    """
    if name in formats():
        raise ValueError(f"Format '{name}' exists")

    def parse(lines: DataFrame) -> DataFrame:
        line = F.col("value")
        df = with_captures(lines, "accepted", F.coalesce(parsed(line), F.lit(False)))
        # A field need only work on lines that the format accepts.
        own = {key: F.when(F.col("accepted"), value) for key, value in fields(line).items()}
        return to_entries(df, F.col("accepted"), {"source": F.lit(name), "raw": line, **own})

    _LINE_FORMATS[name] = parse


def line_format(name: str, config: Mapping | str | None = None, **options) -> Callable:
    """The function from lines to tagged entries, for any table or stream of lines."""
    if name == "custom":
        if config is None:
            raise ValueError("The custom format requires a config")
        return lambda lines: custom_format.custom(lines, config)
    by_line = {
        **_LINE_FORMATS,
        "browser": documents.browser,
        "windows": xml.windows_lines,
    }
    if name not in by_line:
        raise ValueError(f"Unknown format '{name}'. Available: {', '.join(formats())}")
    return lambda lines: by_line[name](lines, **options)


def detect_format(file_name: Column) -> Column:
    """Format by file name: by ending, then by words in it, else web access logs."""
    name = F.lower(file_name)
    rules = [(name.endswith(suffix), fmt) for suffix, fmt in _BY_SUFFIX]
    for words, fmt in _BY_WORD:
        rules.append((reduce(lambda a, b: a | b, (name.contains(w) for w in words)), fmt))
    first, *rest = rules
    chain = F.when(*first)
    for condition, fmt in rest:
        chain = chain.when(condition, fmt)
    return chain.otherwise(_DEFAULT_FORMAT)


def _read_one(
    spark: SparkSession, paths: Paths, fmt: str, files: Column | None, config, options: dict
) -> DataFrame:
    if fmt in _FILE_FORMATS:
        return _FILE_FORMATS[fmt](spark, paths, files=files, **options)
    return line_format(fmt, config, **options)(scan_lines(spark, paths, files))


def read_tagged(
    spark: SparkSession,
    paths: Paths,
    fmt: str = "auto",
    config: Mapping | str | None = None,
    options: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """All lines of all files in entry form, with ``parsed`` telling entries from rejects.

    ``auto`` takes each file's format from its name. The choice is a filter on
    file metadata in every branch, so a file is opened by one format only.
    ``options`` holds keyword arguments by format name, e.g. ``{"ssh": {"year": 2024}}``.
    """
    options = options or {}
    if fmt != "auto":
        return _read_one(spark, paths, fmt, None, config, dict(options.get(fmt, {})))
    detected = detect_format(F.col("_metadata.file_name"))
    branches = [
        _read_one(spark, paths, name, detected == name, None, dict(options.get(name, {})))
        for name in [*_FILE_FORMATS, *dict.fromkeys(f for _, f in _BY_WORD)]
    ]
    return reduce(DataFrame.unionByName, branches)


def entries_of(tagged: DataFrame) -> DataFrame:
    return tagged.where(PARSED).select(ENTRY_COLUMNS)


def rejects_of(tagged: DataFrame) -> DataFrame:
    """Lines that no format accepted, as they stand in the file."""
    return tagged.where(~F.col(PARSED)).select("raw", *ORDER_COLUMNS)


def ingest(spark: SparkSession, paths: Paths, fmt: str = "auto", config=None, options=None):
    """Entries of log files."""
    return entries_of(read_tagged(spark, paths, fmt, config, options))


def rejects(spark: SparkSession, paths: Paths, fmt: str = "auto", config=None, options=None):
    """Lines of log files that are no entries."""
    return rejects_of(read_tagged(spark, paths, fmt, config, options))
