"""Log analytics as Spark jobs.

Log files of many formats become one table of entries; the analyses are
functions from that table to DataFrames.
"""

from logweir.plans.history import append_run, findings, latest_runs, run_result
from logweir.plans.report import Report
from logweir.plans.store import compact, drop_replaced, read_entries, read_rejects, write_entries, write_tagged
from logweir.schema import ENTRY_SCHEMA
from logweir.sources.registry import (
    detect_format,
    formats,
    ingest,
    line_format,
    read_tagged,
    register_format,
    rejects,
)

__all__ = [
    "ENTRY_SCHEMA",
    "Report",
    "append_run",
    "compact",
    "detect_format",
    "drop_replaced",
    "findings",
    "formats",
    "ingest",
    "latest_runs",
    "line_format",
    "read_entries",
    "read_rejects",
    "read_tagged",
    "register_format",
    "rejects",
    "run_result",
    "write_entries",
    "write_tagged",
]
