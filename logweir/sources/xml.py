"""Windows events as XML: files of events, or one event per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.levels import WINDOWS_LEVELS, named_level, with_windows_event
from logweir.functions.text import last_wins_map, present, safe_int, strip, with_captures
from logweir.functions.times import iso_time
from logweir.schema import ORDER_COLUMNS, to_entries
from logweir.sources.documents import (
    file_kinds,
    json_elements,
    of_kind,
    read_arrays,
    windows_json,
    windows_message,
)
from logweir.sources.lines import Paths, scan_documents, scan_lines, scan_pieces

_EVENT_SCHEMA = (
    "System struct<EventID: string, Level: string, "
    "TimeCreated: struct<_SystemTime: string, _VALUE: string>, Channel: string>, "
    "EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
)

_START = r"(?s)<Event[\s>].*"
_END = "</Event>"
#: What may stand around events: the declaration, comments, the wrapper's tags.
_AROUND = r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|</?Events\b[^>]*>"

# Event fields that may name the remote host, and an empty one.
_HOST_FIELDS = ["IpAddress", "WorkstationName"]
_NO_HOST = "-"


def windows_lines(lines: DataFrame) -> DataFrame:
    """One ``<Event>`` per line, with or without the namespace of its schema."""
    df = with_captures(lines, "event", F.from_xml("value", _EVENT_SCHEMA))
    df = df.select("event.*", "value", *ORDER_COLUMNS)
    system = F.col("System")
    data = F.transform(
        F.coalesce(F.col("EventData.Data"), F.array()),
        lambda d: F.struct(
            F.coalesce(d["_Name"], F.lit("")).alias("key"),
            F.coalesce(d["_VALUE"], F.lit("")).alias("value"),
        ),
    )
    df = df.withColumn("event_id", safe_int(strip(system["EventID"])))
    df = with_captures(df, "data", data)
    df = with_windows_event(df, F.col("event_id"))

    hosts = F.filter(
        "data",
        lambda d: d["key"].isin(_HOST_FIELDS) & present(d["value"]) & (d["value"] != _NO_HOST),
    )
    host = F.ltrim(strip(F.element_at(F.col("hosts"), -1)["value"]), F.lit("\\"))
    df = df.withColumn("hosts", F.when(F.size(hosts) > 0, hosts))
    fixed = F.array(
        *(
            F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
            for key, value in (("event_id", F.col("event_id")), ("channel", system["Channel"]))
        )
    )
    when = F.coalesce(
        F.nullif(system["TimeCreated"]["_VALUE"], F.lit("")), system["TimeCreated"]["_SystemTime"]
    )
    level = F.coalesce(F.nullif(system["Level"], F.lit("")), F.lit("4"))
    df = df.withColumn("pairs", F.concat(fixed, F.col("data")))
    fields = {
        "source": F.lit("windows_event"),
        # An entry has no line; what is no event is kept as it stands.
        "raw": F.when(system.isNotNull(), "").otherwise(F.col("value")),
        "timestamp": iso_time(when),
        "level": F.coalesce(F.col("known_level"), named_level(WINDOWS_LEVELS, level)),
        "ip": host,
        "message": windows_message(),
        "extra": last_wins_map(F.col("pairs")),
    }
    return to_entries(df, system.isNotNull(), fields)


def scan_events(spark: SparkSession, paths: Paths, files: Column | None = None) -> DataFrame:
    """``<Event>`` elements, wherever they stand in XML files, and other text, as rows.

    Records end at ``</Event>``, so a large file is split like one of lines. What
    stands before an event, or in a file without any, is a row of its own
    unless it is blank, a declaration, a comment or the wrapper of the events.
    """
    records = scan_pieces(spark, paths, _END, files)
    found = with_captures(records, "event", F.regexp_extract("value", _START, 0))
    before = F.substring(F.col("value"), F.lit(1), F.length("value") - F.length("event"))
    stray = strip(F.regexp_replace(before, _AROUND, ""))
    event = F.when(F.col("event") != "", F.concat("event", F.lit(_END))).otherwise("")
    rows = F.filter(F.array(stray, event), lambda x: x != "")
    return found.select(F.posexplode(rows).alias("at", "value"), *ORDER_COLUMNS).select(
        "value", "file", "block_start", (F.col("mid") * 2 + F.col("at")).alias("mid")
    )


def read_windows(
    spark: SparkSession, paths: Paths, layout: str = "any", files: Column | None = None
) -> DataFrame:
    """Windows events: ``xml`` (files or lines of events), ``json`` (arrays) or ``any``.

    ``any`` looks at the first character of each file, as part of the job: XML is read by event and JSON
    arrays by element, and so both are split, anything else by line, as JSON objects (an addition
    of ours: exports are arrays) or events. What is neither is a reject. Name the layout where it is known.
    """
    if layout == "xml":
        return windows_lines(scan_events(spark, paths, files))
    if layout == "json":
        return windows_json(json_elements(scan_documents(spark, paths, files)))
    if layout != "any":
        raise ValueError(f"Unknown layout '{layout}'. Available: any, json, xml")
    kinds = file_kinds(spark, paths, files)
    lines = scan_lines(spark, paths, files)
    objects = read_arrays(spark, paths, files, kinds).unionByName(of_kind(lines, kinds, "{"))
    events = of_kind(scan_events(spark, paths, files), kinds, "<")
    others = of_kind(lines, kinds, "<", "[", "{", others=True)
    return windows_lines(events.unionByName(others)).unionByName(windows_json(objects))
