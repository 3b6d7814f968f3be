"""JSON inputs: browser console exports, HTTP archives, Windows events as JSON.

Newline-delimited JSON is read by line. A file that holds an array is read in pieces that
end at a closing brace, by as many tasks as it has splits: each split says how many quotes
and brackets it has, sums over the splits of a file give the state at the start
of each, and so every piece knows whether it ends an element. Archives are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from logweir.functions.levels import (
    BROWSER_LEVELS,
    named_level,
    with_windows_event,
)
from logweir.functions.text import (
    BLANKS,
    header_value,
    safe_int,
    strip,
    text_of,
    url_path,
    with_captures,
)
from logweir.functions.times import iso_time, parse_time
from logweir.schema import ORDER_COLUMNS, to_entries
from logweir.sources.lines import Paths, scan_documents, scan_lines, scan_pieces

_BROWSER_SCHEMA = (
    "level string, message string, timestamp string, time string, url string, "
    "source string, line string, column string, stack string, _corrupt_record string"
)
_HAR_SCHEMA = (
    "log struct<entries: array<struct<startedDateTime: string, time: string, "
    "request: struct<method: string, url: string, "
    "headers: array<struct<name: string, value: string>>>, "
    "response: struct<status: bigint, bodySize: bigint, "
    "content: struct<mimeType: string>>>>>"
)


def _elements(documents: DataFrame, pieces: Column) -> DataFrame:
    """One row per piece of a document; the place in it becomes the line order."""
    return documents.select(
        F.posexplode(pieces).alias("at", "value"), *ORDER_COLUMNS
    ).select("value", "file", "block_start", F.col("at").cast("bigint").alias("mid"))


def file_kinds(spark: SparkSession, paths: Paths, files: Column | None = None) -> DataFrame:
    """(file, kind): the first character of each file that is not blank, one row per file."""
    first = F.min_by(F.substring(strip(F.col("value")), 1, 1), F.struct("block_start", "mid"))
    return scan_lines(spark, paths, files).groupBy("file").agg(first.alias("kind"))


def of_kind(rows: DataFrame, kinds: DataFrame, *marks: str, others: bool = False) -> DataFrame:
    """The rows of files that begin with one of the marks, or with ``others`` with none of them."""
    wanted = F.col("kind").isin(list(marks))
    return rows.join(kinds.where(~wanted if others else wanted), "file", "left_semi")


_OPEN, _SHUT = "[{", "]}"


def _depth_change(outside: Column) -> Column:
    """Brackets that open less brackets that close, in text without strings."""
    return F.length(F.translate(outside, _SHUT, "")) - F.length(F.translate(outside, _OPEN, ""))


def _measured_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces with ``odd`` (quotes, modulo 2) and their change of depth.

    ``down`` is the change if the split starts outside of a string, ``down_in`` if it starts in one; the
    brace behind the piece counts unless it is in a string.
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    rows = pieces.withColumn("plain", plain)
    quotes = F.length("plain") - F.length(F.replace(F.col("plain"), F.lit('"')))
    strings = r'"[^"]*(?:"|\z)'
    starts_out = F.regexp_replace("plain", strings, "")
    starts_in = F.regexp_replace(F.concat(F.lit('"'), F.col("plain")), strings, "")
    rows = rows.withColumn("odd", quotes % 2)
    rows = rows.withColumn("out", _depth_change(starts_out) - F.when(F.col("odd") == 0, 1).otherwise(0))
    rows = rows.withColumn("in", _depth_change(starts_in) - F.when(F.col("odd") == 1, 1).otherwise(0)).drop("plain")
    before = _within_split().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    return (
        rows.withColumn("down", F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("in")))
        .withColumn("down_in", F.when(F.col("inside") == 0, F.col("in")).otherwise(F.col("out")))
        .drop("out", "in")
    )


def _within_split() -> WindowSpec:
    return Window.partitionBy("file", "block_start").orderBy("mid")


def _earlier_splits() -> WindowSpec:
    """The splits of a file before one; a file has few."""
    return Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)


def _placed_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces with ``end`` (whether an element ends with them) and ``element``, its number in the file."""
    rows = _measured_pieces(pieces)
    splits = rows.groupBy("file", "block_start").agg(
        F.sum("odd").alias("odd"), F.sum("down").alias("down"), F.sum("down_in").alias("down_in"), F.max("mid").alias("last_mid")
    )
    sums = lambda c: F.coalesce(F.sum(c).over(_earlier_splits()), F.lit(0))
    splits = splits.withColumn("starts_in", sums("odd") % 2)
    splits = splits.withColumn("down", F.when(F.col("starts_in") == 0, F.col("down")).otherwise(F.col("down_in")))
    splits = splits.withColumn("depth", sums("down"))
    following = F.lead("block_start").over(Window.partitionBy("file").orderBy("block_start"))
    # What is behind the last brace of a file is no element.
    splits = splits.withColumn("last_mid", F.when(following.isNull(), F.col("last_mid")))
    rows = rows.join(splits.select("file", "block_start", "starts_in", "depth", "last_mid"), ["file", "block_start"])
    down = F.when(F.col("starts_in") == 0, F.col("down")).otherwise(F.col("down_in"))
    rows = rows.withColumn("down", down)
    after = F.col("depth") + F.sum("down").over(_within_split())
    outside = (F.col("starts_in") + F.col("inside") + F.col("odd")) % 2 == 0
    last = F.coalesce(F.col("mid") == F.col("last_mid"), F.lit(False))
    rows = rows.withColumn("last", last).withColumn("end", (outside & (after <= 1) & ~last).cast("int"))
    before = _within_split().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("element", F.coalesce(F.sum("end").over(before), F.lit(0)))
    rows = rows.select("file", "block_start", "mid", "value", "last", "end", "element")
    ends = rows.groupBy("file", "block_start").agg(F.sum("end").alias("ends"))
    ends = ends.select("file", "block_start", F.coalesce(F.sum("ends").over(_earlier_splits()), F.lit(0)).alias("base"))
    joined = rows.join(ends, ["file", "block_start"])
    return joined.withColumn("element", F.col("base") + F.col("element")).drop("base")


def array_elements(pieces: DataFrame) -> DataFrame:
    """The objects in JSON arrays, and the text between them, as rows.

    ``pieces`` end at closing braces (``scan_pieces``). An element is put together from its pieces,
    also across splits. What stands before an element and is no comma, bracket or blank
    is a row of its own, and so is what is left at the end of a file, such as an object that was cut off.
    """
    piece = F.struct("block_start", "mid", F.concat("value", F.when(F.col("last"), "").otherwise("}")).alias("text"))
    gathered = _placed_pieces(pieces).groupBy("file", "element").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "").alias("text"),
        F.max("end").alias("closed"),
        F.min("block_start").alias("block_start"),
        F.min_by("mid", F.struct("block_start", "mid")).alias("mid"),
    )
    gathered = with_captures(
        gathered,
        "object",
        F.when(F.col("closed") == 1, F.regexp_extract("text", r"(?s)\{.*", 0)).otherwise(""),
    )
    before = F.substring(F.col("text"), F.lit(1), F.length("text") - F.length("object"))
    stray = F.btrim(before, F.lit(BLANKS + "[],"))
    found = F.filter(F.array(stray, F.col("object")), lambda x: x != "")
    return gathered.select(F.posexplode(found).alias("at", "value"), *ORDER_COLUMNS).select(
        "value", "file", "block_start", (F.col("mid") * 2 + F.col("at")).alias("mid")
    )


def read_arrays(spark: SparkSession, paths: Paths, files: Column | None, kinds: DataFrame) -> DataFrame:
    """The elements of the files that begin with a bracket."""
    return array_elements(of_kind(scan_pieces(spark, paths, "}", files), kinds, "["))


def json_elements(documents: DataFrame) -> DataFrame:
    """Elements of a JSON array in each document, as JSON texts; others give no rows."""
    array = F.from_json("value", "array<string>")
    return _elements(documents, array)


def json_elements_or_lines(documents: DataFrame) -> DataFrame:
    """Elements of a JSON array, or the lines of a document that holds no array."""
    documents = with_captures(documents, "elements", F.from_json("value", "array<string>"))
    lines = F.split(F.col("value"), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1)
    rows = _elements(documents, F.coalesce(F.col("elements"), lines))
    return rows.where(strip(F.col("value")) != "")


def browser(lines: DataFrame) -> DataFrame:
    """Console messages, one JSON object per line; lines of another kind are dropped."""
    df = with_captures(lines, "log", F.from_json("value", _BROWSER_SCHEMA))
    log = F.col("log")

    def first_present(*names: str) -> Column:
        return F.coalesce(*(F.nullif(log[name], F.lit("")) for name in names))

    fields = {
        "source": F.lit("browser"),
        "raw": F.col("value"),
        "timestamp": iso_time(first_present("timestamp", "time")),
        "level": named_level(BROWSER_LEVELS, log["level"]),
        "path": first_present("url", "source"),
        "message": F.coalesce(log["message"], F.lit("")),
        "extra": F.create_map(
            *(x for name in ("line", "column", "stack") for x in (F.lit(name), log[name]))
        ),
    }
    parsed = log.isNotNull() & log["_corrupt_record"].isNull()
    return to_entries(df, parsed, fields)


def read_browser(
    spark: SparkSession, paths: Paths, layout: str = "auto", files: Column | None = None
) -> DataFrame:
    """Console exports: ``lines`` (one object each), ``document`` (array or lines) or ``auto``.

    ``auto`` looks at the first character of each file: one that opens an array is
    read by elements, and so split, any other by line. This is part of the job.
    """
    if layout == "lines":
        return browser(scan_lines(spark, paths, files))
    if layout == "document":
        return browser(json_elements_or_lines(scan_documents(spark, paths, files)))
    if layout != "auto":
        raise ValueError(f"Unknown layout '{layout}'. Available: auto, document, lines")
    kinds = file_kinds(spark, paths, files)
    lines = of_kind(scan_lines(spark, paths, files), kinds, "[", others=True)
    return browser(read_arrays(spark, paths, files, kinds).unionByName(lines))


def har(documents: DataFrame) -> DataFrame:
    """Request/response pairs of HTTP archives, one archive per row.

    A text that is no JSON fails the job: an archive is all or nothing.
    """
    archive = F.from_json("value", _HAR_SCHEMA, {"mode": "FAILFAST"})
    # The archive is one generated row first: it is parsed once, then unpacked.
    parsed = with_captures(documents, "archive", archive)
    df = parsed.select(
        F.posexplode(F.col("archive.log.entries")).alias("at", "pair"), "file", "block_start"
    ).select("pair", "file", "block_start", F.col("at").cast("bigint").alias("mid"))
    pair = F.col("pair")
    request, response = pair["request"], pair["response"]
    url = F.coalesce(request["url"], F.lit(""))
    status = F.coalesce(response["status"], F.lit(0))
    level = F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO")
    fields = {
        "source": F.lit("har"),
        "raw": url,
        "timestamp": parse_time(
            F.substring(pair["startedDateTime"], 1, 19), "%Y-%m-%dT%H:%M:%S"
        ),
        "level": level,
        "method": request["method"],
        "path": url_path(url),
        "status": F.when(status > 0, status),
        "size": F.when(response["bodySize"] >= 0, response["bodySize"]),
        "user_agent": header_value(request["headers"], "User-Agent"),
        "message": F.concat_ws(" ", text_of(request["method"]), url, status.cast("string")),
        "extra": F.create_map(
            F.lit("url"), url,
            F.lit("time_ms"), F.coalesce(pair["time"], F.lit("0")),
            F.lit("mime_type"), response["content"]["mimeType"],
        ),
    }
    return to_entries(df, pair.isNotNull(), fields)


def read_har(spark: SparkSession, paths: Paths, files: Column | None = None) -> DataFrame:
    return har(scan_documents(spark, paths, files))


def windows_json(lines: DataFrame) -> DataFrame:
    """Windows events, one JSON object per line; the whole object is kept in ``extra``."""
    df = with_captures(lines, "event", F.from_json("value", "map<string,string>"))
    event = F.col("event")
    df = df.withColumn("event_id", safe_int(F.element_at(event, "EventID")))
    df = with_windows_event(df, F.col("event_id"))
    when = F.coalesce(
        *(F.nullif(F.element_at(event, name), F.lit("")) for name in ("TimeCreated", "timestamp"))
    )
    fields = {
        "source": F.lit("windows_event"),
        "raw": F.col("value"),
        "timestamp": parse_time(F.substring(when, 1, 19), "%Y-%m-%dT%H:%M:%S"),
        "level": F.coalesce(F.col("known_level"), F.lit("INFO")),
        "message": windows_message(),
        "extra": event,
    }
    return to_entries(df, event.isNotNull() & (F.size(event) > 0), fields)


def windows_message() -> Column:
    return F.concat(
        F.lit("EventID "),
        text_of(F.col("event_id")),
        F.lit(": "),
        F.coalesce(F.col("description"), F.lit("Windows event")),
    )


def read_windows_json(spark: SparkSession, paths: Paths, files: Column | None = None) -> DataFrame:
    return windows_json(json_elements(scan_documents(spark, paths, files)))
