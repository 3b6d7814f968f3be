"""The relations of the engine: log entries and stored runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One normalised log entry.
ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("raw", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        # Where the entry came from. Together these order all entries of a file.
        T.StructField("file", T.StringType()),
        T.StructField("block_start", T.LongType()),
        T.StructField("mid", T.LongType()),
    ]
)

ENTRY_COLUMNS = ENTRY_SCHEMA.fieldNames()

#: Columns that give a total order of the lines of one input.
ORDER_COLUMNS = ["file", "block_start", "mid"]

#: Marks whether the format understood a line; see ``sources.registry.read_tagged``.
PARSED = "parsed"

RUN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("target", T.StringType()),
        T.StructField("run_at", T.TimestampNTZType()),
        T.StructField("log_start", T.TimestampNTZType()),
        T.StructField("total", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("warnings", T.LongType()),
        T.StructField("error_rate", T.DoubleType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("result_json", T.StringType()),
    ]
)

_DEFAULTS = {"level": "INFO", "message": ""}


def empty_extra() -> Column:
    return F.create_map().cast("map<string,string>")


def to_entries(df: DataFrame, parsed: Column, fields: Mapping[str, Column]) -> DataFrame:
    """Project ``df`` to the entry schema, filling what ``fields`` leaves out.

    ``df`` carries the line order columns; ``parsed`` says whether the format
    accepted the line. Nothing is dropped here, so that one scan can feed both
    the entries and the rejects.
    """
    unknown = set(fields) - set(ENTRY_COLUMNS)
    if unknown:
        raise ValueError(f"Not entry fields: {', '.join(sorted(unknown))}")
    out = []
    for field in ENTRY_SCHEMA:
        if field.name in fields:
            value = fields[field.name]
        elif field.name in ORDER_COLUMNS:
            value = F.col(field.name)
        elif field.name == "extra":
            value = empty_extra()
        else:
            value = F.lit(_DEFAULTS.get(field.name))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out, F.coalesce(parsed, F.lit(False)).alias(PARSED))
