"""Text scans: lines, or whole files, with the columns that order them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.text import is_blank
from logweir.schema import ORDER_COLUMNS

Paths = str | Iterable[str]


def path_list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def literal_path(path: str) -> str:
    """The path of one file, with the characters that would make it a pattern escaped."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _placed(text: DataFrame) -> DataFrame:
    """Text with its file and the start of its split."""
    return text.select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def numbered(placed: DataFrame) -> DataFrame:
    """Add the position within the split; to be done at the scan.

    Later steps may filter and shuffle; the order columns still give the order
    in which the lines stand in their file.
    """
    return placed.withColumn("mid", F.monotonically_increasing_id())


def not_blank(lines: DataFrame) -> DataFrame:
    return lines.where(~is_blank(F.col("value")))


def _scan(
    spark: SparkSession, paths: Paths, files: Column | None, options: dict
) -> DataFrame:
    text = spark.read.text(path_list(paths), **options)
    if files is not None:
        text = text.where(files)
    return numbered(_placed(text))


def scan_lines(
    spark: SparkSession, paths: Paths, files: Column | None = None, **options
) -> DataFrame:
    """Non-blank lines of text files; invalid UTF-8 shows as U+FFFD.

    ``files`` filters on ``_metadata`` only, so files it excludes are never opened.
    """
    return not_blank(_scan(spark, paths, files, options))


def scan_pieces(spark: SparkSession, paths: Paths, end: str, files: Column | None = None) -> DataFrame:
    """Text files cut at each ``end``, which is left out; blank pieces are kept."""
    return _scan(spark, paths, files, {"lineSep": end})


def scan_documents(spark: SparkSession, paths: Paths, files: Column | None = None) -> DataFrame:
    """Whole files, one row each: a file has to fit the task that reads it."""
    return not_blank(_scan(spark, paths, files, {"wholetext": True}))


def stream_lines(spark: SparkSession, directory: str, **options: str) -> DataFrame:
    """Non-blank lines of files as they land in a directory.

    A file is read once, when it appears. A writer has to move finished segments
    in; lines appended later to a file already read are not seen. A stream gives
    no position within a split: ``mid`` is NULL.
    """
    text = spark.readStream.format("text").options(**options).load(directory)
    return not_blank(_placed(text).withColumn("mid", F.lit(None).cast("bigint")))


def lines_of(df: DataFrame, column: str = "value", order: str | Column | None = None) -> DataFrame:
    """Lines held in a column of any table or stream (a message value, say).

    ``order`` is a number that orders the lines, such as the offset of a message.
    Without it they are numbered as the partitions hold them; in a stream, which
    cannot be numbered, they have no position.
    """
    if order is not None:
        position = F.col(order) if isinstance(order, str) else order
    else:
        position = F.lit(None) if df.isStreaming else F.monotonically_increasing_id()
    named = df.select(
        F.make_valid_utf8(F.col(column).cast("string")).alias("value"),
        *(
            F.col(c) if c in df.columns else F.lit(default).alias(c)
            for c, default in (("file", ""), ("block_start", 0))
        ),
        position.cast("bigint").alias("mid"),
    )
    return not_blank(named.select("value", *ORDER_COLUMNS))
