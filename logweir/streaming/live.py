"""Live logs: entries, alerts and display rows of what lands in a folder.

The same functions take a batch DataFrame, so a stream gives what a batch gives. A folder
of mixed files is one stream of their names: each batch of files is read as a batch read
would, by format, whole documents and files that are split included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweir.functions import predicates as P
from logweir.functions.display import time_label
from logweir.functions.text import present
from logweir.functions.times import iso_text
from logweir.plans.state import add_load
from logweir.plans.store import write_tagged
from logweir.schema import PARSED
from logweir.sources.lines import literal_path, stream_lines
from logweir.sources.registry import entries_of, line_format, read_tagged

# How much of a line is shown in place of a missing message, and
# of a line that is no entry.
MESSAGE_CHARS = 120
LINE_CHARS = 160


# The columns of a source of whole files.
_FILE = "path string, modificationTime timestamp, length bigint, content binary"

#: Files of a batch where nothing else is said; their names pass through the driver, which lists them anyway.
FILES_PER_BATCH = "1000"


def live_tagged(
    spark: SparkSession,
    directory: str,
    fmt: str,
    config: Mapping | None = None,
    source_options: Mapping[str, str] | None = None,
    **options,
) -> DataFrame:
    """Tagged entries of files of one line format as they land in a directory, as a stream.

    Rotation needs no care: a rotated segment is one more file. For mixed files and
    documents see ``each_batch``; for a file that grows see ``streaming.follow``.
    """
    return line_format(fmt, config, **options)(stream_lines(spark, directory, **(source_options or {})))


def each_batch(
    spark: SparkSession,
    directory: str,
    fmt: str,
    checkpoint: str,
    use: Callable[[DataFrame, int], None],
    config: Mapping | None = None,
    format_options: Mapping | None = None,
    source_options: Mapping[str, str] | None = None,
    **trigger,
) -> StreamingQuery:
    """Call ``use(tagged entries, batch number)`` for the files of each batch that lands.

    ``fmt`` is any format, or ``auto`` to take each file's from its name; then
    ``format_options`` holds keyword arguments by format name, else those of the format.
    ``source_options`` bound a batch: ``maxFilesPerTrigger`` (1000 unless it is given). A file is taken
    once, when it appears, so writers move finished files in. A batch that is
    repeated after a failure has the same files and number.
    """
    options = dict(format_options or {})
    options = options if fmt == "auto" else {fmt: options}
    bounds = {"maxFilesPerTrigger": FILES_PER_BATCH, **(source_options or {})}

    def read(batch: DataFrame, number: int) -> None:
        # Where a name looks like a pattern, the source may list files of the batch twice.
        names = [literal_path(r["path"]) for r in batch.select("path").distinct().collect()]
        if names:
            use(read_tagged(batch.sparkSession, names, fmt, config, options), number)

    # The content is not asked for, so no file is opened to learn its name.
    files = spark.readStream.format("binaryFile").schema(_FILE).options(**bounds).load(directory).select("path")
    return (
        files.writeStream.foreachBatch(read)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def alerts(entries: DataFrame) -> DataFrame:
    """Entries that are errors by level or status, as alert messages."""
    return entries.where(P.is_error()).select(
        "level", "source", "message", "ip", iso_text(F.col("timestamp")).alias("timestamp")
    )


def alert_payload(alert_rows: DataFrame) -> DataFrame:
    """Alerts as JSON texts in a ``value`` column, as message sinks take them."""
    return alert_rows.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    )


def display(tagged: DataFrame) -> DataFrame:
    """What a viewer shows per line: time, IP, status, level, text."""
    parsed = F.col(PARSED)
    line = F.col("raw")
    text = F.when(present(F.col("message")), F.col("message")).otherwise(
        F.substring(line, 1, MESSAGE_CHARS)
    )
    return tagged.select(
        F.when(parsed, time_label(F.col("timestamp"))).alias("time"),
        F.when(parsed & P.has("ip"), F.col("ip")).alias("ip"),
        F.when(parsed & P.has("status"), F.col("status")).alias("status"),
        F.when(parsed, F.col("level")).alias("level"),
        F.when(parsed, text).otherwise(F.substring(line, 1, LINE_CHARS)).alias("text"),
    )


def start_alerts(tagged: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write alert messages to text files, each alert once."""
    return (
        alert_payload(alerts(entries_of(tagged)))
        .writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start(path)
    )


def start_alert_files(
    spark: SparkSession, directory: str, fmt: str, path: str, checkpoint: str, **options
) -> StreamingQuery:
    """Write alert messages of files of any format, ``auto`` included, as text files in a folder for each batch.

    A repeated batch replaces its folder, so each alert is there once. Options as in ``each_batch``.
    """

    def store(tagged: DataFrame, number: int) -> None:
        payload = alert_payload(alerts(entries_of(tagged)))
        payload.write.mode("overwrite").text(f"{path}/batch={number}")

    return each_batch(spark, directory, fmt, checkpoint, store, **options)


def start_ingest(
    spark: SparkSession,
    directory: str,
    fmt: str,
    table: str,
    checkpoint: str,
    state: str | None = None,
    **options,
) -> StreamingQuery:
    """Take files that land in a directory into the stored table, each once.

    ``fmt`` and the options are those of ``each_batch``. Every batch is a load named after the
    stream and the batch; a batch that is repeated after a failure replaces its load. With
    ``state``, the aggregates of each load are kept there (``plans.state``).
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def store(tagged: DataFrame, number: int) -> None:
        load = f"{stream}-{number}"
        write_tagged(tagged, table, load=load)
        if state:
            add_load(tagged.sparkSession, table, state, load)

    return each_batch(spark, directory, fmt, checkpoint, store, **options)
