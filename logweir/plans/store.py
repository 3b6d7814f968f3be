"""The stored table of entries: parse once, analyse often.

Entries and rejects are kept apart and entries lie by source and day, so that a
read of one source or of some days lists and opens only those folders. A write
is a load, the innermost folder.

Many small loads of a day are compacted into one. The compacted load is not visible until
a row in the list of compactions says which loads of which days it stands for; from then on those are not
visible. The row is one file, so a reader sees all of the change or nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.plans.shared import read_table
from logweir.schema import ENTRY_COLUMNS, ENTRY_SCHEMA, ORDER_COLUMNS, PARSED

_KIND, _ENTRIES, _REJECTS = "kind", "entries", "rejects"
_PARTITIONS = [_KIND, "source", "day", "load"]
_SCHEMA = T.StructType(
    [
        *ENTRY_SCHEMA,
        T.StructField("load", T.StringType()),
        T.StructField(_KIND, T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)


_COMPACTED = "compacted-"
_COMPACTIONS = "load string, days array<string>, replaced array<string>"


def write_tagged(
    tagged: DataFrame, table: str, compact: bool = True, load: str | None = None
) -> None:
    """Store entries and rejects in one pass over the input.

    Writing a named load again replaces it, so a job that was cut off can be
    repeated with the same input. Rows are shuffled to their folder first, for few
    and large files; a folder with much of the data is split over many tasks.
    Without ``compact`` each task writes into every folder that it has rows for.
    """
    rows = tagged.withColumn(
        _KIND, F.when(F.col(PARSED), _ENTRIES).otherwise(_REJECTS)
    ).withColumn("day", F.col("timestamp").cast("date"))
    if compact:
        rows = rows.hint("rebalance", *map(F.col, _PARTITIONS[:-1]))
    rows = rows.drop(PARSED).withColumn("load", F.lit(load or uuid.uuid4().hex))
    # Only the folders of this load are replaced.
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*_PARTITIONS).parquet(table)


def write_entries(entries: DataFrame, table: str, compact: bool = True) -> None:
    write_tagged(entries.withColumn(PARSED, F.lit(True)), table, compact)


def _compactions(spark: SparkSession, table: str) -> DataFrame:
    return read_table(spark, f"{table.rstrip('/')}/_compactions/log", _COMPACTIONS)


#: Stands for entries without a time, which have no day.
_NO_DAY = "none"


def _day_key() -> Column:
    return F.coalesce(F.col("day").cast("string"), F.lit(_NO_DAY))


def _visible(spark: SparkSession, table: str) -> Column:
    """A filter on folders: loads that no compaction stands for, and the compactions that are done.

    There is a row for each compaction.
    """
    done = _compactions(spark, table).collect()
    seen = ~F.col("load").startswith(_COMPACTED)
    if done:
        seen |= F.col("load").isin([r["load"] for r in done])
    for r in done:
        seen &= ~(_day_key().isin(r["days"]) & F.col("load").isin(r["replaced"]))
    return seen


def _read(spark: SparkSession, table: str, kind: str | None, load: str | None = None) -> DataFrame:
    rows = read_table(spark, table, _SCHEMA)
    rows = rows if kind is None else rows.where(F.col(_KIND) == kind)
    return rows.where(F.col("load") == load) if load else rows.where(_visible(spark, table))


def read_entries(spark: SparkSession, table: str, load: str | None = None) -> DataFrame:
    """The stored entries, with their ``day`` to select by; of one ``load`` if it is named."""
    return _read(spark, table, _ENTRIES, load).select(*ENTRY_COLUMNS, "day")


def read_rejects(spark: SparkSession, table: str) -> DataFrame:
    return _read(spark, table, _REJECTS).select("raw", *ORDER_COLUMNS)


def compact(spark: SparkSession, table: str, days: Iterable[str] | None = None, least: int = 2) -> str | None:
    """Rewrite days that lie in at least ``least`` loads into one load with few files.

    ``days`` are texts such as 2024-10-10, or ``none`` for entries without a time; without it all days. Name days
    that are over: a load that is being written meanwhile must not be of them. Readers
    see the old loads until all is written. Returns the new load, or None if there
    is nothing to do. The old files stay until ``drop_replaced``.
    """
    rows = _read(spark, table, None)
    keyed = rows.withColumn("key", _day_key())
    if days is not None:
        keyed = keyed.where(F.col("key").isin(list(days)))
    # Only folder names are read: a row for each day and load.
    found = keyed.groupBy("key").agg(F.collect_set("load").alias("loads")).where(F.size("loads") >= least).collect()
    if not found:
        return None
    chosen, loads = [r["key"] for r in found], sorted({x for r in found for x in r["loads"]})
    load = f"{_COMPACTED}{uuid.uuid4().hex}"
    part = keyed.where(F.col("key").isin(chosen) & F.col("load").isin(loads)).drop("key")
    few = part.hint("rebalance", *map(F.col, _PARTITIONS[:-1])).withColumn("load", F.lit(load))
    few.write.mode("append").partitionBy(*_PARTITIONS).parquet(table)
    row = spark.range(1).select(
        F.lit(load).alias("load"),
        F.lit(chosen).cast("array<string>").alias("days"),
        F.lit(loads).cast("array<string>").alias("replaced"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{table.rstrip('/')}/_compactions/log")
    return load


def drop_replaced(spark: SparkSession, table: str) -> int:
    """Delete the folders that compactions stand for; their number. No earlier read may still run."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(table)
    files = root.getFileSystem(conf)
    dropped = 0
    for r in _compactions(spark, table).collect():
        for day in r["days"]:
            name = "__HIVE_DEFAULT_PARTITION__" if day == _NO_DAY else day
            for folder in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{_KIND}=*/source=*/day={name}/load=*")):
                path = folder.getPath()
                if path.getName().removeprefix("load=") in r["replaced"]:
                    files.delete(path, True)
                    dropped += 1
    return dropped
