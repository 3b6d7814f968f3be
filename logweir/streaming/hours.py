"""Hours as they close: the timeline, spikes and brute force of a stream of landing files.

Facts per hour and IP are the state. After each batch the watermark is the latest time seen less a
delay; an hour that ends before it is closed and written once. Entries of closed hours that come
later go to a table of their own and change nothing. The state of a batch is made from
that of the batch before, and every folder is named after its batch, so a batch that is
repeated writes the same again. A batch's mark is written last: readers see whole batches.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logweir.functions import predicates as P
from logweir.functions.times import hour_bucket, hour_label
from logweir.operators.detections import BRUTE_FORCE_THRESHOLD, brute_force_of
from logweir.operators.facts import facts_by, regroup
from logweir.operators.temporal import spikes_of, timeline_of
from logweir.plans.shared import read_table, settled
from logweir.schema import ENTRY_COLUMNS, ENTRY_SCHEMA
from logweir.sources.registry import entries_of
from logweir.streaming.live import each_batch

_FACTS = (
    "hour timestamp_ntz, ip string, total bigint, level_errors bigint, warnings bigint, any_errors bigint, "
    "ssh_failures bigint, http_failures bigint, scan_hits bigint, bans bigint, first_time timestamp_ntz, "
    "last_time timestamp_ntz, batch bigint"
)
_HOUR = "INTERVAL '1' HOUR"


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, f"{path}/marks", "mark timestamp_ntz, batch bigint")


def _last(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, datetime | None]:
    """(batch, watermark) of the last whole batch, or of the last before one; -1 for none."""
    marks = _marks(spark, path)
    marks = marks if before is None else marks.where(F.col("batch") < before)
    last = marks.agg(F.max_by("mark", "batch").alias("mark"), F.max("batch").alias("batch")).first()
    return (-1, None) if last["batch"] is None else (last["batch"], last["mark"])


def _facts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return read_table(spark, f"{path}/{kind}", _FACTS)


def _ends_by(mark: datetime | None):
    """Whether an hour ends by the watermark."""
    end = F.col("hour") + F.expr(_HOUR)
    return F.lit(False) if mark is None else end <= F.lit(mark.isoformat()).cast("timestamp_ntz")


def start_hours(
    spark: SparkSession, directory: str, fmt: str, path: str, checkpoint: str, delay_minutes: int = 60, **options
) -> StreamingQuery:
    """Keep the hours of files that land in a directory under ``path``.

    ``delay_minutes`` is how far behind the latest time seen an entry may come. Entries without a time are left out.
    Format and options are those of ``each_batch``.
    """

    def store(tagged: DataFrame, number: int) -> None:
        session = tagged.sparkSession
        previous, mark = _last(session, path, number)
        timed = entries_of(tagged).where(P.has_time()).withColumn("hour", hour_bucket(F.col("timestamp")))
        closed = _ends_by(mark)
        late = timed.where(closed).select(ENTRY_COLUMNS)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        new = facts_by(timed.where(~closed).drop("hour"), "hour", "ip")
        kept = _facts(session, path, "open").where(F.col("batch") == previous).drop("batch")
        hours = settled(regroup(kept.unionByName(new), "hour", "ip"))
        latest = hours.agg((F.max("last_time") - F.expr(f"INTERVAL '{int(delay_minutes)}' MINUTE")).alias("mark")).first()["mark"]
        mark = max((m for m in (mark, latest) if m is not None), default=None)
        for kind, rows in (("hours", hours.where(_ends_by(mark))), ("open", hours.where(~_ends_by(mark)))):
            rows.write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        text = F.lit(None if mark is None else mark.isoformat()).cast("timestamp_ntz")
        session.range(1).select(text.alias("mark")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return each_batch(spark, directory, fmt, checkpoint, store, **options)


def closed_hours(spark: SparkSession, path: str) -> DataFrame:
    """Facts per hour and IP of the hours that are closed; they do not change any more."""
    batch, _ = _last(spark, path)
    return _facts(spark, path, "hours").where(F.col("batch") <= batch).drop("batch")


def open_hours(spark: SparkSession, path: str) -> DataFrame:
    """Facts per hour and IP of the hours that may still grow."""
    batch, _ = _last(spark, path)
    return _facts(spark, path, "open").where(F.col("batch") == batch).drop("batch")


def late_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries that came after their hour was closed."""
    batch, _ = _last(spark, path)
    rows = read_table(spark, f"{path}/late", T.StructType([*ENTRY_SCHEMA, T.StructField("batch", T.LongType())]))
    return rows.where(F.col("batch") <= batch).drop("batch")


def _by_hour(spark: SparkSession, path: str, unfinished: bool) -> DataFrame:
    hours = closed_hours(spark, path)
    hours = hours.unionByName(open_hours(spark, path)) if unfinished else hours
    return regroup(hours, "hour")


def live_timeline(spark: SparkSession, path: str, unfinished: bool = True) -> DataFrame:
    """The timeline of the closed hours and, if wanted, of those that may still grow."""
    return timeline_of(_by_hour(spark, path, unfinished))


def live_spikes(spark: SparkSession, path: str, unfinished: bool = False, **bounds) -> DataFrame:
    """Error spikes among the closed hours."""
    return spikes_of(_by_hour(spark, path, unfinished), **bounds)


def live_brute_force(spark: SparkSession, path: str, threshold: int = BRUTE_FORCE_THRESHOLD) -> DataFrame:
    """IPs with many failed logins within one closed hour: time, ip, type, count, severity."""
    hours = closed_hours(spark, path).where(P.has("ip"))
    # The hour goes along in the text that names the IP.
    found = brute_force_of(hours.withColumn("ip", F.concat(hour_label(F.col("hour")), F.lit("|"), "ip")), threshold)
    parts = F.split("ip", r"\|", 2)
    return found.select(parts[0].alias("time"), parts[1].alias("ip"), "type", "count", "severity")
