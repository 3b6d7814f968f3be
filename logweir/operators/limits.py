"""The last entries of each file, and the first entries of a run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLOT = "_slot"
_RANK = "_rank"
_FAN_IN = 64
_ROUNDS = 2


def _first_rows(df: DataFrame, n: int, order: list[Column], per: list[str]) -> DataFrame:
    """The first n rows per key in the given order, reduced in rounds.

    Each task keeps its own first n rows before anything is shuffled. They are
    then merged 64 tasks at a time: a key with most of the data never sends the
    rows of all tasks to a single one.
    """
    out = df.withColumn(_SLOT, F.spark_partition_id())
    for _ in range(_ROUNDS):
        out = out.withColumn(_SLOT, F.floor(F.col(_SLOT) / _FAN_IN))
        window = Window.partitionBy(*per, _SLOT).orderBy(*order)
        out = out.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) <= n)
        out = out.drop(_RANK)
    out = out.drop(_SLOT)
    if not per:
        return out.orderBy(*order).limit(n)
    window = Window.partitionBy(*per).orderBy(*order)
    return out.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) <= n).drop(_RANK)


def tail(entries: DataFrame, n: int, per: str = "file") -> DataFrame:
    """The last n entries of each file; lines that are no entries do not count."""
    return _first_rows(entries, n, [F.desc("block_start"), F.desc("mid")], [per])


def cap(entries: DataFrame, n: int, files: Iterable[str] | None = None) -> DataFrame:
    """The first n entries over all files, to be analysed instead of all.

    Files count in the order given, those not given last, or all by name. Entries are counted per split
    first: splits before the one that holds the n-th entry are kept as they are, and
    only within that one are entries ranked.
    """
    listed = list(files or [])
    place: Column = F.lit(0)
    if listed:
        given = F.array_position(F.array(*map(F.lit, listed)), F.col("file"))
        place = F.when(given > 0, given).otherwise(len(listed) + 1)
    split = F.struct(place.cast("bigint").alias("place"), F.col("file").alias("file"), F.col("block_start").alias("start"))
    counts = entries.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("count"))
    # One row per split of the input, however many entries it has.
    so_far = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("split"))
    reached = counts.withColumn("so_far", so_far).where(F.col("so_far") >= n)
    at = reached.agg(F.min(F.struct("split", "count", "so_far")).alias("at"))
    last = at.select("at.split").scalar()
    wanted = at.select(F.lit(n) - (F.col("at.so_far") - F.col("at.count"))).scalar()
    whole = entries.where(last.isNull() | (split < last))
    inside = _first_rows(entries.where(split == last), n, [F.col("mid")], ["file"])
    rank = F.row_number().over(Window.partitionBy("file").orderBy("mid"))
    inside = inside.withColumn(_RANK, rank).where(F.col(_RANK) <= wanted).drop(_RANK)
    return whole.unionByName(inside)
