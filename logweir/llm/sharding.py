"""Shards of nearly equal bytes, by ranges between sampled splitters.

Rows are ordered by a key and dealt to ranges whose boundaries are quantiles of a
sample drawn in proportion to size. The exact size of each range then gives each
row its place in the whole order, and the place gives the shard: the sample
decides how the work is spread, never where a row goes. A range that turned out
overfull is drawn from again and subdivided before any row is moved.

Each row weighs its bytes plus the mean, so that ranges are bounded in bytes and
in rows. The key's second part tells copies of a text apart, and a third one, a number, rows
that are equal, so that rows of any share of all cover as many ranges as they need.

Only one narrow row per record is shuffled, once, by range. The driver holds one
row per range and the samples, both bounded by ``max_ranges``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import stored

#: Bits of a draw: the fraction of a 53-bit number is exact as a double.
_DRAW = 2**53


def _numbers(values: list[int]) -> Column:
    """An array literal; folded once, when the query is optimized."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


#: The parts of a row's place in the whole order.
_ORDER = ["key", "tie", "row"]
Splitter = tuple[int, int, int]


def _range_of(splitters: list[Splitter]) -> Column:
    """Number of splitters that are not above (key, tie, row): a binary search."""
    if not splitters:
        return F.lit(0)
    keys, ties, numbers = (_numbers([s[k] for s in splitters]) for k in range(3))
    steps = [1 << b for b in range(len(splitters).bit_length() - 1, -1, -1)]

    def advance(low: Column, step: Column) -> Column:
        at = (low + step).cast("int")
        key, tie, number = (F.try_element_at(x, at) for x in (keys, ties, numbers))
        below = (tie < F.col("tie")) | ((tie == F.col("tie")) & (number <= F.col("row")))
        below = (key < F.col("key")) | ((key == F.col("key")) & below)
        return F.when((at <= len(splitters)) & below, at).otherwise(low)

    return F.aggregate(_numbers(steps), F.lit(0), advance)


def _draw(rows: DataFrame, share: Column, seed: int) -> list[tuple[Splitter, int]]:
    """(place, weight that it stands for), in order: a sample by weight."""
    u = F.shiftrightunsigned(F.xxhash64(*_ORDER, F.lit(seed)), 11) / F.lit(float(_DRAW))
    drawn = rows.withColumn("_share", share).where(u < F.col("_share"))
    stands = (F.col("weight") / F.least(F.col("_share"), F.lit(1.0))).cast("bigint")
    picked = drawn.select(*_ORDER, stands.alias("stands"))
    return sorted((tuple(r[:3]), r["stands"]) for r in picked.collect())


def _quantiles(sample: list[tuple[Splitter, int]], parts: int) -> list[Splitter]:
    """The parts - 1 places where the running weight passes a multiple of its share."""
    whole, running, passed, found = sum(s for _, s in sample), 0, 0, []
    for place, stands in sample:
        if running * parts // whole > passed:
            passed = running * parts // whole
            found.append(place)
        running += stands
    return found


def splitters_of(rows: DataFrame, ranges: int, per_range: int, weight: int, rounds: int = 4) -> tuple[list[Splitter], list]:
    """Splitters, and (bytes, rows) of each range between them.

    ``rows`` has key, tie, row, size, weight; no two rows are equal in the first three. Overfull is a range of
    more than twice its share; one that a further draw does not divide holds a single row.
    """
    target = max(weight // ranges, 1)
    share = F.col("weight") * F.lit(per_range * ranges / weight)
    found = _quantiles(_draw(rows, share, 0), ranges)
    for round_ in range(1, rounds + 1):
        counted = rows.groupBy(_range_of(found).alias("r")).agg(
            F.sum("size").alias("bytes"), F.count("*").alias("n"), F.sum("weight").alias("weight")
        )
        sizes = {r["r"]: r for r in counted.collect()}
        overfull = {r: row["weight"] for r, row in sizes.items() if row["weight"] > 2 * target}
        if not overfull or round_ == rounds:
            break
        place = _range_of(found)
        inside = rows.withColumn("r", place).where(F.col("r").isin(list(overfull)))
        sample = _draw(inside, F.col("weight") * F.lit(4 * per_range / target), round_)
        more = set(found)
        for r, heavy in overfull.items():
            low = found[r - 1] if r else None
            high = found[r] if r < len(found) else None
            own = [s for s in sample if (low is None or s[0] >= low) and (high is None or s[0] < high)]
            if own:
                more.update(_quantiles(own, -(-heavy // target)))
        if len(more) == len(found):
            break
        found = sorted(more)
    return found, [sizes.get(r) for r in range(len(found) + 1)]


def shards(
    docs: DataFrame,
    count: int = 16,
    key: Column | None = None,
    rows_per_range: int = 1_000_000,
    max_ranges: int = 4096,
    per_range: int = 32,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    The size is the UTF-8 bytes of the text plus one; a null text has none. A
    shard differs from an even share by less than two of the largest rows. ``slot``
    runs from 0 in each shard, in the order of (key, doc_id). The key is 60
    bits of the text's MD5 unless given: copies are neighbours. A null doc_id comes
    first. Rows equal in text and doc_id are interchangeable. No rows give none.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if key is None:
        key = F.conv(F.substring(F.md5(body.cast("binary")), 1, 15), 16, 10).cast("bigint")
    sized = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            key.alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sized",
    )
    sized = sized.withColumn("tie", F.coalesce("doc_id", F.lit(-(2**63))))
    total, n = sized.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return sized.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    mean = -(-total // n)
    rows = sized.withColumn("weight", F.col("size") + mean)
    ranges = max(128, min(max_ranges, n // rows_per_range))
    found, sizes = splitters_of(rows, ranges, per_range, total + n * mean)

    bytes_before, rows_before, b, c = [], [], 0, 0
    for row in sizes:
        bytes_before.append(b)
        rows_before.append(c)
        b, c = b + (row["bytes"] if row else 0), c + (row["n"] if row else 0)
    inside = Window.partitionBy("r").orderBy(*_ORDER)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (F.col("r") + 1).cast("int")
    placed = (
        sized.withColumn("r", _range_of(found))
        .withColumn("ends", F.sum("size").over(running))
        .withColumn("place", F.row_number().over(inside) - 1)
        .withColumn("middle", 2 * (F.element_at(_numbers(bytes_before), at) + F.col("ends")) - F.col("size"))
        .withColumn("place", F.element_at(_numbers(rows_before), at) + F.col("place"))
        .withColumn("shard", F.expr(f"cast(middle * {count} div {2 * total} as int)"))
    )
    # One row per shard; the window's shuffle is read a second time, not made again.
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
