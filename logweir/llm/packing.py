"""Best-fit packing of documents into sequences of a fixed number of tokens.

Each task packs its pieces as they come with a bounded number of open bins. Which
free spaces have an open bin is one bitset: the best fit of a piece is the lowest
bit at or above its length, and the fullest bin, which closes first when too many are
open, is the lowest bit of all. What is left open at the end of a task is packed
again with that of other tasks, in fewer and fewer tasks, so that half-empty bins
remain in the last one only. Nothing but lengths and places is held in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import stored
from logweir.llm.tokens import encoder, vocabulary_path

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 512
#: Tasks whose open bins meet in one task of the next round.
FAN_IN = 8

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACES = "sequence_id bigint, offset bigint, open boolean"


class Packer:
    """Bounded-space online best fit: ``place`` gives (bin, offset) of a length."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.bins = 0, [[] for _ in range(capacity + 1)]
        self.count = self.made = 0

    def _take(self, free: int) -> int:
        """Any bin with that free space; it is no longer open."""
        bins = self.bins[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            into = self._take(free)
        else:
            if self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, into = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(into)
            self.bits |= 1 << left
            self.count += 1
        return into, self.capacity - free

    def still_open(self) -> set[int]:
        return {b for bins in self.bins for b in bins}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _packed(batches: Iterator[pa.RecordBatch], base: int, capacity: int, open_bins: int, schema: pa.Schema):
    """Batches of pieces with their places; only the places of a task are held."""
    packer = Packer(capacity, open_bins)
    base += TaskContext.get().partitionId() << 32
    held = []
    for batch in batches:
        places = [packer.place(n) for n in batch.column("length").to_pylist()]
        held.append((batch, places))
    left = packer.still_open()
    for batch, places in held:
        columns = [
            pa.array([base + b for b, _ in places], pa.int64()),
            pa.array([at for _, at in places], pa.int64()),
            pa.array([b in left for b, _ in places], pa.bool_()),
        ]
        own = [batch.column(n) for n in schema.names if n in batch.schema.names]
        yield pa.RecordBatch.from_arrays(own + columns, schema=schema)


def _schema() -> pa.Schema:
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    return pa.schema([*kinds, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(_schema())[:5])
    end = end_id.to_bytes(4, "little")
    encode = encoder(path).ids
    for batch in batches:
        rows = []
        for doc_id, text in zip(*batch.columns):
            doc_id, ids = doc_id.as_py(), encode(text.as_py() or "") + end
            for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def packed(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text and ``end_id``; a null text is empty and so
    one token long. Rows with a null or repeated doc_id are packed like others. No
    documents give no rows. Other columns are not looked at.
    """
    path = path or vocabulary_path()

    def first(batches):
        yield from _packed(_pieces(batches, path, capacity, end_id), 0, capacity, open_bins, _schema())

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    tasks = source.rdd.getNumPartitions()
    done = stored(source.mapInArrow(first, f"{PIECES}, {PLACES}"), "packed")
    rounds = [done]
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        base = len(rounds) << 56

        def again(batches, base=base):
            yield from _packed(batches, base, capacity, open_bins, _schema())

        rest = rounds[-1].where("open").drop("sequence_id", "offset", "open")
        # Order by hash: any other order would be as good, but it is the same when a task is repeated.
        order = F.xxhash64("doc_id", "piece", "ids_crc32")
        dealt = rest.repartition(tasks, order).sortWithinPartitions(order)
        rounds[-1] = rounds[-1].where("not open")
        rounds.append(stored(dealt.mapInArrow(again, f"{PIECES}, {PLACES}"), "packed"))
    whole = rounds[0]
    for more in rounds[1:]:
        whole = whole.unionByName(more)
    return whole.drop("open")


