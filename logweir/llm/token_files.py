"""Token ids in binary files: independent zstandard frames and a seek table at the end.

A file holds one or more volumes. A volume is

    frames of ids | document table | seek table

Each document starts a frame of its own, and a long one has several, so that a reader
decompresses only the documents it is asked for. A frame is a whole zstandard stream of ids
as little-endian unsigned integers of 2 or 4 bytes. The document table (a skippable
frame) lists the documents of the volume; the seek table (a skippable frame too, in the
seekable format of zstandard) has for each frame its size, its size decompressed, and the
lower 32 bits of the XXH64 of its content. Plain zstandard tools can read such a file.

Texts are encoded and compressed where they lie; what is shuffled, to bring documents into
ascending order of their id, are compressed frames. Files are written by Spark's own
text writer, a volume as one record whose end mark is the seek table's magic number, so
they are committed like any table: a task that is repeated leaves nothing behind.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.common import stored
from logweir.llm.tokens import byte_vocabulary, encoder, vocabulary_path

END_ID = 2
#: Ids of a frame, at most: the memory a reader needs for one.
FRAME_IDS = 1 << 20
#: Compressed bytes after which a volume is closed, and that a file should have: a task that reads holds one file.
VOLUME_BYTES, FILE_BYTES = 8 << 20, 32 << 20
#: Decompressed bytes of a batch that a reader hands on.
BATCH_BYTES = 8 << 20
LEVEL = 3

# Fixed values of the seekable format.
_SKIPPABLE_DOCUMENTS, _SKIPPABLE_SEEK = 0x184D2A50, 0x184D2A5E
_SEEK_MAGIC = b"\xb1\xea\x92\x8f"
_CHECKSUMS = 0x80
_ENTRY = np.dtype([("size", "<u4"), ("content", "<u4"), ("check", "<u4")])

#: Of the document table: bytes of an id, the file's number, the volume's, documents, tokens.
_HEADER = struct.Struct("<IQQQQ")


class Damaged(ValueError):
    """A file does not hold what its seek table says."""


def _check(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


def frames_of(ids: bytes, width: int, compressor: zstandard.ZstdCompressor, frame_ids: int = FRAME_IDS):
    """(entries of the seek table, frames) of a document's ids, given as unsigned 32-bit integers."""
    numbers = np.frombuffer(ids, "<u4").astype(f"<u{width}")
    entries, frames = [], []
    for at in range(0, len(numbers), frame_ids):
        content = numbers[at : at + frame_ids].tobytes()
        frames.append(compressor.compress(content))
        entries.append((len(frames[-1]), len(content), _check(content)))
    return np.array(entries, _ENTRY).tobytes(), b"".join(frames)


def volume_of(documents: list[tuple[int | None, bytes, bytes]], width: int, file: int, volume: int) -> bytes:
    """A volume's bytes from (doc_id, entries, frames) in order."""
    entries = np.frombuffer(b"".join(e for _, e, _ in documents), _ENTRY)
    counts = np.array([len(e) // _ENTRY.itemsize for _, e, _ in documents], "<u4")
    known = np.array([d is not None for d, _, _ in documents], "u1")
    names = np.array([d or 0 for d, _, _ in documents], "<i8")
    tokens = int(entries["content"].sum(dtype=np.int64)) // width
    listed = _HEADER.pack(width, file, volume, len(documents), tokens) + known.tobytes() + names.tobytes() + counts.tobytes()
    listed = zstandard.ZstdCompressor(level=LEVEL).compress(listed)
    listed = struct.pack("<II", _SKIPPABLE_DOCUMENTS, len(listed)) + listed
    # The document table is a frame like others, of no content.
    last = np.array([(len(listed), 0, _check(b""))], _ENTRY).tobytes()
    footer = struct.pack("<IB", len(entries) + 1, _CHECKSUMS) + _SEEK_MAGIC
    table = entries.tobytes() + last + footer
    seek = struct.pack("<II", _SKIPPABLE_SEEK, len(table)) + table
    return b"".join([*(f for _, _, f in documents), listed, seek])


class Volume:
    """One volume, read from the end of a buffer; ``begin`` is where it starts."""

    def __init__(self, buffer: memoryview, name: str = ""):
        self.name = name
        if len(buffer) < 9 or bytes(buffer[-4:]) != _SEEK_MAGIC:
            raise Damaged(f"{name}: no seek table")
        n, _ = struct.unpack("<IB", buffer[-9:-4])
        size = n * _ENTRY.itemsize + 9
        seek = len(buffer) - size - 8
        if seek < 0 or struct.unpack("<II", buffer[seek : seek + 8]) != (_SKIPPABLE_SEEK, size):
            raise Damaged(f"{name}: a broken seek table")
        entries = np.frombuffer(buffer[seek + 8 : -9], _ENTRY)
        self.begin = seek - int(entries["size"].sum(dtype=np.int64))
        if self.begin < 0:
            raise Damaged(f"{name}: frames are missing")
        at = seek - int(entries["size"][-1])
        if struct.unpack("<I", buffer[at : at + 4])[0] != _SKIPPABLE_DOCUMENTS:
            raise Damaged(f"{name}: no document table")
        listed = zstandard.ZstdDecompressor().decompress(buffer[at + 8 : seek])
        self.width, self.file, self.volume, self.documents, self.tokens = _HEADER.unpack_from(listed)
        n, at = self.documents, _HEADER.size
        self.known = np.frombuffer(listed, "u1", n, at).astype(bool)
        self.ids = np.frombuffer(listed, "<i8", n, at + n)
        frames = np.frombuffer(listed, "<u4", n, at + 9 * n)
        self.first = np.concatenate([[0], np.cumsum(frames, dtype=np.int64)])
        self.entries = entries[:-1]
        self.at = self.begin + np.concatenate([[0], np.cumsum(self.entries["size"], dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.entries["content"], dtype=np.int64)])[self.first] // self.width
        self.buffer = buffer

    def read(self, k: int, decompressor: zstandard.ZstdDecompressor) -> bytes:
        """The ids of document k as little-endian unsigned 32-bit integers."""
        parts = []
        for f in range(self.first[k], self.first[k + 1]):
            content = decompressor.decompress(self.buffer[self.at[f] : self.at[f + 1]], int(self.entries["content"][f]))
            if len(content) != self.entries["content"][f] or _check(content) != self.entries["check"][f]:
                raise Damaged(f"{self.name}: frame {f} has another content than was written")
            parts.append(content)
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4").tobytes()


def volumes_of(content: bytes, name: str = "") -> list[Volume]:
    """The volumes of a file, in order."""
    found, rest = [], memoryview(content)
    while len(rest):
        found.append(Volume(rest, name))
        rest = rest[: found[-1].begin]
    return found[::-1]


_FRAMES = "doc_id bigint, n_tokens bigint, entries binary, frames binary"


def _encoded(docs: DataFrame, path: str, width: int, end_id: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(path).ids, end_id.to_bytes(4, "little")
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns):
                ids = ids_of(text.as_py() or "") + end
                rows.append((doc_id.as_py(), len(ids) // 4, *frames_of(ids, width, compressor)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "entries", "frames"])

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(encode, _FRAMES)


def _volumes(batches: Iterator[pa.RecordBatch], width: int, volume_bytes: int) -> Iterator[pa.RecordBatch]:
    """Volumes of the documents of a task, without the mark that the writer puts behind each."""
    file, volume = TaskContext.get().partitionId(), 0

    def closed(held):
        content = volume_of(held, width, file, volume)[: -len(_SEEK_MAGIC)]
        return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns):
            held.append(tuple(x.as_py() for x in row))
            size += len(held[-1][2])
            if size >= volume_bytes:
                yield closed(held)
                held, size, volume = [], 0, volume + 1
    if held:
        yield closed(held)


def write(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    end_id: int = END_ID,
    file_bytes: int = FILE_BYTES,
    volume_bytes: int = VOLUME_BYTES,
) -> None:
    """Encode whole texts and write them in ascending order of doc_id.

    ``folder/data`` gets the files, ``folder/volumes`` a row for each volume: path, file,
    volume, documents, tokens, first_id, last_id and start, the tokens of all before it.
    A null text is empty: its document is ``end_id`` alone. Documents without an id come
    last; those that repeat an id, next to each other by their content, so that equal rows
    may come in any order without the files changing. Other columns are not looked at. No
    documents give a folder without documents.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    ids, added = byte_vocabulary(path)
    width = 2 if max([end_id, *ids.values(), *added.values()]) < 1 << 16 else 4
    # The last part of the order divides rows that are equal, however many they are.
    keyed = _encoded(docs, path, width, end_id).withColumn("tie", F.xxhash64("frames"))
    encoded = stored(keyed.withColumn("row", F.monotonically_increasing_id()), "frames")
    total = encoded.agg(F.sum(F.length("frames"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    placed = encoded.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def volumes(batches):
        yield from _volumes(batches, width, volume_bytes)

    whole = placed.select("doc_id", "entries", "frames").mapInArrow(volumes, "content binary")
    (
        whole.select(F.col("content").cast("string"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", _SEEK_MAGIC.decode("latin-1"))
        .text(f"{folder}/data")
    )
    _with_starts(_listed(spark, f"{folder}/data")).write.parquet(f"{folder}/volumes")


_VOLUMES = "path string, file bigint, volume bigint, documents bigint, tokens bigint, first_id bigint, last_id bigint"


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each volume, from the tables at its end; no frame is decompressed."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                rows = []
                for v in volumes_of(content.as_buffer(), path.as_py()):
                    known = v.ids[v.known]
                    ends = (int(known[0]), int(known[-1])) if len(known) else (None, None)
                    rows.append((path.as_py(), v.file, v.volume, v.documents, v.tokens, *ends))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.string()] + [pa.int64()] * 6
                names = ["path", "file", "volume", "documents", "tokens", "first_id", "last_id"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return _files(spark, folder).mapInArrow(listed, _VOLUMES)


def _with_starts(volumes: DataFrame, files: int = 1024) -> DataFrame:
    """The volumes with the tokens before each: sums within groups of files, then over the groups."""
    grouped = stored(volumes.withColumn("part", F.floor(F.col("file") / files)), "volumes")
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each thousand files meets here.
    sums = grouped.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    base = sums.select("part", before(Window.orderBy("part")).alias("base"))
    within = grouped.withColumn("within", before(Window.partitionBy("part").orderBy("file", "volume")))
    return within.join(base, "part").withColumn("start", F.col("base") + F.col("within")).drop("part", "base", "within")


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each volume that was written."""
    return spark.read.parquet(f"{folder}/volumes")


def read(spark: SparkSession, folder: str, wanted: Iterable[int] | None = None) -> DataFrame:
    """One row for each document: doc_id, start, n_tokens, ids (binary, unsigned 32-bit integers).

    ``start`` is the number of ids of all documents before it. With ``wanted`` only files
    that may hold one of these ids are opened, and only their frames are decompressed;
    one path for each such file passes through the driver. A frame that does
    not meet its checksum fails the job.
    """
    known = volumes(spark, folder)
    paths: str | list[str] = f"{folder}/data"
    asked = None
    if wanted is not None:
        asked = np.unique(np.fromiter(wanted, np.int64))
        ids = F.lit(asked.tolist()).cast("array<bigint>")
        holding = known.where(F.exists(ids, lambda i: (i >= F.col("first_id")) & (i <= F.col("last_id"))))
        paths = [r["path"] for r in holding.select("path").distinct().collect()]
    columns = ["doc_id", "start", "n_tokens", "ids"]
    if wanted is not None and not paths:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()

        def made(rows):
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "volume", "doc_id", "within", "n_tokens", "ids"])

        rows, size = [], 0
        for batch in batches:
            for path, content in zip(*batch.columns):
                for v in volumes_of(content.as_buffer(), path.as_py()):
                    some = np.arange(v.documents)
                    if asked is not None:
                        some = some[v.known & np.isin(v.ids, asked)]
                    for k in some.tolist():
                        ids = v.read(k, decompressor)
                        name = int(v.ids[k]) if v.known[k] else None
                        rows.append((v.file, v.volume, name, int(v.starts[k]), len(ids) // 4, ids))
                        size += len(ids)
                        if size >= BATCH_BYTES:
                            yield made(rows)
                            rows, size = [], 0
        if rows:
            yield made(rows)

    schema = "file bigint, volume bigint, doc_id bigint, within bigint, n_tokens bigint, ids binary"
    found = _files(spark, paths).mapInArrow(documents, schema)
    placed = found.join(known.select("file", "volume", F.col("start").alias("base")), ["file", "volume"])
    return placed.withColumn("start", F.col("base") + F.col("within")).select(*columns)
