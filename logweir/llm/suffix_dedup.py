"""Removal of long byte strings that occur more than once, by induced suffix sorting.

Sorted suffixes with their common prefixes tell which strings occur twice. Few
suffixes have to be compared for that: anchors are chosen by content (the least hash
of a gram in a sliding window), so that every string of the full length holds one, at
the same place wherever the string occurs. The suffixes at anchors seed the order;
a suffix that starts further left is induced from the one that it extends, by its first
byte and that one's rank, and its common prefix from theirs. Tuples of rank, byte and
common prefix go from queue to queue, one queue a step, all anchors at once.

Groups of one anchor are independent, so shards are ranges of anchors. The seeds
come in order from an external sort; the queues of a shard are arrays in memory up to
``QUEUE_ROWS`` tuples and files beyond, so that one anchor may hold any number of them.
Only anchors that occur twice are looked at, and of equal surroundings one is.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from logweir.llm.common import free_name, stored

LENGTH = 200
#: Bytes of an anchor; a string of LENGTH bytes has REACH + 1 places for one.
GRAM = 65
REACH = LENGTH - GRAM
#: Texts are hashed in blocks of so many bytes, which overlap by two strings.
BLOCK = 1 << 20
#: Tuples of a shard's queue that are held in memory.
QUEUE_ROWS = 1 << 20
#: Marks what lies beyond a text's ends; no UTF-8 text holds this byte.
BEYOND = 0xFF

_MIX1, _MIX2, _BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
_random = np.random.default_rng(3)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK + 2 * LENGTH + 1, np.uint64(base))
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, pick: np.ufunc, neutral: int) -> np.ndarray:
    """pick over each run of so many neighbours: from running picks of blocks, both ways."""
    n = len(x)
    padded = np.full(-(-n // width) * width, neutral, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def _block_anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE.take(raw) * _UP[: len(raw)], out=sums[1:])
    n = len(raw) - GRAM + 1
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[:n])
    width = REACH + 1
    least = _sliding(grams, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    # A gram is an anchor if it is the least of some window, equal ones included.
    at = np.flatnonzero(_sliding(around, width, np.maximum, 0) == grams)
    low, high = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, len(raw))
    surroundings = _mixed((sums[high] - sums[low]) * _DOWN[low])
    ends = ((at - low) * (LENGTH + 1) + (high - at)).astype(np.uint64)
    return at, np.stack([grams[at], _mixed(surroundings + ends)])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes of the anchors, hashes of all that a string with the anchor can hold)."""
    if len(raw) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    if len(raw) <= BLOCK + 2 * LENGTH:
        at, hashes = _block_anchors(raw)
        return at, hashes[0], hashes[1]
    places, found = [], []
    for start in range(0, len(raw), BLOCK):
        # Each block sees a string's length on both sides, and reports its own places.
        low, high = max(start - LENGTH, 0), min(start + BLOCK + LENGTH, len(raw))
        if high - low < LENGTH:
            low = max(0, high - LENGTH)
        at, hashes = _block_anchors(raw[low:high])
        own = (at + low >= start) & (at + low < start + BLOCK)
        places.append(at[own] + low)
        found.append(hashes[:, own])
    hashes = np.concatenate(found, axis=1)
    return np.concatenate(places), hashes[0], hashes[1]


def _queue(rows: int, kind, folder: str | None) -> np.ndarray:
    """An array for a shard's tuples: in memory, or in a file that ends with it."""
    if rows <= QUEUE_ROWS:
        return np.empty(rows, kind)
    with tempfile.TemporaryFile(dir=folder) as file:
        return np.memmap(file, kind, "w+", shape=(rows,))


def induced(groups: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which strings occur twice: row i, step d is the string that starts d bytes before anchor i.

    ``groups`` tells anchors apart and is in order; ``right`` has the REACH bytes after
    an anchor, ``left`` those before it, the nearest first. Within a group rows are
    in the order of ``right``.
    """
    n = len(groups)
    twice = np.zeros((n, REACH + 1), bool)
    if n < 2:
        return twice
    ids = np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]]))
    order, common = _queue(n, np.int64, None), _queue(n, np.int16, None)
    order[:] = np.arange(n)
    # Common prefix of each seed with the one before it in its group.
    common[0] = 0
    differ = right[1:] != right[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), REACH)
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    common[first] = -1
    many = int(ids[-1]) >= 1 << 16
    for d in range(REACH + 1):
        if d:
            own = left[order, d - 1]
            # The queue of this step: by group, then byte, then rank in the step before.
            by_byte = np.argsort(own, kind="stable")
            group = ids[order[by_byte]]
            into = by_byte[np.argsort(group if many else group.astype(np.uint16), kind="stable")]
            byte, group = own[into], ids[order[into]]
            same = np.concatenate([[False], (byte[1:] == byte[:-1]) & (group[1:] == group[:-1])])
            # What a tuple has in common with the next of its byte: the least between them.
            between = _least_between(common, into, same)
            common[:] = np.where(same, between + 1, np.where(np.concatenate([[True], group[1:] != group[:-1]]), -1, 0))
            order[:] = order[into]
        full = common >= REACH
        full[:-1] |= full[1:]
        twice[order[full], d] = True
    return twice


def _least_between(common: np.ndarray, into: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Least of common[into[k - 1] + 1 .. into[k]] for each k where ``same``."""
    found = np.zeros(len(into), common.dtype)
    k = np.flatnonzero(same)
    if not len(k):
        return found
    low, high = into[k - 1] + 1, into[k]
    # Ranges by a table of least values over runs of doubled lengths, as far as needed.
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    table = np.asarray(common)
    for power in range(int(level.max()) + 1):
        now = level == power
        if now.any():
            width = 1 << power
            found[k[now]] = np.minimum(table[low[now]], table[high[now] - width + 1])
        if power < int(level.max()):
            table = np.minimum(table[: len(table) - (1 << power)], table[1 << power :])
    return found


def spans(twice: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first step, last step) of each run of steps."""
    edges = np.diff(np.pad(twice.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    _, ends = np.nonzero(edges == -1)
    return zip(rows.tolist(), starts.tolist(), (ends - 1).tolist())


def _raw(text) -> bytes:
    value = text.as_py()
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for text in batch.column(1):
            raw = _raw(text)
            at, gram, around = anchors(np.frombuffer(raw, np.uint8))
            values = (row, len(raw), hashlib.sha256(raw).hexdigest(), at, gram.view(np.int64), around.view(np.int64))
            for column, value in zip(columns, values):
                column.append(value)
            row += 1
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "row", "n_bytes", "sha", "at", "gram", "around"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each wanted anchor of a text: what lies right and left of it."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        for text, row, wanted in zip(*batch.columns):
            raw = _raw(text)
            beyond = bytes([BEYOND]) * REACH
            padded = beyond + raw + beyond
            for one in wanted.as_py():
                at = one["at"] + REACH
                right = padded[at + GRAM : at + LENGTH]
                for column, value in zip(columns, (one["gram"], row.as_py(), one["at"], padded[at - REACH : at][::-1], right)):
                    column.append(value)
            if len(columns[0]) >= 20_000:
                yield _context_batch(columns)
                columns = [[] for _ in range(5)]
        yield _context_batch(columns)


def _context_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["gram", "row", "at", "left", "right"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REACH)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of texts whose strings occur twice, from contexts in order of (gram, right).

    Whole groups are sorted together, some ten thousand rows at a time.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= 40_000:
            table = pa.Table.from_batches(held).combine_chunks()
            gram = table.column("gram").to_numpy()
            last = int(np.searchsorted(gram, gram[-1]))
            if last:
                yield _sorted_spans(table.slice(0, last))
                held = table.slice(last).to_batches()
    if held:
        yield _sorted_spans(pa.Table.from_batches(held))


def _sorted_spans(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    left, right = (_matrix(table.column(c).combine_chunks()) for c in ("left", "right"))
    row, at = table.column("row").to_numpy(), table.column("at").to_numpy()
    twice = induced(table.column("gram").to_numpy(), left, right)
    # A string that reaches beyond its text is none.
    before, after = (left != BEYOND).sum(axis=1), (right != BEYOND).sum(axis=1)
    steps = np.arange(REACH + 1)
    twice &= (steps <= before[:, None]) & (REACH - steps <= after[:, None])
    found = [(int(row[i]), int(at[i]) - hi, int(at[i]) - lo + LENGTH) for i, lo, hi in spans(twice)]
    columns = list(zip(*found)) if found else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "lo", "hi"])


def _merged(intervals):
    """Overlapping or touching intervals of an array made one; SQL functions only."""
    ordered = F.array_sort(intervals)
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def add(done, one):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], one["hi"]).alias("hi"))),
        )
        return F.when((F.size(done) > 0) & (one["lo"] <= last["hi"]), joined).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(ordered, empty, add)


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): one row per document (doc_id, row, n_bytes, sha) and its repeated spans.

    ``spans`` has row and ``intervals``, merged [lo, hi) in bytes, for rows that have any.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, row bigint, n_bytes bigint, sha string, at array<bigint>, gram array<bigint>, around array<bigint>"
    rows = stored(texts.mapInArrow(_anchored, schema), "anchored")
    each = rows.select("row", "n_bytes", F.explode(F.arrays_zip("at", "gram", "around")).alias("a")).select(
        "row", "n_bytes", "a.at", "a.gram", "a.around"
    )
    of_gram, of_around = Window.partitionBy("gram"), Window.partitionBy("gram", "around")
    counted = (
        each.withColumn("n", F.count("*").over(of_gram))
        .where("n > 1")
        .withColumn("same", F.count("*").over(of_around))
        .withColumn("turn", F.row_number().over(of_around.orderBy("row", "at")))
    )
    doubled = stored(counted, "doubled")
    # Equal surroundings: all strings in them occur twice.
    inside = (
        doubled.where("same > 1")
        .select("row", F.greatest(F.col("at") - REACH, F.lit(0)).alias("lo"), F.least(F.col("at") + LENGTH, "n_bytes").alias("hi"))
        .where(F.col("hi") - F.col("lo") >= LENGTH)
    )
    # Of the rest, and of each of those, one is compared.
    wanted = (
        doubled.where("turn = 1 and n > same")
        .groupBy("row")
        .agg(F.collect_list(F.struct("gram", "at")).alias("wanted"))
        .join(rows.select("row", "doc_id", "sha"), "row")
    )
    # Rows equal in id and text are one here, by the same row number everywhere.
    named = texts.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).dropna(subset=["text"])
    with_text = wanted.join(named, (wanted["doc_id"].eqNullSafe(named["doc_id"])) & (wanted["sha"] == named["sha"]))
    one_text = with_text.select("text", wanted["row"].alias("row"), "wanted").dropDuplicates(["row"])
    contexts = one_text.mapInArrow(_contexts, "gram bigint, row bigint, at bigint, left binary, right binary")
    shards = contexts.repartition("gram").sortWithinPartitions("gram", "right")
    edges = shards.mapInArrow(_shard, "row bigint, lo bigint, hi bigint")
    merged = inside.unionByName(edges).groupBy("row").agg(_merged(F.collect_set(F.struct("lo", "hi"))).alias("intervals"))
    return rows.select("doc_id", "row", "n_bytes", "sha"), stored(merged, "intervals")


def _cut(text: pa.Array, intervals: pa.Array) -> list[bytes]:
    found = []
    for one, gone in zip(text, intervals):
        raw, at, parts = _raw(one), 0, []
        for span in gone.as_py() or []:
            parts.append(raw[at : span["lo"]])
            at = span["hi"]
        found.append(b"".join([*parts, raw[at:]]))
    return found


@F.arrow_udf(StringType())
def _digest_of_rest(text: pa.Array, intervals: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(b).hexdigest() for b in _cut(text, intervals)], pa.string())


@F.arrow_udf(StringType())
def _rest(text: pa.Array, intervals: pa.Array) -> pa.Array:
    return pa.array([b.decode("utf-8", "replace") for b in _cut(text, intervals)], pa.string())


def removals(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. Rows with a null or repeated doc_id are documents of their
    own; equal texts repeat each other. No documents give no rows.
    """
    rows, found = repeated(docs)
    joined = rows.join(found, "row", "left")
    removed = F.coalesce(F.aggregate("intervals", F.lit(0).cast("bigint"), lambda n, x: n + x["hi"] - x["lo"]), F.lit(0))
    joined = joined.select(
        "doc_id", "sha", "n_bytes", removed.cast("bigint").alias("n_removed"),
        F.coalesce(F.size("intervals"), F.lit(0)).cast("bigint").alias("n_spans"), "intervals",
    )
    joined = stored(joined.withColumn("n_spans", F.greatest("n_spans", F.lit(0).cast("bigint"))), "removed")
    plain = F.when(F.col("n_removed") == 0, F.col("sha")).when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(b""), 256))
    done = joined.where((F.col("n_removed") == 0) | (F.col("n_removed") == F.col("n_bytes")))
    part = joined.where((F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_bytes")))
    # Only texts that lose a part are needed, once each: equal ones lose the same part or all.
    once = part.groupBy("doc_id", "sha", "n_bytes", "n_removed", "n_spans").agg(F.first("intervals").alias("intervals"), F.count("*").alias("copies"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("_sha", F.sha2(F.col("text").cast("binary"), 256))
    cut = once.join(texts, once["doc_id"].eqNullSafe(texts["_id"]) & (once["sha"] == texts["_sha"]))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans"]
    return done.select(*columns, plain.alias("kept_sha256")).unionByName(
        cut.select(*columns, _digest_of_rest("text", "intervals").alias("kept_sha256"))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without the bytes that repeat, with the columns they came with.

    Texts that nothing is left of stay as empty ones; where there is an ``n_chars``, it
    follows the text. A character of which some bytes
    are removed becomes the replacement character. A null text stays null.
    """
    rows, found = repeated(docs)
    own, sha, gone = (free_name(docs, n) for n in ("_own", "_sha", "_gone"))
    each = rows.join(found, "row").groupBy("doc_id", "sha").agg(F.first("intervals").alias(gone))
    each = each.withColumnsRenamed({"doc_id": own, "sha": sha})
    named = docs.withColumn(free_name(docs, "_of"), F.sha2(F.col("text").cast("binary"), 256))
    of = named.columns[-1]
    joined = named.join(each, named["doc_id"].cast("bigint").eqNullSafe(each[own]) & (named[of] == each[sha]), "left")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_rest(F.col("text").cast("string"), F.col(gone)))
    joined = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return joined.select(*docs.columns)
