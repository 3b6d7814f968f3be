"""Exact top-k inner products by three phases with a uniform threshold.

Vectors are cut into fragments of their components; a score is the sum of the
fragments' scores. First each fragment names its best candidates of each query, which are
scored in full: the k-th best of those is a score that the result reaches. This cutoff
is sent to all blocks. Then each fragment reports the entries above the uniform share of the
cutoff; a candidate that none reports cannot reach it. Of the reported, those that may still reach the
cutoff, by known parts and the share for unknown ones, are scored in full.

Queries and vectors meet in blocks: a task holds one block of each and multiplies them.
Blocks are packed into one row each, as the smallest integers that hold them. Sums of products
of doubles are exact below 2**53; vectors whose scores may go beyond are kept in blocks of their
own and multiplied as longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import stored

TOP = 20
FRAGMENTS = 2
#: Candidates that a fragment names of a block, for each that is wanted: more make a higher cutoff.
NAMED = 8
#: Vectors and queries of a block, components of one at most; queries that are multiplied at a time.
VECTOR_BLOCK, QUERY_BLOCK, ENTRIES, AT_ONCE = 8192, 2048, 1 << 22, 256
#: Tasks that the pairs of blocks are dealt to, at most.
TASKS = 1 << 16
SCALE = 64

#: Rows are numbered within their block, from its number times 2**_BLOCK_BITS on.
_BLOCK_BITS = 32
_EXACT = float(1 << 53)
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with floor(scale * x) for each component, without unfit vectors.

    A vector is unfit if it or its id is null, or it has a null or non-finite component.
    A component beyond a long takes the nearest long.
    """
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fit, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(x, lambda e: F.floor(e * float(scale)).cast("bigint")).alias("v"),
    )


def _packed(values: np.ndarray) -> tuple[str, bytes]:
    """(kind, bytes) of the smallest integers that hold the values."""
    low, high = values.min(initial=0), values.max(initial=0)
    kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, values.astype(f"<{kind}").tobytes()


def _blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
    """Rows of whole blocks: (name, dims, wide, ids, rows, kind, values); blocks by hash of the id.

    ``rows`` has a number of its own for each row, also of those that repeat an id. Wide
    vectors, whose products may be inexact as doubles, are apart.
    """
    names = [name, "dims", "wide", "ids", "rows", "kind", "values"]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.string(), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All rows of a block are in one task.
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            block, dims, wide = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            for key in sorted(set(zip(block.tolist(), dims.tolist(), wide.tolist()))):
                at = np.flatnonzero((block == key[0]) & (dims == key[1]) & (wide == key[2]))
                some = batch.take(pa.array(at))
                kind, values = _packed(some.column(4).flatten().to_numpy())
                numbers = (key[0] << _BLOCK_BITS) + np.arange(seen, seen + len(at), dtype=np.int64)
                seen += len(at)
                row = [*key, some.column(3).to_numpy().tobytes(), numbers.tobytes(), kind, values]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    most = F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))
    keyed = rows.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("block"),
        F.size("v").alias("dims"),
        F.coalesce(most * most * F.size("v") > _EXACT, F.lit(False)).alias("wide"),
        "vec_id",
        "v",
    )
    dealt = keyed.repartition(count, "block").sortWithinPartitions("block", "dims", "wide", "vec_id")
    schema = f"{name} int, dims int, wide boolean, ids binary, rows binary, kind string, values binary"
    return dealt.mapInArrow(pack, schema)


def _unpacked(wide, ids, rows, kind, values, dims: int) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray]:
    own, numbers = (np.frombuffer(x.as_py(), np.int64) for x in (ids, rows))
    v = np.frombuffer(values.as_py(), f"<{kind.as_py()}").reshape(len(own), dims)
    return wide.as_py(), own, numbers, v


def _cuts(dims: int, fragments: int) -> list[tuple[int, int]]:
    """Component ranges of the fragments; always as many, some may be empty."""
    at = [dims * k // fragments for k in range(fragments + 1)]
    return list(zip(at, at[1:]))


def _as_longs(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores as longs; a score beyond a long is the nearest long."""
    q, v = q.astype(np.int64), v.astype(np.int64)
    scores = q @ v.T
    near = q.astype(float) @ v.T.astype(float)
    for i, j in zip(*np.nonzero(np.abs(near) > 9.2e18)):
        exact = sum(a * b for a, b in zip(q[i].tolist(), v[j].tolist()))
        scores[i, j] = min(max(exact, _LOWEST), _HIGHEST)
    return scores


def _own(ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The candidates of a block, sorted by id, that are the query itself."""
    low, high = np.searchsorted(ids, queries, "left"), np.searchsorted(ids, queries, "right")
    for k in np.flatnonzero(high > low).tolist():
        yield k, slice(int(low[k]), int(high[k]))


def named(ids: np.ndarray, v: np.ndarray, queries: np.ndarray, q: np.ndarray, top: int, fragments: int, wide: bool):
    """Phase 1 in a block: (query's place, score) of the best of those that a fragment names."""
    if wide:
        parts = [_as_longs(q, v)]
        usual = [np.iinfo(np.int64).min]
    else:
        parts = [q[:, lo:hi].astype(float) @ v[:, lo:hi].T.astype(float) for lo, hi in _cuts(v.shape[1], fragments)]
        usual = [-np.inf] * len(parts)
    for part, lowest in zip(parts, usual):
        for k, some in _own(ids, queries):
            part[k, some] = lowest
    n = min(NAMED * top, len(ids))
    found = [np.argpartition(p, len(ids) - n, axis=1)[:, -n:] for p in parts]
    places = np.sort(np.concatenate(found, axis=1), axis=1)
    scores = sum(np.take_along_axis(p, places, axis=1) for p in parts)
    # A candidate that several fragments name is one; the query itself is none.
    once = np.concatenate([np.ones((len(q), 1), bool), np.diff(places, axis=1) > 0], axis=1)
    once &= ids[places] != queries[:, None]
    scores = np.where(once, scores, usual[0])
    n = min(top, scores.shape[1])
    at = np.argpartition(scores, scores.shape[1] - n, axis=1)[:, -n:]
    kept = np.take_along_axis(once, at, axis=1)
    rows = np.repeat(np.arange(len(q)), n).reshape(len(q), n)
    return rows[kept], np.take_along_axis(scores, at, axis=1)[kept].astype(np.int64)


def resolved(ids, v, queries, q, cutoffs: np.ndarray, fragments: int, wide: bool):
    """Phases 2 and 3 in a block: ((query's place, candidate's, score) from the cutoff on, scores that were resolved)."""
    if wide:
        scores = _as_longs(q, v)
        fit = scores >= cutoffs[:, None]
        for k, some in _own(ids, queries):
            fit[k, some] = False
        rows, found = np.nonzero(fit)
        return (rows, found, scores[rows, found]), scores.size
    # The share is rounded up: parts are whole numbers.
    share = np.array([-(-c // fragments) for c in cutoffs.tolist()], float)[:, None]
    cutoff = cutoffs.astype(float)[:, None]
    parts, reported, bound = [], None, None
    for lo, hi in _cuts(v.shape[1], fragments):
        part = q[:, lo:hi].astype(float) @ v[:, lo:hi].T.astype(float)
        for k, some in _own(ids, queries):
            part[k, some] = -np.inf
        over = part >= share
        reported = over if reported is None else reported | over
        # A part below the share is unknown, and may be as high as that.
        high = np.maximum(part, share)
        bound = high if bound is None else bound + high
        parts.append(part)
    rows, found = np.nonzero(reported & (bound >= cutoff))
    scores = sum(part[rows, found] for part in parts)
    fit = scores >= cutoff[rows, 0]
    return (rows[fit], found[fit], scores[fit].astype(np.int64)), len(rows)


def _met(batch: pa.RecordBatch, more: int):
    """Queries, some at a time, and vectors of each row of a batch, with the columns behind them."""
    for dims, *columns in zip(*batch.columns):
        dims, rest = dims.as_py(), columns[len(columns) - more :]
        q_wide, queries, q_rows, q = _unpacked(*columns[:5], dims)
        v_wide, ids, _, v = _unpacked(*columns[5:10], dims)
        for at in range(0, len(queries), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            yield q_wide or v_wide, queries[part], q_rows[part], q[part], ids, v, part, rest


def _leading(batches: Iterator[pa.RecordBatch], top: int, fragments: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for wide, queries, q_rows, q, ids, v, *_ in _met(batch, 0):
            rows, scores = named(ids, v, queries, q, top, fragments, wide)
            yield pa.RecordBatch.from_arrays([pa.array(q_rows[rows]), pa.array(scores)], names=["q_row", "score"])


def _above(batches: Iterator[pa.RecordBatch], top: int, fragments: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for wide, queries, q_rows, q, ids, v, _, (known, cutoffs) in _met(batch, 2):
            known, cutoffs = (np.frombuffer(x.as_py(), np.int64) for x in (known, cutoffs))
            # A query without named candidates has no cutoff, nor any candidate.
            at = np.minimum(np.searchsorted(known, q_rows), len(known) - 1)
            own = np.where(known[at] == q_rows, cutoffs[at], _LOWEST)
            (rows, found, scores), _ = resolved(ids, v, queries, q, own, fragments, wide)
            # Copies of one vector tie; a block names as many as the result can hold.
            order = np.lexsort((ids[found], _falling(scores), rows))
            rows, found, scores = rows[order], found[order], scores[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < top
            columns = [queries[rows[keep]], ids[found[keep]], scores[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _falling(scores: np.ndarray) -> np.ndarray:
    """Numbers that rise as the scores fall; the lowest long has no negative."""
    return ~scores


def _cutoffs(leading: DataFrame, top: int) -> DataFrame:
    """(q_block, known, cutoffs) of each block of queries: its rows in order, and the k-th best score of each."""
    best = Window.partitionBy("q_row").orderBy(F.desc("score"))
    placed = leading.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    kth = placed.groupBy("q_row").agg(F.max(F.when(F.col("place") == top, F.col("score"))).alias("cutoff"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs in zip(*batch.columns):
                rows = np.array(sorted((p["q_row"], p["cutoff"]) for p in pairs.as_py()), np.int64).reshape(-1, 2)
                values = [[block.as_py()], [rows[:, 0].tobytes()], [rows[:, 1].tobytes()]]
                arrays = [pa.array(x, k) for x, k in zip(values, (pa.int32(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["q_block", "known", "cutoffs"])

    # Fewer named candidates than wanted: there is no cutoff.
    pair = F.struct("q_row", F.coalesce("cutoff", F.lit(_LOWEST)).alias("cutoff"))
    by_block = kth.groupBy(F.shiftright("q_row", _BLOCK_BITS).cast("int").alias("q_block")).agg(F.collect_list(pair).alias("pairs"))
    return by_block.mapInArrow(told, "q_block int, known binary, cutoffs binary")


def top_scores(
    vectors: DataFrame,
    queries: DataFrame,
    top: int = TOP,
    fragments: int = FRAGMENTS,
    vector_block: int = VECTOR_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the best candidates of each query, itself left out.

    Both inputs have (vec_id, v) as ``whole_vectors`` gives them. Ties go to the
    smaller vec_id. Vectors of another number of components are no candidates.
    A query with fewer candidates gets them all. Rows that repeat a vec_id are
    candidates of their own, and a repeated query gets the best of all its rows' pairs.
    A score beyond a long counts as the nearest long. No queries or vectors give no rows.

    Every pair of blocks is multiplied, so time and what is sent grow with the
    product of queries and vectors.
    """
    size = lambda rows: rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    (n_vectors, dims), (n_queries, _) = size(vectors), size(queries)
    rows = lambda wanted: max(1, min(wanted, ENTRIES // max(dims, 1)))
    v_blocks, q_blocks = max(1, -(-n_vectors // rows(vector_block))), max(1, -(-n_queries // rows(query_block)))
    packed_v = stored(_blocks(vectors, v_blocks, "v_block"), "vectors")
    packed_q = stored(_blocks(queries, q_blocks, "q_block"), "queries")
    # Each block is listed with the numbers of its partners, and pairs are joined by them.
    pair = ["q_block", "v_block", "dims"]
    tasks = min(v_blocks * q_blocks, TASKS)
    columns = ["wide", "ids", "rows", "kind", "values"]
    of = lambda side: [F.col(c).alias(f"{side}_{c}") for c in columns]
    listed = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def met(asked: DataFrame, *more: str) -> DataFrame:
        left = asked.withColumn("v_block", listed(v_blocks)).select(*pair, *of("q"), *more)
        right = packed_v.withColumn("q_block", listed(q_blocks)).select(*pair, *of("v"))
        joined = left.repartition(tasks, *pair).join(right.repartition(tasks, *pair).hint("shuffle_hash"), pair)
        return joined.select("dims", *[f"{s}_{c}" for s in "qv" for c in columns], *more)

    def leading(batches):
        yield from _leading(batches, top, fragments)

    def above(batches):
        yield from _above(batches, top, fragments)

    first = stored(met(packed_q).mapInArrow(leading, "q_row bigint, score bigint"), "leading")
    # A query whose block pairs named nothing has no row here, and no candidates.
    told = packed_q.join(_cutoffs(first, top), "q_block")
    found = met(told, "known", "cutoffs").mapInArrow(above, "query_id bigint, vec_id bigint, score bigint")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
