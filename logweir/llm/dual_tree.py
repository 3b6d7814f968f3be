"""Ranked lexical search by two trees, over items and over documents.

A document's coordinate for a term is the score that the term gives to any item that
has it. A node of documents holds the largest coordinates of its documents, a node of
items all terms of its items; the sum of the former over the latter is a bound for every
pair of the two nodes. Pairs of nodes whose bound does not reach the weakest k-th score
among their items are left out whole; what is left is scored in full at the leaves.

Items are taken in blocks whose trees every task gets; documents are read once to turn
them into counts of the block's terms, and from then on only those counts are read. A
task builds trees over some documents at a time and carries the items' best scores from
one to the next, so that bounds prune more and more. Each task names at most k
documents for an item; these are merged in two steps.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import stored

TOP = 10
#: Items of a block, and entries (documents times terms) of a dense part of the documents.
ITEM_BLOCK, ENTRIES = 512, 1 << 20
#: Documents and items of a leaf; documents of a tree at most.
DOC_LEAF, ITEM_LEAF, TREE = 16, 8, 1024
#: Groups that the tasks' lists are merged in first.
MERGED = 256

# Fixed values of the score.
_TF, _TF_SCALE, _M_SCALE, _PLAIN, _LENGTH = 1_000_000_000, 1000, 8, 10, 90

#: Bytes as they count: letters and digits in lower case, all else below 0x80 a space.
_FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order: runs of letters, digits and all from U+0080 on; A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def _halves(owners: np.ndarray, terms: np.ndarray, n: int, weight: np.ndarray, leaf: int) -> tuple[np.ndarray, "Node"]:
    """(order of 0..n-1, tree) of a set of sparse rows given as (owner, term) entries.

    A node is split by the term that, by its weight, tells the most rows apart.
    """
    order: list[np.ndarray] = []

    def split(rows: np.ndarray, owners: np.ndarray, terms: np.ndarray, at: int) -> Node:
        if len(rows) <= leaf:
            order.append(rows)
            return Node(at, at + len(rows), ())
        counts = np.bincount(terms, minlength=len(weight))
        gain = weight * np.minimum(counts, len(rows) - counts)
        has = np.zeros(n, bool)
        has[owners[terms == int(gain.argmax())]] = True
        ordered = np.concatenate([rows[has[rows]], rows[~has[rows]]])
        # Splits that part less than a leaf become one in the middle, which bounds the depth.
        cut = int(has[rows].sum())
        cut = cut if min(cut, len(rows) - cut) >= min(leaf, len(rows) // 4) else len(rows) // 2
        first = np.zeros(n, bool)
        first[ordered[:cut]] = True
        own = first[owners]
        left = split(ordered[:cut], owners[own], terms[own], at)
        right = split(ordered[cut:], owners[~own], terms[~own], left.hi)
        return Node(at, right.hi, (left, right))

    tree = split(np.arange(n), owners, terms, 0) if n else Node(0, 0, ())
    return np.concatenate(order) if order else np.empty(0, np.int64), tree


@dataclass
class Node:
    """Rows lo to hi in the tree's order, with what bounds them."""

    lo: int
    hi: int
    children: tuple["Node", ...]
    terms: np.ndarray | None = None
    most: np.ndarray | None = None
    least: int = 0
    matrix: np.ndarray | None = None


class ItemTree:
    """A block of items: (row, terms) of each, as numbers of the block's vocabulary."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weight: np.ndarray, leaf: int = ITEM_LEAF):
        owners = np.repeat(np.arange(len(items)), [len(t) for _, t in items])
        terms = np.concatenate([t for _, t in items]) if items else np.empty(0, np.int64)
        order, self.root = _halves(owners, terms, len(items), weight, leaf)
        self.rows = [items[k][0] for k in order.tolist()]
        own = [items[k][1] for k in order.tolist()]

        def filled(node: Node) -> None:
            node.terms = np.unique(np.concatenate(own[node.lo : node.hi] or [np.empty(0, np.int64)]))
            for child in node.children:
                filled(child)
            if not node.children:
                node.matrix = np.stack([np.isin(node.terms, t) for t in own[node.lo : node.hi]], axis=1).astype(float)

        if items:
            filled(self.root)
        self.most_terms = max((len(t) for t in own), default=0)


class Search:
    """The best documents of each item of a block, over the documents it is shown."""

    def __init__(self, items: ItemTree, weight: np.ndarray, documents: int, length: int, top: int):
        self.items, self.weight, self.top = items, weight, top
        self.documents, self.length = documents, length
        # Scores are whole; sums of doubles are exact below 2**53, else longs are summed.
        exact = int(weight.max(initial=0)) * (_TF // _TF_SCALE) * max(items.most_terms, 1) < 1 << 53
        self.kind = np.float64 if exact else np.int64
        n = len(items.rows)
        self.best: list[list[tuple]] = [[] for _ in range(n)]
        # The k-th score of each item, and the place of its document among those of equal score.
        self.kth, self.kth_id = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).min)
        self.scored = 0

    def _coordinates(self, n: np.ndarray, owners: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        if int(n.max()) * self.documents * _LENGTH < 1 << 63:
            m = _PLAIN + (_LENGTH * n * self.documents) // self.length
        else:
            m = np.array([_PLAIN + (_LENGTH * x * self.documents) // self.length for x in n.tolist()], np.int64)
        tf = tf.astype(np.int64)
        return self.weight[terms] * ((_TF * tf) // (_TF_SCALE * tf + _M_SCALE * m[owners]))

    def show(self, ids: list[int | None], n: np.ndarray, owners: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """Documents by id and length, with (owner, term, occurrences) entries."""
        if not len(ids) or not len(terms) or not self.items.rows:
            return
        order, root = _halves(owners, terms, len(ids), self.weight, DOC_LEAF)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        dense = np.zeros((len(ids), len(self.weight)), self.kind)
        dense[place[owners], terms] = self._coordinates(n, owners, terms, tf)
        ids = [ids[k] for k in order.tolist()]
        # A null id comes after all others.
        named = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)

        def filled(node: Node) -> None:
            for child in node.children:
                filled(child)
            node.least = int(named[node.lo : node.hi].min())
            parts = [c.most for c in node.children]
            node.most = np.maximum(*parts) if parts else dense[node.lo : node.hi].max(axis=0)

        filled(root)
        self._visit(root, self.items.root, self._bound(root, self.items.root), dense, ids, named)

    def _bound(self, docs: Node, items: Node) -> int:
        """At least the score of every pair: the larger of its items' terms cannot add more than all of them."""
        return int(docs.most[items.terms].sum())

    def _reaches(self, bound: int, docs: Node, items: Node) -> bool:
        """Whether a pair of the nodes may enter an item's best: only then the nodes are opened."""
        kth = self.kth[items.lo : items.hi]
        if bound > kth.min():
            return True
        return bool(((kth == bound) & (self.kth_id[items.lo : items.hi] > docs.least)).any())

    def _visit(self, docs: Node, items: Node, bound: int, dense, ids, named) -> None:
        if not self._reaches(bound, docs, items):
            return
        if not docs.children and not items.children:
            self._score(docs, items, dense, ids, named)
            return
        pairs = [(d, i) for d in docs.children or (docs,) for i in items.children or (items,)]
        bounds = [self._bound(d, i) for d, i in pairs]
        # The most promising first: it raises the k-th scores that the others are held against.
        for k in sorted(range(len(pairs)), key=lambda k: -bounds[k]):
            self._visit(*pairs[k], bounds[k], dense, ids, named)

    def _score(self, docs: Node, items: Node, dense, ids, named) -> None:
        scores = dense[docs.lo : docs.hi, items.terms] @ items.matrix.astype(self.kind, copy=False)
        self.scored += scores.size
        kth = self.kth[items.lo : items.hi]
        own = named[docs.lo : docs.hi, None]
        enters = (scores > kth) | ((scores == kth) & (own < self.kth_id[items.lo : items.hi]))
        for d, i in zip(*(x.tolist() for x in np.nonzero(enters & (scores > 0)))):
            i += items.lo
            name = ids[docs.lo + d]
            best = self.best[i]
            bisect.insort(best, (-int(scores[d, i - items.lo]), name is None, name or 0))
            del best[self.top :]
            if len(best) == self.top:
                self.kth[i], self.kth_id[i] = -best[-1][0], np.iinfo(np.int64).max if best[-1][1] else best[-1][2]

    def found(self) -> Iterator[tuple[int, int | None, int]]:
        """(item's row, doc_id, score)."""
        for row, best in zip(self.items.rows, self.best):
            for score, missing, name in best:
                yield row, None if missing else name, -score


_COUNTS = "doc_id bigint, n bigint, terms binary, counts binary"


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with any term: its length, and its terms of the vocabulary."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = Counter(map(number, words))
                found.pop(None, None)
                terms = np.fromiter(found, "<i4", len(found))
                counts = np.fromiter(found.values(), "<i4", len(found))
                rows.append((doc_id.as_py(), len(words), terms.tobytes(), counts.tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(counted, _COUNTS)


def _entries(batch: pa.RecordBatch) -> tuple:
    """(ids, n, owner, term, occurrences) of a batch of counts."""
    ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    terms, counts = ([np.frombuffer(x.as_py(), "<i4") for x in batch.column(c)] for c in (2, 3))
    owners = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in terms])
    return ids, n, owners, np.concatenate(terms), np.concatenate(counts)


def _statistics(counted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents with each term of the vocabulary)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            if batch.num_rows:
                _, n, _, terms, _ = _entries(batch)
                held += np.bincount(terms, minlength=size)
                documents += len(n)
                length += int(n.sum())
        at = np.flatnonzero(held)
        columns = [np.concatenate([[-2, -1], at]), np.concatenate([[documents, length], held[at]])]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64())], names=["term", "n"])

    parts = counted.mapInArrow(sums, "term int, n bigint")
    # At most a row for each term of a block of items.
    found = dict(tuple(r) for r in parts.groupBy("term").agg(F.sum("n")).collect())
    held = np.array([found.get(k, 0) for k in range(size)], np.int64)
    return found.get(-2, 0), found.get(-1, 0), held


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    """The weight of each term from the documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * h + 1))) for h in held.tolist()], np.int64)


def _block(spark, docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int, tree: int) -> DataFrame:
    """(row, doc_id, score) of the best documents of each item (row, terms) of a block."""
    numbers: dict[bytes, int] = {}
    numbered = [(row, np.array([numbers.setdefault(t, len(numbers)) for t in terms], np.int64)) for row, terms in items]
    vocabulary = spark.sparkContext.broadcast(numbers)
    counted = stored(_counted(docs, vocabulary), "counts")
    documents, length, held = _statistics(counted, len(numbers))
    weight = weights(documents, held)
    shared = spark.sparkContext.broadcast((ItemTree(numbered, weight), weight))
    some = max(DOC_LEAF, min(tree, ENTRIES // max(len(numbers), 1)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value, documents, length, top)
        for batch in batches:
            for at in range(0, batch.num_rows, some):
                search.show(*_entries(batch.slice(at, some)))
        columns = list(zip(*search.found())) or [[]] * 3
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "score"])

    named = counted.mapInArrow(searched, "row bigint, doc_id bigint, score bigint")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = named.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    place = F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))
    merged = part.withColumn("place", place).where(F.col("place") <= top).drop("place", "part")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    found = stored(merged.withColumn("rank", rank).where(F.col("rank") <= top), "found")
    vocabulary.unpersist()
    shared.unpersist()
    return found


def ranked(items: DataFrame, docs: DataFrame, top: int = TOP, item_block: int = ITEM_BLOCK, tree: int = TREE) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item.

    Every row of ``items`` (item_id, text) is an item of its own, also where an id is
    repeated or null; one without a term, or whose terms no document has, has no rows.
    Every row of ``docs`` (doc_id, text) is a document; equal scores go by ascending doc_id,
    with null last, and rows that repeat an id each have a rank. A null text has no terms.
    Other columns are not looked at. No items or documents give no rows. A text may have any length;
    a block of items is as many items' terms as fit a task's memory, and documents are read once for each block.
    """
    spark = docs.sparkSession

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t.as_py()))) for t in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "item_id", "terms"])

    plain = items.select(
        F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("bigint"), F.col("text").cast("string")
    )
    known = stored(plain.mapInArrow(listed, "row bigint, item_id bigint, terms array<binary>"), "items").where("size(terms) > 0")
    blocks = -(-known.count() // item_block)
    found = None
    for k in range(blocks):
        own = known.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)
        # A block's items: what its trees are made of.
        block = [(r["row"], [bytes(t) for t in r["terms"]]) for r in own.collect()]
        part = _block(spark, docs, sorted(block), top, tree)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return found.join(known.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
