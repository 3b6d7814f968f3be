"""Near-duplicates by consistent weighted sampling over TF-IDF word shingles.

A text is a weighted set of five-word shingles: how often each occurs, times a weight
that falls with the number of documents that hold it. Improved consistent weighted
sampling draws from such sets so that two sets give the same draw with a probability
of their weighted Jaccard similarity. Draws are banded; texts that share a band are
compared by their whole sets, and links of at least ``SIMILARITY`` form classes.

Document frequencies are counted over all documents in a fixed number of hashed
buckets, so their table has one size for any corpus. Texts equal word for word are one
text from the first shuffle on. Members of a bucket are first compared with one of
them, the middle of the group, and those of a large one with others drawn anew, which
joins large classes by few comparisons. In the end all pairs of a bucket that are
still in different classes are compared: by rows in small buckets, in large ones by
blocks of members, so that a task holds two blocks whatever the bucket's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import free_name, stored, stored_counted

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: Buckets of document frequencies, and the slices they are summed in.
BUCKETS, SLICES = 1 << 20, 64
#: How much more a shingle of one document weighs than one of all documents.
STRENGTH = 0.25
#: Rounds in which what is left of a bucket meets some of it first, at most; texts drawn to be met in each.
ROUNDS, HUBS = 5, 2
#: A round that finds fewer links than this share of the texts is the last: a pass over all members for so few costs more than it saves.
FEW = 0.01
#: Links that a task joins in its memory before the rounds of ``components``.
JOINED = 100_000
#: Members of a bucket whose pairs are rows; members of a block of a larger one.
PAIRED, BLOCK = 8, 256

_MIX1, _MIX2, _STEP = (np.uint64(c) for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A good hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_random = np.random.default_rng(5)
#: A number for each byte, and for each place in a word the power of an odd base.
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_POWERS = np.cumprod(np.full(1 << 12, _STEP), dtype=np.uint64)


def words_of(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``, in order.

    Every byte is looked up and multiplied by a power for its place in the word;
    places beyond the table of powers start it again with a changed byte.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64)
    values = _BYTE.take(raw)
    values[space] = 0
    place = np.arange(len(raw), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.concatenate([starts, [len(raw)]])))
    far = place >> 12
    if far.any():
        values = np.where((far > 0) & ~space, _mixed(values + far.astype(np.uint64)), values)
        place &= (1 << 12) - 1
    values *= _POWERS.take(place, mode="clip")
    return _mixed(np.add.reduceat(values, starts))


def digest(words: np.ndarray) -> bytes:
    return hashlib.md5(words.tobytes(), usedforsecurity=False).digest()


def shingles(words: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles in order, how often each occurs).

    A text of fewer words is one shingle; one without words has none.
    """
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = min(size, len(words))
    rolled = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        rolled *= _STEP
        rolled += words[k : k + len(rolled)]
    return np.unique(_mixed(rolled), return_counts=True)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


class Sampler:
    """Draws of improved consistent weighted sampling.

    For each shingle and each draw, r and c are Gamma(2, 1) and b is uniform: taken
    from tables by fields of the shingle's hash.
    """

    def __init__(self, draws: int = BANDS * ROWS, seed: int = 11):
        random = np.random.default_rng(seed)
        self.factor = random.integers(0, 1 << 63, draws, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = random.gamma(2, 1, 1 << 16).astype(np.float32)
        self.log_c = np.log(random.gamma(2, 1, 1 << 16)).astype(np.float32)
        self.low, self.field = np.uint64(0xFFFF), (np.uint64(16), np.uint64(32), np.uint64(48))

    def draw(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit number for each draw: equal where sets drew the same."""
        logs = np.log(weights).astype(np.float32)
        found = np.empty(len(self.factor), np.uint64)
        # Some draws at once, as many as stay in a core's cache.
        some = max(1, 30_000 // len(hashes))
        for at in range(0, len(found), some):
            z = hashes * self.factor[at : at + some, None]
            r = self.r.take((z >> self.field[2]).view(np.int64))
            b = ((z >> self.field[1]) & self.low).astype(np.float32)
            b *= np.float32(1 / 65536)
            t = np.floor(logs / r + b)
            b -= t
            b -= 1
            b *= r
            b += self.log_c.take(((z >> self.field[0]) & self.low).view(np.int64))
            least = b.argmin(axis=1)
            times = t[np.arange(len(least)), least].astype(np.int64) & 0xFFFFFFFF
            found[at : at + some] = hashes[least] ^ times.astype(np.uint64)
        return found

    def bands(self, hashes: np.ndarray, weights: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """A 64-bit number for each band of draws; different bands never share one on purpose."""
        if not len(hashes):
            return np.empty(0, np.uint64)
        drawn = _mixed(self.draw(hashes, weights)).reshape(-1, rows)
        joined = np.arange(1, len(drawn) + 1, dtype=np.uint64)
        for k in range(rows):
            joined = _mixed(joined * _STEP + drawn[:, k])
        return joined


def similarity(a, b, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two (hashes, counts)."""
    (ha, na), (hb, nb) = a, b
    wa, wb = na * idf[bucket(ha)], nb * idf[bucket(hb)]
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    both = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    common = float(np.minimum(wa[both], wb[at[both]]).sum())
    total = float(wa.sum() + wb.sum()) - common
    return common / total if total else 1.0


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents by bucket of shingles, documents) over all rows of (id, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(BUCKETS, np.uint32), 0
        for batch in batches:
            for text in batch.column(0):
                found, _ = shingles(words_of(text.as_py()))
                np.add.at(counts, bucket(found), 1)
                n += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(SLICES), pa.int32()),
                pa.array([s.tobytes() for s in np.split(counts, SLICES)], pa.binary()),
                pa.array([n] + [0] * (SLICES - 1), pa.int64()),
            ],
            names=["slice", "counts", "n"],
        )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            n += sum(batch.column(2).to_pylist())
            for which, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(which, np.zeros(BUCKETS // SLICES, np.uint64))
                own += np.frombuffer(counts.as_py(), np.uint32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([s.tobytes() for s in sums.values()], pa.binary()),
                pa.array(([n] + [0] * len(sums))[: len(sums)], pa.int64()),
            ],
            names=["slice", "counts", "n"],
        )

    schema = "slice int, counts binary, n bigint"
    parts = texts.select("text").mapInArrow(counted, schema).repartition(SLICES, "slice")
    whole, n = np.zeros(BUCKETS, np.uint64), 0
    # SLICES rows of 128 KB, whatever the corpus.
    for row in parts.mapInArrow(summed, schema).collect():
        at = row["slice"] * (BUCKETS // SLICES)
        whole[at : at + BUCKETS // SLICES] = np.frombuffer(row["counts"], np.uint64)
        n += row["n"]
    return whole, n


def weights_of(counts: np.ndarray, documents: int) -> np.ndarray:
    """Weight of each bucket: 1 for shingles of all documents, 1 + STRENGTH for none."""
    share = np.log1p(counts.astype(np.float64)) / np.log1p(max(documents, 1))
    return (1 + STRENGTH * (1 - np.clip(share, 0, 1))).astype(np.float32)


def _banded(texts: DataFrame, idf) -> DataFrame:
    """(doc_id, key, bands) of each row; the key is of the words."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            keys, bands = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                keys.append(digest(words))
                found, counts = shingles(words)
                bands.append(sampler.bands(found, counts * idf.value[bucket(found)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "key", "bands"],
            )

    return texts.mapInArrow(drawn, "doc_id bigint, key binary, bands array<bigint>")


def _sets(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, hashes, counts) of the texts whose key is wanted, one row for each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words_of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h.tobytes() for h, _ in sets], pa.binary()),
                    pa.array([c.astype("<u4").tobytes() for _, c in sets], pa.binary()),
                ],
                names=["key", "hashes", "counts"],
            )

    # A text is wanted once, from its first document; only its row goes on. Rows of one
    # doc_id, or without any, are told apart by the key. No key is null, and a condition that
    # allows for it has no filter of its own, which would compute the key a second time.
    own = texts.select(F.col("doc_id").alias("id"), "text", _key_column(F.col("text")).alias("own"))
    wanted = own.join(keys, own["id"].eqNullSafe(keys["doc_id"]) & own["own"].eqNullSafe(keys["key"]))
    return wanted.select("key", "text").dropDuplicates(["key"]).mapInArrow(found, "key binary, hashes binary, counts binary")


def _key_column(text):
    @F.arrow_udf("binary")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array([digest(words_of(t.as_py())) for t in texts], pa.binary())

    return key(text)


def _verified(pairs: DataFrame, sets: DataFrame, idf, least: float) -> DataFrame:
    """The links (a, b) of classes from pairs of keys (x, y) of classes (a, b) whose sets are similar enough."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for ha, ca, hb, cb in zip(*batch.columns[2:]):
                a = np.frombuffer(ha.as_py(), np.uint64), np.frombuffer(ca.as_py(), "<u4").astype(np.float64)
                b = np.frombuffer(hb.as_py(), np.uint64), np.frombuffer(cb.as_py(), "<u4").astype(np.float64)
                kept.append(similarity(a, b, idf.value) >= least)
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    of = lambda side: sets.select(F.col("key").alias(side), F.col("hashes").alias(f"h{side}"), F.col("counts").alias(f"c{side}"))
    joined = pairs.join(of("x"), "x").join(of("y"), "y").select("a", "b", "hx", "cx", "hy", "cy")
    return joined.mapInArrow(compared, "a binary, b binary")


def _ordered_pair(x, y, of_x, of_y) -> list:
    """The columns x, y, a, b of a pair of keys and their classes, the smaller key first."""
    first = x < y
    either = lambda p, q, name: F.when(first, p).otherwise(q).alias(name)
    return [either(x, y, "x"), either(y, x, "y"), either(of_x, of_y, "a"), either(of_y, of_x, "b")]


def _middle(degree: str, key: str):
    """The first hub of a bucket: the middle of a group, and the same in all its buckets."""
    return F.max(F.struct(F.col(degree).alias("degree"), F.col(key).alias("key")))


def _members(distinct: DataFrame) -> DataFrame:
    """(key, doc_id, degree, bands) of the texts that share a bucket, with the bands that they share.

    ``degree`` is how many texts a text meets in all: the middle of a group of variants meets the most.
    """
    placed = distinct.select("key", "doc_id", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = placed.join(shared, "band").groupBy("key", "doc_id")
    return met.agg(F.sum("n").alias("degree"), F.collect_list("band").alias("bands"))


def _placed(texts: DataFrame) -> DataFrame:
    """(band, key, degree, class): a row for each bucket of each text."""
    return texts.select(F.explode("bands").alias("band"), "key", "degree", "class")


def _met(texts: DataFrame, round_: int) -> DataFrame:
    """Pairs (x, y, a, b) of a round: one text of each class of a bucket and the bucket's hubs."""
    placed = _placed(texts)
    if round_:
        drawn_by = F.struct(F.xxhash64("key", "band", F.lit(round_)).alias("o"), F.col("key"))
        one = placed.groupBy("band", "class").agg(F.min(drawn_by).alias("m"))
        order = lambda k: F.struct(F.xxhash64("m.key", "band", F.lit(-k)).alias("o"), F.col("m.key"), F.col("class"))
        drawn = [F.min(order(k)) for k in range(HUBS)]
    else:
        # Each text is a class of its own.
        one = placed.select("band", "class", F.struct("degree", "key").alias("m"))
        drawn = [F.max(F.struct("m.degree", "m.key", "class"))]
    hubs = one.groupBy("band").agg(F.array(*drawn).alias("hubs"), F.count("*").alias("n")).where("n > 1")
    met = one.join(hubs, "band").select(F.col("m.key").alias("key"), "class", F.explode("hubs").alias("hub"))
    met = met.where(F.col("class") != F.col("hub.class"))
    return met.select(*_ordered_pair(F.col("key"), F.col("hub.key"), F.col("class"), F.col("hub.class"))).distinct()


def _open(texts: DataFrame) -> DataFrame:
    """(band, key, class, n, most, n_most) of members of buckets with several classes.

    ``n`` is the bucket's size, ``most`` its largest class and ``n_most`` that one's size.
    A bucket's first hub has met all others and is left out.
    """
    members = _placed(texts)
    firsts = members.groupBy("band").agg(_middle("degree", "key").alias("first"))
    others = members.join(firsts, "band").where(F.col("key") != F.col("first.key")).select("band", "key", "class")
    sizes = others.groupBy("band", "class").agg(F.count("*").alias("n"))
    several = sizes.groupBy("band").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("m"), F.count("*").alias("parts")
    )
    several = several.where("parts > 1").select("band", "n", F.col("m.class").alias("most"), F.col("m.n").alias("n_most"))
    return others.join(several, "band")


def _paired(small: DataFrame) -> DataFrame:
    """Pairs (x, y) of keys of different classes (a, b) that share a bucket."""
    of = lambda side, c: small.select("band", F.col("key").alias(side), F.col("class").alias(c))
    return of("x", "a").join(of("y", "b"), "band").where("x < y and a <> b").select("x", "y", "a", "b").distinct()


def _blocked(large: DataFrame, size: int) -> DataFrame:
    """Members of large buckets by groups (band, i, j) of at most two blocks.

    Each pair of different classes is in a group. The largest class has blocks of its
    own, numbered below zero, that meet those of the rest but not each other.
    """
    at = lambda blocks: F.pmod(F.xxhash64("key"), blocks)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / size))
    placed = large.withColumn("rest", blocks(F.col("n") - F.col("n_most"))).withColumn("own", blocks(F.col("n_most")))
    numbered = placed.withColumn("i", F.when(F.col("class") == F.col("most"), -1 - at(F.col("own"))).otherwise(at(F.col("rest"))))
    rest = F.sequence(F.lit(0).cast("bigint"), F.col("rest") - 1)
    own = F.sequence(-F.col("own"), F.lit(-1).cast("bigint"))
    partners = F.when(F.col("i") < 0, rest).otherwise(F.concat(rest, own))
    met = numbered.withColumn("j", F.explode(partners))
    low, high = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    return met.select("band", low, high, F.col("i").alias("block"), "key", "class")


def _group_links(members: list[tuple], band: int, least: float, idf: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links of classes (a, b) in a group of (block, class, bands, hashes, counts).

    A pair is looked at in the first bucket that it shares, and where there are two blocks,
    across them; one whose classes are linked already, or whose total weights alone tell
    it apart, is not compared.
    """
    if len(members) < 2:
        return []
    names = sorted({m[1] for m in members})
    number = {c: k for k, c in enumerate(names)}
    block = np.array([m[0] for m in members])
    of = np.array([number[m[1]] for m in members])
    bands = np.array([m[2] for m in members])
    here = int(np.flatnonzero(bands[0] == band)[0])
    sets = [(m[3], m[4].astype(np.float64)) for m in members]
    across = len(set(block.tolist())) > 1
    weights = [c * idf[bucket(h)] for h, c in sets]
    totals = np.array([w.sum() for w in weights])
    ends = np.cumsum([0] + [len(w) for w in weights])
    known, ids = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    every, dense, links = np.concatenate(weights), np.zeros(len(known)), []
    for x in range(len(members) - 1):
        y = np.arange(x + 1, len(members))
        y = y[(of[y] != of[x]) & ((block[y] != block[x]) | (not across))]
        y = y[np.minimum(totals[y], totals[x]) >= (least - 1e-9) * np.maximum(totals[y], totals[x])]
        y = y[~(bands[y, :here] == bands[x, :here]).any(axis=1)]
        if not len(y):
            continue
        if len(y) > 4:
            # The common weights with all from the first of them on, at once.
            mine = slice(ends[x], ends[x + 1])
            dense[ids[mine]] = weights[x]
            low = ends[y[0]]
            sums = np.add.reduceat(np.minimum(dense[ids[low:]], every[low:]), ends[y[0] : -1] - low)
            dense[ids[mine]] = 0
            common = sums[y - y[0]]
            y = y[common >= (least - 1e-9) * (totals[x] + totals[y] - common)]
        for k in y:
            if of[k] != of[x] and similarity(sets[x], sets[k], idf) >= least:
                links.append((names[of[x]], names[of[k]]))
                of[of == of[k]] = of[x]
    return links


def _group_linked(groups: DataFrame, sets: DataFrame, idf, least: float) -> DataFrame:
    """Links (a, b) of classes, from groups of members as ``_blocked`` gives them."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(of, held):
            # Within one block pairs are looked at in the group that it forms with itself.
            found = [] if of[1] != of[2] and len({m[0] for m in held}) == 1 else _group_links(held, of[0], least, idf.value)
            columns = [pa.array([p[k] for p in found], pa.binary()) for k in range(2)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        now, held = None, []
        for batch in batches:
            for band, i, j, block, class_, bands, hashes, counts in zip(*batch.columns):
                of = band.as_py(), i.as_py(), j.as_py()
                if of != now:
                    if held:
                        yield links(now, held)
                    now, held = of, []
                h, c = np.frombuffer(hashes.as_py(), np.uint64), np.frombuffer(counts.as_py(), "<u4")
                held.append((block.as_py(), class_.as_py(), bands.as_py(), h, c))
        if held:
            yield links(now, held)

    full = groups.join(sets, "key").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    columns = ["band", "i", "j", "block", "class", "bands", "hashes", "counts"]
    return full.select(*columns).mapInArrow(linked, "a binary, b binary")


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b) of the same classes as those given; of some in one task, each end but the least of its class leads to that."""

    def joined(least: dict[bytes, bytes], root) -> pa.RecordBatch:
        found = [(k, root(k)) for k in list(least) if least[k] != k]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in range(2)], names=["a", "b"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, bytes] = {}

        def root(key: bytes) -> bytes:
            while least.setdefault(key, key) != key:
                least[key] = key = least[least[key]]
            return key

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = sorted((root(a), root(b)))
                least[high] = low
            if len(least) > JOINED:
                yield joined(least, root)
                least.clear()
        yield joined(least, root)

    return links.select("a", "b").mapInArrow(stars, "a binary, b binary")


def components(links: DataFrame, n: int) -> DataFrame:
    """(key, class) of each end of the n links (a, b); the class is the least key.

    Links that lie in one task are joined there. Each round then takes the least label
    among neighbours and that label's own.
    """
    links = stored(_stars(links.coalesce(1 + n // JOINED)), "stars")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("class"))
    labels = stored(labels.select("key", F.least("key", "class").alias("class")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "class"), "b").groupBy("a").agg(F.min("class").alias("near"))
        lower = labels.join(near, labels["key"] == near["a"]).select(
            "key", F.least("class", "near").alias("class"), F.col("class").alias("before")
        )
        roots = labels.select(F.col("key").alias("class"), F.col("class").alias("root"))
        lower = lower.join(roots, "class").select("key", F.least("class", "root").alias("class"), "before")
        lower, [changed] = stored_counted(lower, "labels", F.col("class") != F.col("before"))
        labels = lower.select("key", "class")
        if not changed:
            return labels


def _relabelled(texts: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """The texts with their classes after the n links of classes; only those that are joined change."""
    joined = components(links, n).select(F.col("key").alias("class"), F.col("class").alias("new"))
    now = F.coalesce("new", "class").alias("class")
    return stored(texts.join(joined, "class", "left").select(*[now if c == "class" else c for c in texts.columns]), "texts")


def _classed(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, key, class_key) of each document.

    The plans are small and few on purpose: the driver keeps something of every stage and
    task, and plans each stage anew.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts, n = frequencies(texts)
    idf = spark.sparkContext.broadcast(weights_of(counts, n))
    rows = stored(_banded(texts, idf), "banded")
    # One row for each text, with its first document.
    distinct = stored(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "distinct")
    members, [n_texts] = stored_counted(_members(distinct), "members")
    sets = stored(_sets(texts, members.select("doc_id", "key")), "sets")

    of_class, few = members.select("key", "degree", "bands", F.col("key").alias("class")), None
    for round_ in range(ROUNDS):
        links, [n] = stored_counted(_verified(_met(of_class, round_), sets, idf, least), "links")
        if n < max(1, FEW * n_texts):
            # This only ends what saves comparisons; no pair is excluded by it, and its links are kept.
            few = links
            break
        of_class = _relabelled(of_class, links, n)
    # Whatever the rounds have met, all pairs of a bucket are in one class or compared from here on.
    open_, [n_large] = stored_counted(_open(of_class), "open", F.col("n") > PAIRED)
    links = _verified(_paired(open_.where(F.col("n") <= PAIRED)), sets, idf, least)
    if n_large:
        large = open_.where(F.col("n") > PAIRED)
        banded = sets.join(distinct.select("key", "bands"), "key")
        links = links.unionByName(_group_linked(_blocked(large, BLOCK), banded, idf, least))
    if few is not None:
        links = links.unionByName(few)
    links, [n] = stored_counted(links, "links")
    labels = of_class.select("key", "class")
    if n:
        labels = _relabelled(labels, links, n)
    idf.unpersist()

    labels = labels.where(F.col("class") != F.col("key")).withColumnRenamed("class", "_class")
    joined = rows.select("doc_id", "key").join(labels, "key", "left")
    return joined.select("doc_id", "key", F.coalesce("_class", "key").alias("class_key"))


def _heads(classed: DataFrame) -> DataFrame:
    """(class_key, head) with the doc_id and key that a class is known by; a null doc_id comes after all others."""
    first = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("doc_id"), F.col("key"))
    return classed.groupBy("class_key").agg(F.min(first).alias("head"))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, key (of its words), class_key, class_id, first.

    ``class_id`` is the smallest doc_id of the class, and ``first`` marks the row
    that stays; where a class has several rows of that doc_id, each is marked, and
    ``kept`` takes one. Texts without words are copies of each other. A null doc_id
    comes after all others. No documents give no rows.
    """
    joined = _classed(docs, least)
    return joined.join(_heads(joined), "class_key").select(
        "doc_id",
        "key",
        "class_key",
        F.col("head")["doc_id"].alias("class_id"),
        (F.col("doc_id").eqNullSafe(F.col("head")["doc_id"]) & (F.col("key") == F.col("head")["key"])).alias("first"),
    )


def kept(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class, with the columns they came with."""
    key, own = free_name(docs, "_key"), free_name(docs, "_id")
    stay = _heads(_classed(docs, least)).select(F.col("head.doc_id").alias(own), F.col("head.key").alias(key))
    # Most documents stay: their texts are shuffled once, by document and key.
    of = free_name(docs, "_of")
    named = docs.withColumn(of, _key_column(F.col("text").cast("string")))
    same = named.join(stay, named["doc_id"].cast("bigint").eqNullSafe(stay[own]) & named[of].eqNullSafe(stay[key]))
    return same.dropDuplicates([own, key]).select(*[F.col(c) for c in docs.columns])
