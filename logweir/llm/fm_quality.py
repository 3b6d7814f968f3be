"""Quality of texts by a factorisation machine.

A text is a sparse vector: its words, hashed; statistics of its structure; and its
recorded length. Each feature has a weight and a short vector, and two features
that occur together add the product of their vectors: what a word says may depend on
the structure around it. The sum over all pairs is half of (square of the sum less sum
of the squares), so a text is scored in time linear in its features.

Scoring is one pass over the texts. The model is fitted on at most ``max_samples``
labelled documents, whose vectors alone reach the driver.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import free_name

#: Labelled documents that a model is fitted on, at most; chosen by a hash of their id.
MAX_SAMPLES = 6000
BUCKETS = 1 << 14
RANK = 8
EPOCHS = 6
RATE = 0.1
DECAY = 1e-5

STATISTICS = (
    "words,chars,recorded,word_length,long_words,distinct,repeats,capitals,capital_words,digits,symbols,"
    "points,exclaimed,bars,lines,line_repeats,line_words,spaces"
).split(",")

_CAPITALS = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&<>@^~=+{}[]\\_"


def statistics(text: str, words: list[str], counts: Counter, recorded: float) -> list[float]:
    """The text's structure as numbers, most of them shares; all are 0 for no text."""
    raw, n = text.encode("utf-8", "surrogatepass"), len(words)
    size = max(len(raw), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    lines = [x for x in text.split("\n") if x.strip()]
    of_words = max(n, 1)
    lengths = len(text) - text.count(" ") - text.count("\n")
    return [
        math.log1p(n),
        math.log1p(len(text)),
        math.log1p(max(recorded, 0.0)),
        lengths / of_words,
        sum(len(w) > 25 for w in counts) / of_words,
        len(counts) / of_words,
        sum(map(str.__eq__, words, words[1:])) / of_words,
        share(_CAPITALS),
        sum(c for w, c in counts.items() if w.isupper()) / of_words,
        share(_DIGITS),
        share(_SYMBOLS),
        share(b".,;:?"),
        share(b"!"),
        share(b"|"),
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        share(b" \t\r\n\x0b\x0c"),
    ]


def vector(text: str | None, recorded: float | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(buckets of distinct words, their values, statistics); the values have length 1."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    if recorded is None or not math.isfinite(recorded):
        recorded = 0.0
    numbers = statistics(text, words, counts, recorded)
    crc = zlib.crc32
    at = np.fromiter((crc(w.encode("utf-8", "surrogatepass")) for w in counts), np.int64, len(counts)) % BUCKETS
    values = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(values):
        values /= math.sqrt(float(values @ values))
    return at, values, numbers


@dataclasses.dataclass
class Model:
    """Weights of the buckets and, after them, of the statistics; ``linear`` None knows nothing."""

    bias: float = 0.0
    linear: np.ndarray | None = None
    factors: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def scaled(self, numbers) -> np.ndarray:
        return np.clip((np.asarray(numbers) - self.mean) / self.spread, -4, 4) / 2

    def features(self, at, values, numbers) -> tuple[np.ndarray, np.ndarray]:
        more = np.arange(BUCKETS, BUCKETS + len(STATISTICS))
        return np.concatenate([at, more]), np.concatenate([values, self.scaled(numbers)])

    def margin(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        own = self.factors[at]
        total = x @ own
        squares = (x * x) @ (own * own)
        return self.bias + float(self.linear[at] @ x) + 0.5 * float((total * total - squares).sum()), total

    def score(self, text: str | None, recorded: float | None) -> float:
        if self.linear is None:
            return 0.5
        margin, _ = self.margin(*self.features(*vector(text, recorded)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def fitted(samples: list[tuple[np.ndarray, np.ndarray, list[float], int]], seed: int = 7) -> Model:
    """A model of (buckets, values, statistics, label), by steps scaled to past gradients.

    Without samples of both labels it knows nothing and scores 0.5.
    """
    if len({y for *_, y in samples}) < 2:
        return Model()
    random = np.random.default_rng(seed)
    numbers = np.array([s for _, _, s, _ in samples])
    size = BUCKETS + len(STATISTICS)
    model = Model(
        0.0,
        np.zeros(size),
        random.normal(0, 0.05, (size, RANK)),
        numbers.mean(axis=0),
        np.maximum(numbers.std(axis=0), 1e-9),
    )
    rows = [(*model.features(a, v, s), y) for a, v, s, y in samples]
    past_linear, past_factors, past_bias = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            at, x, y = rows[i]
            margin, total = model.margin(at, x)
            off = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))) - y
            own = model.factors[at]
            of_linear = off * x + DECAY * model.linear[at]
            of_factors = off * (np.outer(x, total) - own * (x * x)[:, None]) + DECAY * own
            past_bias += off * off
            past_linear[at] += of_linear * of_linear
            past_factors[at] += of_factors * of_factors
            model.bias -= RATE * off / math.sqrt(past_bias)
            model.linear[at] -= RATE * of_linear / np.sqrt(past_linear[at])
            model.factors[at] -= RATE * of_factors / np.sqrt(past_factors[at])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_samples: int = MAX_SAMPLES) -> Model:
    """A model from labels outside the held-out third.

    A document with several labels counts by their mean; null labels are none. One
    row of a document is learned from.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_samples)
    )

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [vector(t, r) for t, r in zip(batch["text"], batch["recorded"])]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "label": batch["label"],
                    "at": [a.astype("<u2").tobytes() for a, _, _ in found],
                    "x": [v.astype("<f4").tobytes() for _, v, _ in found],
                    "numbers": [s for _, _, s in found],
                }
            )

    # At most max_samples narrow rows are broadcast.
    rows = docs.join(F.broadcast(known), docs["doc_id"] == known["_id"]).select(
        F.col("_id").cast("bigint").alias("id"),
        F.col("_label").alias("label"),
        docs["text"].cast("string").alias("text"),
        docs["n_chars"].cast("double").alias("recorded"),
    )
    # Of the rows of one document the one of the least hash counts, whatever their order.
    least = F.struct(F.xxhash64("text").alias("hash"), "text", "recorded")
    rows = rows.groupBy("id", "label").agg(F.min(least).alias("row")).select("id", "label", "row.text", "row.recorded")
    found = rows.mapInPandas(vectors, "id bigint, label int, at binary, x binary, numbers array<double>")
    samples = []
    for r in sorted(found.collect(), key=lambda r: r["id"]):
        at, x = np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(np.float64)
        samples.append((at, x, list(r["numbers"]), int(r["label"])))
    return fitted(samples)


def score_column(model: Model) -> Column:
    """The score of the columns ``text`` and ``n_chars``, 0 to 1."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, recorded in batches:
            pairs = zip(texts, recorded.astype("float64"))
            yield pd.Series([model.score(t, r) for t, r in pairs], dtype="float64")

    return scores(F.col("text").cast("string"), F.col("n_chars").cast("double"))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows with their score.

    A null text is empty and gets a score too; a null length counts as 0.
    Repeated rows get the same score. No documents give none.
    """
    return docs.withColumn(name, score_column(model))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, learned_from: DataFrame | None = None) -> DataFrame:
    """The documents that score at least ``least``, with the columns they came with.

    ``learned_from`` has the labelled documents, where ``docs`` are only a part of them:
    one that has been filtered by quality holds few that are bad.
    """
    name = free_name(docs, "_score")
    model = train(docs if learned_from is None else learned_from, labels)
    return scored(docs, model, name).where(F.col(name) >= least).drop(name)
