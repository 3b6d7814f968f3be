"""Token counts that follow edits, by segment trees over pre-tokens.

A text is cut into leaves of some words, at spaces that no token crosses. A tree over
the leaves holds characters and tokens of each subtree: descending by characters
finds the leaf of an edit, and a changed leaf changes the sums above it only. After
edits only the leaves they touch are encoded again, each with its neighbours as far as
the cut between them no longer holds; the rest of the text is never looked at by
the encoder. Leaves are cut by content alone, so equal texts have equal trees.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import free_name
from logweir.llm.tokens import TextEncoder, WordCache, safe_units, vocabulary_path

#: Units of a leaf; a unit is mostly a word.
LEAF = 32


class Tree:
    """Sums of characters and tokens over leaves; node k has the children 2k and 2k + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(len(chars) - 1, 0).bit_length()
        pad = [0] * (self.size - len(chars))
        self.chars = [0] * self.size + list(chars) + pad
        self.tokens = [0] * self.size + list(tokens) + pad
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, first character of it) of the character; the end is the last leaf's."""
        if at >= self.chars[1]:
            at = max(self.chars[1] - 1, 0)
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.size + leaf
        more_chars, more_tokens = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += more_chars
            self.tokens[k] += more_tokens
            k //= 2

    def leaf_chars(self, leaf: int) -> int:
        return self.chars[self.size + leaf]


def _joins(left: str, right: str) -> bool:
    """Whether a token may cross from one leaf into the next."""
    return left[-1].isspace() or right[0] != " " or len(right) < 2 or right[1].isspace()


class Counter:
    """Trees of texts, and counts after edits."""

    def __init__(self, path: str, leaf: int = LEAF):
        encoder = TextEncoder(path)
        self.count = lambda text: len(encoder.ids(text)) // 4
        self.words = WordCache(encoder.ids)
        self.leaf = leaf

    def build(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf."""
        cut = text.split(" ")
        found = self.words.units(text)
        if len(found) != len(cut):
            cut = safe_units(text)
        counts = [len(ids) // 4 for ids in found]
        chars, tokens = [], []
        for at in range(0, len(cut), self.leaf):
            some = cut[at : at + self.leaf]
            # Each unit but the first of the text has its space in front.
            chars.append(sum(map(len, some)) + len(some) - (not at))
            tokens.append(sum(counts[at : at + self.leaf]))
        return chars, tokens

    def edited(self, text: str, chars: list[int], tokens: list[int], edits: list[tuple[int, int, str]]) -> tuple[int, int, int, str]:
        """(tokens, leaves encoded, characters encoded, text) after the edits.

        An edit is (start, end, replacement) in characters of the text as it was.
        Edits are taken from the end of the text, which leaves the places of earlier
        ones as they are; one that overlaps a later one reaches up to it.
        """
        if not edits:
            return sum(tokens), 0, 0, text
        tree = Tree(chars, tokens)
        n = max(len(chars), 1)
        starts = [0] * n
        for k in range(1, n):
            starts[k] = starts[k - 1] + chars[k - 1]
        changed: dict[int, str] = {}
        own = lambda k: changed[k] if k in changed else text[starts[k] : starts[k] + (chars[k] if chars else 0)]
        upto = len(text)
        for start, end, new in sorted(edits, reverse=True):
            start, end = max(0, min(start, upto)), max(0, min(end, upto))
            end = max(start, end)
            upto = start
            first, low = tree.find(start)
            now = own(first)
            head, at, gone = now[: start - low], first, end - start
            tail = now[start - low :]
            # What the edit removes beyond the leaf is taken from those that follow.
            while gone > len(tail):
                gone -= len(tail)
                at += 1
                tail = own(at)
                changed[at] = ""
                tree.set(at, 0, 0)
            changed[first] = head + new + tail[gone:]
            tree.set(first, len(changed[first]), 0)
        # Leaves that the cuts no longer part become one; then each is encoded once.
        for k in sorted(changed):
            now = own(k)
            if not now:
                continue
            before = next((j for j in range(k - 1, -1, -1) if tree.leaf_chars(j)), None)
            while before is not None and _joins(own(before), now):
                now, changed[k] = own(before) + now, ""
                tree.set(k, 0, 0)
                k, changed[before] = before, now
                tree.set(k, len(now), 0)
                before = next((j for j in range(k - 1, -1, -1) if tree.leaf_chars(j)), None)
            after = next((j for j in range(k + 1, n) if tree.leaf_chars(j)), None)
            while after is not None and _joins(now, own(after)):
                now, changed[after] = now + own(after), ""
                tree.set(after, 0, 0)
                after = next((j for j in range(after + 1, n) if tree.leaf_chars(j)), None)
            changed[k] = now
            tree.set(k, len(now), self.count(now))
        # Where a leaf was emptied, its neighbours meet.
        for k in [k for k, now in changed.items() if not now]:
            after = next((j for j in range(k + 1, n) if tree.leaf_chars(j)), None)
            before = next((j for j in range(k - 1, -1, -1) if tree.leaf_chars(j)), None)
            if before is not None and after is not None and _joins(own(before), own(after)):
                changed[before], changed[after] = own(before) + own(after), ""
                tree.set(after, 0, 0)
                tree.set(before, len(changed[before]), self.count(changed[before]))
        encoded = size = 0
        for k, now in changed.items():
            encoded += bool(now)
            size += len(now)
        whole = "".join(own(k) for k in range(n))
        return tree.tokens[1], encoded, size, whole


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """The worker's counter; it lives as long as the worker."""
    gc.set_threshold(500_000, 50, 100)
    return Counter(path)


def trees(docs: DataFrame, path: str | None = None, name: str = "tree") -> DataFrame:
    """The rows with the tree of their text: characters and tokens of each leaf.

    A null text is empty and has one empty leaf.
    """
    path = path or vocabulary_path()

    @F.arrow_udf("struct<chars:array<int>,tokens:array<int>>")
    def built(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for column in texts:
            found = [own.build(t.as_py() or "") for t in column]
            kind = pa.list_(pa.int32())
            parts = [pa.array([f[i] for f in found], kind) for i in (0, 1)]
            yield pa.StructArray.from_arrays(parts, names=["chars", "tokens"])

    return docs.withColumn(name, built(F.col("text").cast("string")))


def updated(rows: DataFrame, edits: Column, path: str | None = None, tree: str = "tree", name: str = "counted") -> DataFrame:
    """The rows with their counts after the edits.

    ``edits`` is an array of (start, end, replacement), in characters of the text; null
    or empty: none. The new column has tokens_before, tokens, leaves, leaves_encoded,
    chars_encoded and the text.
    """
    path = path or vocabulary_path()

    @F.arrow_udf(
        "struct<tokens_before:bigint,tokens:bigint,leaves:bigint,leaves_encoded:bigint,chars_encoded:bigint,text:string>"
    )
    def counted(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = counter(path)
        for texts, built, changes in columns:
            found = []
            for text, tree_, some in zip(texts, built, changes):
                tree_ = tree_.as_py()
                asked = [(e["start"], e["end"], e["replacement"] or "") for e in some.as_py() or []]
                tokens, leaves, chars, after = own.edited(text.as_py() or "", tree_["chars"], tree_["tokens"], asked)
                found.append((sum(tree_["tokens"]), tokens, len(tree_["chars"]), leaves, chars, after))
            kinds = [pa.int64()] * 5 + [pa.string()]
            parts = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            names = ["tokens_before", "tokens", "leaves", "leaves_encoded", "chars_encoded", "text"]
            yield pa.StructArray.from_arrays(parts, names=names)

    text = F.col("text").cast("string")
    return rows.withColumn(name, counted(text, F.col(tree), edits))


def masks(docs: DataFrame, patterns: dict[str, str], name: str = "edits") -> DataFrame:
    """The rows with edits that replace what the patterns match; SQL functions only.

    ``patterns`` gives the replacement of each regular expression; where matches
    overlap, the expression that is listed first has it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = "|".join(f"(?:{p})" for p in patterns)
    parts, found = free_name(docs, "_parts"), free_name(docs, "_found")
    rows = docs.withColumn(found, F.regexp_extract_all(text, F.lit(f"({every})"), F.lit(1)))
    rows = rows.withColumn(parts, F.when(F.size(found) > 0, F.split(text, every, -1)))
    def place(at, pair):
        start = at["at"] + F.length(pair["part"])
        end = start + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(at["edits"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match")))).alias("edits"))

    pairs = F.zip_with(parts, found, lambda p, m: F.struct(p.alias("part"), m.alias("match")))
    pairs = F.slice(pairs, F.lit(1), F.size(found))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,match:string>>")
    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("edits")), place, lambda a: a["edits"])

    def replaced(e):
        value = F.lit("")
        for pattern, replacement in reversed(patterns.items()):
            value = F.when(e["match"].rlike(f"^(?:{pattern})$"), F.lit(replacement)).otherwise(value)
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), value.alias("replacement"))

    return rows.withColumn(name, F.transform(placed, replaced)).drop(parts, found)
