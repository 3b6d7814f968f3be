"""Byte-pair encoding by backtracking over longest matches, and decoding by offsets.

The ids of a text are the one sequence of tokens that spells it and in which every
two neighbours are compatible, that is, stay apart when their own bytes are merged.
So a piece is read left to right: an Aho-Corasick automaton gives the longest token
at a place, a shorter one is tried where that does not follow its predecessor, and a
place from which nothing fits is remembered and left. Each place is left once at most,
which makes the time linear, and the ids are those that merging in order of rank gives.

Decoding copies each token's bytes from one block, found by a table of offsets.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.tokens import WordCache, letters_of_bytes, vocabulary_path

#: Pairs whose compatibility a worker keeps; beyond, it starts anew.
KEPT_PAIRS = 1_000_000
#: Pieces whose ids a worker keeps.
KEPT_PIECES = 400_000


class Vocabulary:
    """Tokens of a byte-level file with the merge that makes each of them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        byte_of = {c: b for b, c in enumerate(letters_of_bytes())}
        spelled = lambda token: bytes(byte_of[c] for c in token)
        ids = content["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: spelled(t) for t, i in ids.items()}
        self.bytes_of.update((i, t.encode()) for t, i in self.added.items())
        self.ranks: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, token = (ids[left], ids[right]), ids[left + right]
            self.ranks[pair], self.made[pair] = rank, token
            self.halves.setdefault(token, pair)
        special = set(self.added.values())
        self.matched = {b: i for i, b in self.bytes_of.items() if i not in special}


class BacktrackingEncoder:
    """Ids of a piece of text that no merge crosses the ends of."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        # One character for each byte, as the automaton takes text.
        self.automaton = ahocorasick.Automaton()
        for spelled, token in vocabulary.matched.items():
            self.automaton.add_word(spelled.decode("latin-1"), token)
        self.automaton.make_automaton()
        self.length = {i: len(b) for i, b in vocabulary.bytes_of.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper start of this one."""
        if token not in self.shorter:
            spelled, known = self.vocabulary.bytes_of[token], self.vocabulary.matched
            starts = (known.get(spelled[:n]) for n in range(len(spelled) - 1, 0, -1))
            self.shorter[token] = next((t for t in starts if t is not None), None)
        return self.shorter[token]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both by rank gives just the two of them.

        Their own merges are undone, the latest first: at each step the tokens
        that meet at the seam must not have been merged before that step.
        """
        ranks, halves = self.vocabulary.ranks, self.vocabulary.halves
        never = len(ranks)
        rank_of = lambda t: ranks[halves[t]] if t in halves else -1
        until = never
        while True:
            if ranks.get((left, right), never) < until:
                return False
            of_left, of_right = rank_of(left), rank_of(right)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                # Merges of one rank go from left to right: at the seam this one came first.
                until, left = of_left, halves[left][1]
            else:
                until, right = of_right + 1, halves[right][0]

    def _fits(self, pair: tuple[int, int]) -> bool:
        if pair not in self.compatible:
            if len(self.compatible) >= KEPT_PAIRS:
                self.compatible.clear()
            self.compatible[pair] = self._stay_apart(*pair)
        return self.compatible[pair]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.vocabulary.matched.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        tokens = [token for _, token in self.automaton.iter_long(text)]
        known, fits = self.compatible.get, self._fits
        # The usual case: the longest matches follow each other, to the end or for a while.
        for k in range(1, len(tokens)):
            pair = (tokens[k - 1], tokens[k])
            if not (known(pair) or fits(pair)):
                return self._resume(text, tokens[:k], tokens[k])
        return tokens

    def _resume(self, text: str, tokens: list[int], token: int) -> list[int]:
        """The ids of a text, of which the first are given and the next is to be tried."""
        known, fits, length = self.compatible.get, self._fits, self.length
        shorter, iter_long = self.shorter.get, self.automaton.iter_long
        at, end, left_for_good = sum(map(length.__getitem__, tokens)), len(text), set()
        while True:
            to = at + length[token]
            if to not in left_for_good and (not tokens or known(pair := (tokens[-1], token)) or fits(pair)):
                tokens.append(token)
                if to == end:
                    return tokens
                at = to
                token = next(iter_long(text, at))[1]
                continue
            token = known_shorter if (known_shorter := shorter(token)) is not None else self._shorter(token)
            while token is None:
                # Nothing fits here: leave the place and try a shorter token before it.
                left_for_good.add(at)
                last = tokens.pop()
                at -= length[last]
                token = self._shorter(last)


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Codec:
    """Whole texts to ids and back, as the tokenizers library does it."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.vocabulary = Vocabulary(path)
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        special = "|".join(regex.escape(t) for t in self.vocabulary.added)
        self.special = regex.compile(f"({special or '(?!)'})")
        self.encode_piece = BacktrackingEncoder(self.vocabulary).encode
        self.known: dict[str, bytes] = {}
        self.cache = WordCache(self._encode)
        self.ids = self.cache.ids
        size = max(self.vocabulary.bytes_of) + 1
        spelled = [self.vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self.block = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int32)

    def _encode(self, text: str) -> bytes:
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        found = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                found.append(_packed([self.vocabulary.added[part]]))
                continue
            for piece in self.pieces(part):
                ids = self.known.get(piece)
                if ids is None:
                    self.known[piece] = ids = _packed(self.encode_piece(piece.encode()))
                found.append(ids)
        return b"".join(found)

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes of the tokens; valid UTF-8 where the ids are a whole text's."""
        tokens = np.frombuffer(ids, dtype="<u4")
        starts = self.offsets[tokens]
        lengths = self.offsets[tokens + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        from_ = np.repeat(starts - (ends - lengths), lengths)
        from_ += np.arange(total, dtype=from_.dtype)
        return self.block[from_].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """The worker's codec; it lives as long as the worker.

    Its caches hold no cycles: looking for some in them again and again took a
    quarter of the time.
    """
    gc.set_threshold(500_000, 50, 100)
    return Codec(path)


_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: its number of ids, and digests of the ids and of their text.

    A null text is empty: no ids. Rows with a null or repeated doc_id are coded like
    others; other columns are not looked at. No documents give no rows.
    """
    path = path or vocabulary_path()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = own.ids(text.as_py() or "")
                decoded = own.decode(ids).encode("utf-8")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            counts, of_ids, of_text = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(coded, _DIGESTS)
