"""Token ids of whole texts, and a cache for encoders that are worth one.

A byte-level BPE first cuts a text before the space in front of a word, so the ids of
a space and the characters up to the next space do not depend on what is around
them, unless white space meets that boundary. Such texts are cut at the other spaces.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array

#: Words that a worker keeps; beyond, it starts anew. A bound of memory, not of results.
KEPT_WORDS = 700_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def letters_of_bytes() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for letters from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def byte_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(id of each token's bytes, id of each added token) of a byte-level file."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    byte_of = {c: b for b, c in enumerate(letters_of_bytes())}
    ids = {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items()}
    return ids, {t["content"]: t["id"] for t in content["added_tokens"]}


#: A space between two characters that are not white: no token crosses into it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class _Odd(Exception):
    """A unit that meets white space: its text has to be cut with care."""


class _Words(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        self[word] = ids = self.encode(" " + word)
        return ids


class WordCache:
    """Ids of whole texts, as little-endian unsigned 32-bit integers, unit by unit.

    A unit is what lies between two safe spaces, mostly a word; all but the first of
    a text are encoded with the space in front. ``encode`` gives the ids of a
    short text.
    """

    def __init__(self, encode, kept_words: int = KEPT_WORDS):
        self.encode, self.kept_words = encode, kept_words
        self.words = _Words(encode)

    def ids(self, text: str) -> bytes:
        return b"".join(self.units(text))

    def units(self, text: str) -> list[bytes]:
        """The ids of each unit."""
        if len(self.words) > self.kept_words:
            self.words.clear()
        cut = text.split(" ")
        try:
            if not cut[0] or cut[0][-1].isspace():
                raise _Odd
            return [self.encode(cut[0]), *map(self.words.__getitem__, cut[1:])]
        except _Odd:
            cut = safe_units(text)
            return [self.encode(cut[0]), *(self.encode(" " + unit) for unit in cut[1:])]


def safe_units(text: str) -> list[str]:
    return _SAFE.split(text)


class TextEncoder:
    """Ids as the tokenizers library gives them with ``add_special_tokens=False``.

    They come from tiktoken over the same vocabulary, whose ids follow the order of
    the merges, in a third of the library's time; added tokens are cut out first.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ids, self.added_ids = byte_vocabulary(path)
        for content in self.added_ids:
            ids.pop(content.encode(), None)
        self.added = re.compile("(" + ("|".join(map(re.escape, self.added_ids)) or r"(?!)") + ")")
        ranks = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
        self.ordinary = ranks.encode_ordinary

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        found = array("I")
        for k, part in enumerate(self.added.split(text)):
            found.extend([self.added_ids[part]] if k % 2 else self.ordinary(part))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """The worker's encoder; it lives as long as the worker."""
    return TextEncoder(path)
