"""Documents with every awkward value, and the operators' names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _body string, Key string, row bigint"


def prose(n: int, seed: int, letters: str = "etaoinshrdlu") -> str:
    """n invented words with sentence ends."""
    r = random.Random(seed)
    words = ["".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(n)]
    return " ".join(w + ("." if r.random() < 0.1 else "") for w in words)


def rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, odd characters."""
    base = prose(400, 1)
    near = base.replace(base.split(" ")[200], "otherword", 1)
    texts = [
        (1, base, "en"),
        (2, base, "en"),
        (3, near, "en"),
        (3, near, "en"),
        (4, None, "en"),
        (5, "", None),
        (6, "   \n\t ", "xx"),
        (7, prose(30_000, 2), "de"),
        (None, "The text without an id " + prose(60, 3), "en"),
        (None, None, None),
        (8, "one two", "en"),
        (9, "<|endoftext|> a<|endoftext|>  b c \U0001f600 \x85 é", "fr"),
        (10, "And " * 300, "en"),
        (11, "\n".join(["same line"] * 50), "en"),
        (12, prose(80, 4) + " " + base[500:900] + " " + prose(80, 5), "en"),
        (13, "x" * 5000, "en"),
    ]
    return [(i, t, lang, None if i == 1 else "s", len(t) if t and i != 2 else None, "b", "k", 7) for i, t, lang in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
