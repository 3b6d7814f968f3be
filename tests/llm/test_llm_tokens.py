"""Packing, byte-pair coding and edit-aware counts against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from logweir.llm import bpe, edit_counts, packing
from logweir.llm.queries import MASKS
from logweir.llm.tokens import TextEncoder, WordCache, vocabulary_path
from tests.llm.llm_helpers import documents, nothing, rows

POOL = list("abcXYZ  \n\t  .,'!0129éßçñ¿") + ["<|endoftext|>", "'s", "'ll", " ", " ", "\x85", "\x1c", "日本", "😀", "the", "ing"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path())
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(POOL, k=r.randint(0, 40))) for _ in range(n)] + ["a" * 3000, " " * 500, "ab" * 900, ""]


def numbers(ids: bytes):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_ids_are_those_of_the_library(library):
    some = texts(4000, 1)
    want, own = library(some), TextEncoder(vocabulary_path())
    cached, codec = WordCache(own.ids, kept_words=50), bpe.Codec(vocabulary_path())
    for text, ids in zip(some, want):
        assert numbers(own.ids(text)) == ids, text
        assert numbers(cached.ids(text)) == ids, text
        assert numbers(codec.ids(text)) == ids, text
        assert codec.decode(codec.ids(text)) == text


def test_random_ids_decode_as_the_library_does(library):
    from tokenizers import Tokenizer

    own, codec, r = Tokenizer.from_file(vocabulary_path()), bpe.Codec(vocabulary_path()), random.Random(2)
    for _ in range(300):
        ids = r.choices(range(50257), k=r.randint(0, 20))
        assert codec.decode(struct.pack(f"<{len(ids)}I", *ids)) == own.decode(ids, skip_special_tokens=False)


def test_round_trips_of_awkward_rows(spark, library):
    got = sorted(map(tuple, bpe.round_trips(documents(spark)).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows():
        ids = library([text or ""])[0]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trips(nothing(spark)).count() == 0


def test_packing_of_awkward_rows(spark, library):
    found = packing.packed(documents(spark)).collect()
    ids = {}
    for doc_id, text, *_ in rows():
        ids.setdefault(doc_id, []).append([*library([text or ""])[0], 2])
    by_bin = {}
    for r in found:
        whole = next(x for x in ids[r.doc_id] if zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) == r.ids_crc32)
        assert (r.length == 1024) or r.piece == 0 or r.length == len(whole)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in found) == sum(len(x) for xs in ids.values() for x in xs)
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed(nothing(spark)).count() == 0


def test_packing_is_close_to_the_bound():
    r = random.Random(4)
    lengths = [min(1024, int(r.expovariate(1 / 300)) + 1) for _ in range(20_000)]
    packer = packing.Packer()
    fill = {}
    for n in lengths:
        into, at = packer.place(n)
        assert fill.get(into, 0) == at
        fill[into] = at + n
    assert max(fill.values()) <= 1024
    assert len(packer.still_open()) <= packing.OPEN_BINS
    assert len(fill) <= 1.03 * sum(lengths) / 1024


def test_the_fullest_bin_closes_first():
    packer = packing.Packer(10, 2)
    assert [packer.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]
    # Of bins with 4 and 3 free the latter was closed.
    assert packer.still_open() == {0, 2}
    assert packer.place(4) == (0, 6)


@pytest.mark.parametrize("leaf", [1, 3])
def test_counts_follow_edits(library, leaf):
    r, counter = random.Random(leaf), edit_counts.Counter(vocabulary_path(), leaf)
    for text in texts(1500, leaf)[:1500]:
        chars, tokens = counter.build(text)
        assert sum(chars) == len(text)
        edits = []
        for _ in range(r.randint(0, 4)):
            start = r.randint(0, len(text))
            edits.append((start, start + r.randint(0, 12), "".join(r.choices(POOL, k=r.randint(0, 4)))))
        after, upto = text, len(text)
        for start, end, new in sorted(edits, reverse=True):
            start, end = min(start, upto), max(min(start, upto), min(end, upto))
            after, upto = after[:start] + new + after[end:], start
        count, _, size, got = counter.edited(text, chars, tokens, edits)
        assert (got, count) == (after, counter.count(after))
        assert size <= len(after)


def test_edits_touch_few_leaves():
    counter = edit_counts.Counter(vocabulary_path())
    text = " ".join(f"word{i}" for i in range(20_000))
    chars, tokens = counter.build(text)
    _, leaves, size, _ = counter.edited(text, chars, tokens, [(50_000, 50_004, "new text")])
    assert leaves == 1 and size < 500


def test_edit_query_of_awkward_rows(spark, library):
    docs = documents(spark).withColumn("text", F.concat("text", F.lit(" ann@mail.example +1 (068) 555-2748 https://a.b/c x")))
    masked = edit_counts.masks(docs, MASKS)
    out = edit_counts.updated(edit_counts.trees(masked), F.col("edits")).collect()
    for r in out:
        if r.text is None:
            assert (r.counted.tokens, r.edits) == (0, None)
            continue
        assert r.counted.text.endswith(" <mail> +<number> <link> x")
        assert r.counted.tokens == len(library([r.counted.text])[0])
        assert r.counted.tokens_before == len(library([r.text])[0])
    empty = edit_counts.masks(nothing(spark), MASKS)
    assert edit_counts.updated(edit_counts.trees(empty), F.col("edits")).count() == 0
