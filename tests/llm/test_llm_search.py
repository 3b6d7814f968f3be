"""Ranked search and whitening against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from logweir.llm import dual_tree, whitening
from tests.llm.llm_helpers import documents, nothing, prose, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_ranking(items, docs, top):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    out = []
    for item, text in items:
        terms = set(plain_terms(text))
        held = {t: sum(t in c for _, c in counted) for t in terms}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) for t in terms}
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // length
            score = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def ranked(spark, items, docs, **options):
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in dual_tree.ranked(items, docs, **options).collect()), key=str)


def test_terms():
    text = "The CAFÉ été\x00a-b_c9 \x85x  y \x7fÀz `q{r}"
    assert [t.decode() for t in dual_tree.terms_of(text)] == plain_terms(text)
    assert dual_tree.terms_of(None) == dual_tree.terms_of(" \t.") == []


def test_ranking_of_awkward_rows(spark):
    texts = [(r[0], r[1]) for r in rows()]
    items = [(1, texts[0][1][300:700]), (1, "and AND one"), (2, None), (3, ""), (None, "two same line"), (4, "zzznowhere")]
    items += [(5, "x" * 5000), (6, "The text without an id and")]
    got = ranked(spark, items, documents(spark))
    assert got == plain_ranking(items, texts, 10)
    assert ranked(spark, items, documents(spark), top=2, item_block=2) == plain_ranking(items, texts, 2)
    assert ranked(spark, items, nothing(spark)) == [] == ranked(spark, [], documents(spark))


def test_ranking_of_many_rows_with_copies(spark):
    r = random.Random(3)
    words = [prose(1, k) for k in range(300)]
    texts = [" ".join(r.choices(words[: r.choice([20, 300])], k=r.randint(1, 80))) for _ in range(900)]
    texts += [texts[5]] * 500 + [texts[6] + " extra"] * 200
    docs = [(i % 1400, t) for i, t in enumerate(texts)]
    r.shuffle(docs)
    items = [(k, " ".join(r.choices(words, k=r.randint(1, 40)))) for k in range(40)] + [(99, texts[5])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert ranked(spark, items, frame) == plain_ranking(items, docs, 10)


def test_bounds_leave_pairs_out():
    """Pages of many topics: most pairs of nodes are never scored, and nothing is lost."""
    r = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(40)]
    docs = [(i, Counter(r.choices(topics[i % 40], k=40))) for i in range(4000)]
    items = [(k, {t for t in r.choices(topics[k], k=12)}) for k in range(40)]
    numbers = {t: i for i, t in enumerate(sorted({t for x in topics for t in x}))}
    weight = np.full(len(numbers), 5000)
    tree = dual_tree.ItemTree([(k, np.array(sorted(numbers[t] for t in terms))) for k, terms in items], weight)
    search = dual_tree.Search(tree, weight, 4000, 160_000, 10)
    for at in range(0, 4000, 1000):
        some = docs[at : at + 1000]
        pairs = [(o, numbers[t], n) for o, (_, c) in enumerate(some) for t, n in c.items()]
        owners, terms, tf = (np.array(x) for x in zip(*pairs))
        search.show([i for i, _ in some], np.full(len(some), 40), owners, terms, tf)
    assert search.scored < 0.2 * 4000 * 40
    got = {}
    for row, doc, score in search.found():
        got.setdefault(row, []).append((doc, score))
    m = 100 - 90 + (90 * 40 * 4000) // 160_000
    for k, terms in items:
        every = [(sum(5000 * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c), i) for i, c in docs]
        every = sorted(((-s, i) for s, i in every if s))[:10]
        assert got[k] == [(i, -s) for s, i in every]


def test_scores_beyond_doubles_are_summed_as_longs():
    weight = np.array([1 << 40, 1])
    search = dual_tree.Search(dual_tree.ItemTree([(0, np.array([0, 1]))], weight), weight, 3, 30, 2)
    assert search.kind is np.int64
    search.show([7, 8, 9], np.array([10, 10, 10]), np.array([0, 1, 1, 2]), np.array([0, 0, 1, 1]), np.array([3, 3, 1, 1]))
    part = (10**9 * 3) // (3000 + 8 * 100)
    assert [(d, s) for _, d, s in search.found()] == [(8, (1 << 40) * part + 10**9 // 1800), (7, (1 << 40) * part)]


def embedded(spark, vectors):
    schema = "vec_id bigint, embedding array<float>, x int, Deviation string, label int"
    return spark.createDataFrame([(i, v, 1, "d", None) for i, v in vectors], schema)


def plain_whitened(vectors, k=4):
    dims = len(next(v for _, v in vectors if v))
    kept = [
        (i, [math.floor(256 * float(np.float32(c))) for c in v])
        for i, v in vectors
        if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    covariance = np.cov(fit.T, bias=True)
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    out = {}
    for row, (i, x) in enumerate(kept):
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out[row] = (i, n, deviation, ((np.array(x) - fit.mean(axis=0)) @ components) / np.sqrt(values))
    return out, values / np.trace(covariance)


def test_whitening_of_awkward_rows(spark):
    r = np.random.default_rng(4)
    base = (r.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2] + [1, -2, 0, 0, 9, 0]).tolist()
    vectors = [(k, v) for k, v in enumerate(base)]
    odd = [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] + [0.0] * 5)]
    odd += [(304, [float("inf")] + [0.0] * 5), (305, [1.0, 2.0])]
    copies = [(400 + k, base[7]) for k in range(500)] + [(7, base[7]), (None, base[8])]
    got = whitening.whitened(embedded(spark, vectors + odd + copies).repartition(3)).collect()
    plain, explained = plain_whitened(vectors + copies)
    assert len(got) == 4 * len(plain)
    by_id = {}
    for x in got:
        by_id.setdefault(x.vec_id, []).append(x)
    for name, n, deviation, w in plain.values():
        mine = [x for x in by_id[name] if x.deviation == deviation]
        assert {x.component for x in mine} == {1, 2, 3, 4} and all(x.n == n for x in mine)
        for x in mine:
            assert abs(x.whitened) == pytest.approx(abs(w[x.component - 1]), abs=1e-9)
            assert x.explained == pytest.approx(explained[x.component - 1], rel=1e-9)
            assert x.identity_error < 1e-9


def test_whitening_without_enough_vectors(spark):
    schema = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = whitening.whitened(embedded(spark, vectors))
        assert found.columns == schema and found.count() == 0
    # Two distinct vectors span one dimension.
    found = whitening.whitened(embedded(spark, [(1, [0.0, 0.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0])])).collect()
    assert sorted((x.vec_id, x.component, x.n) for x in found) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert all(abs(x.whitened) == pytest.approx(1) and x.explained == pytest.approx(1) for x in found)


def test_whitening_of_entries_beyond_a_long(spark):
    vectors = [(1, [1e18, 0.0]), (2, [-1e18, 1.0]), (3, [3.0, 5.0]), (4, [3e38, 1.0])]
    found = whitening.whitened(embedded(spark, vectors)).collect()
    assert {x.vec_id for x in found} == {1, 2, 3, 4} and all(x.deviation is None for x in found)
    vectors = [(1, [1e6, 0.0]), (2, [-1e6, 1.0]), (3, [3.0, 5.0])]
    plain, _ = plain_whitened(vectors, 2)
    found = whitening.whitened(embedded(spark, vectors)).collect()
    assert {(x.vec_id, x.deviation) for x in found} == {(i, d) for i, _, d, _ in plain.values()}


@pytest.mark.parametrize("dims", [1, 2, 7, 40])
def test_factorisation(dims):
    r = np.random.default_rng(dims)
    a = r.normal(size=(3 * dims, dims)) * (10.0 ** -np.arange(dims) if dims < 10 else 1)
    matrix = a.T @ a
    factor = whitening.pivoted_cholesky(matrix)
    assert factor @ factor.T == pytest.approx(matrix, rel=1e-9, abs=1e-12 * matrix.max())
    values, components = whitening.one_sided_jacobi(factor)
    exact = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    assert values == pytest.approx(exact, rel=1e-6) and len(values) >= min(dims, 6)
    assert components.T @ components == pytest.approx(np.eye(len(values)), abs=1e-12)
    assert matrix @ components == pytest.approx(components * values, abs=1e-10 * matrix.max())
