"""Near-duplicates and repeated strings against brute force."""

import collections
import hashlib
import random

import numpy as np

from logweir.llm import near_dups, suffix_dedup
from tests.llm.llm_helpers import documents, nothing, prose, rows


def classes_of(pairs_of_texts):
    """Union of equal and similar texts, all pairs compared."""
    sets = [near_dups.shingles(near_dups.words_of(t)) for t in pairs_of_texts]
    counts = np.zeros(near_dups.BUCKETS, np.uint64)
    for h, _ in sets:
        np.add.at(counts, near_dups.bucket(h), 1)
    idf = near_dups.weights_of(counts, len(sets))
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            (ha, ca), (hb, cb) = sets[a], sets[b]
            if near_dups.similarity((ha, ca.astype(float)), (hb, cb.astype(float)), idf) >= 0.8:
                parent[find(a)] = find(b)
    return [find(a) for a in range(len(sets))]


def variants():
    """Families of texts with some words replaced, and texts of their own."""
    r, texts = random.Random(1), []
    for family in range(8):
        words = prose(150, family).split(" ")
        texts.append(" ".join(words))
        for _ in range(10):
            own = list(words)
            for _ in range(r.choice([0, 1, 2, 4, 12])):
                own[r.randrange(len(own))] = f"word{r.random()}"
            texts.append(" ".join(own))
    return texts + [prose(90, 100 + k) for k in range(20)] + ["", " ", "a b", "a  b", "a c"]


def test_words_and_shingles():
    h = near_dups.words_of
    assert len(h("a b\tc\n d ")) == 4 and len(h(" ")) == len(h(None)) == 0
    assert (h("ab cd ab")[[0, 1]] == h("x ab cd")[[1, 2]]).all()
    long = "x" * 9000
    assert h(long)[0] != h(long + "x")[0] and h(long)[0] != h("y" + long[1:])[0]
    hashes, counts = near_dups.shingles(h("a b c d e a b c d e"))
    assert counts.sum() == 6 and counts.max() == 2 and (np.diff(hashes.astype(float)) > 0).all()
    assert len(near_dups.shingles(h("a b"))[0]) == 1


def test_draws_agree_as_often_as_sets():
    r = np.random.default_rng(0)
    common, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    sampler = near_dups.Sampler(draws=900)
    weights = lambda n: np.full(n, 1.2, np.float32)
    da = sampler.draw(np.concatenate([common, a]), weights(800))
    db = sampler.draw(np.concatenate([b, common]), weights(800))
    assert abs((da == db).mean() - 0.6) < 0.06
    # Weights count: what weighs three times as much is shared more often.
    heavy = lambda n, at: np.where(np.arange(n) < at, 3, 1).astype(np.float32)
    da = sampler.draw(np.concatenate([common, a]), heavy(800, 600))
    db = sampler.draw(np.concatenate([common, b]), heavy(800, 600))
    assert abs((da == db).mean() - 1800 / 2200) < 0.06


def test_classes_against_all_pairs(spark):
    texts = variants()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in near_dups.classes(docs).collect()}
    want = classes_of(texts)
    smallest = {}
    for i, c in enumerate(want):
        smallest.setdefault(c, i)
    assert [got[i].class_id for i in range(len(texts))] == [smallest[c] for c in want]
    assert [got[i].first for i in range(len(texts))] == [smallest[c] == i for i, c in enumerate(want)]
    kept = near_dups.kept(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(smallest.values())


def template_pages(n, small):
    """Pages alike by 0.6 to 0.79 as they stand, in small classes of copies that differ in some words."""
    r, shared, pages = random.Random(4), prose(320, 70), []
    for k in range(n // small):
        own = prose(52, 1000 + k)
        for _ in range(small):
            words = f"{shared} {own}".split(" ")
            for at in r.sample(range(10, 300), 2):
                words[at] = f"word{r.random()}"
            pages.append(" ".join(words))
    r.shuffle(pages)
    return pages


def smallest_ids(texts):
    want, smallest = classes_of(texts), {}
    for i, c in enumerate(want):
        smallest.setdefault(c, i)
    return [smallest[c] for c in want]


def test_all_pairs_of_large_buckets_are_compared(spark, monkeypatch):
    texts = template_pages(400, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = smallest_ids(texts)
    assert len(set(want)) == 200
    monkeypatch.setattr(near_dups, "BLOCK", 32)
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_a_pair_is_compared_although_the_first_round_links_nothing(spark):
    shared = prose(320, 70)
    texts = [f"{shared} {prose(45, 1000 + k)}" for k in range(30)]
    # In each bucket of the pair some other page meets the most.
    one = f"{shared} {prose(45, 2027)}".split(" ")
    texts += [" ".join(one), " ".join(one[:150] + ["other"] * 24 + one[174:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    assert [got[i] for i in range(32)] == smallest_ids(texts) == [*range(31), 30]


def test_awkward_rows(spark):
    docs = documents(spark)
    found = near_dups.classes(docs)
    assert found.count() == docs.count()
    kept = near_dups.kept(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id, (r.text or "")[:3]) for r in kept.collect() if r.doc_id is not None)
    # 2 and 3 go with 1; null and blank texts are copies of the null text of 4.
    assert [i for i, _ in ids] == [1, 4, 7, 8, 9, 10, 11, 12, 13]
    assert kept.where("doc_id is null").count() == 1
    assert near_dups.classes(nothing(spark)).count() == 0 and near_dups.kept(nothing(spark)).count() == 0


def repeated_bytes(raws, length=200):
    count = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    found = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        found.append(gone)
    return found


def removal(raw, gone):
    edges = np.diff(np.concatenate([[0], gone.astype(int)]))
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_removals_of_awkward_rows(spark):
    texts = [t for _, t, *_ in rows()]
    r = random.Random(3)
    base = prose(900, 50)
    for k in range(12):
        own = list(base[r.randrange(600) :][: r.randint(150, 3000)])
        for _ in range(r.randint(0, 8)):
            own[r.randrange(len(own))] = "é"
        texts.append(prose(20, 60 + k) + "".join(own))
    texts += ["ab" * 100, "ab" * 99 + "a", "é" * 100, "é" * 100, "y" * 199, "y" * 199, base + "z" * 250, prose(60, 8) + "日本" * 40]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, row int").repartition(4)
    raws = [(t or "").encode() for t in texts]
    want = {i: removal(raw, gone) for i, (raw, gone) in enumerate(zip(raws, repeated_bytes(raws)))}
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.removals(docs).collect()}
    assert got == want
    clean = suffix_dedup.deduplicated(docs)
    assert clean.columns == docs.columns
    assert all(
        hashlib.sha256((x.text or "").encode()).hexdigest() == want[x.doc_id][3] or "�" in x.text for x in clean.collect()
    )


def test_rows_without_id_and_no_rows(spark):
    docs = documents(spark)
    out = suffix_dedup.removals(docs)
    assert out.count() == docs.count()
    assert suffix_dedup.deduplicated(docs).count() == docs.count()
    same = [x for x in out.collect() if x.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1] and same[0].n_removed == same[0].n_bytes
    assert suffix_dedup.removals(nothing(spark)).count() == 0


def test_long_texts_have_the_anchors_of_their_parts(monkeypatch):
    raw = np.frombuffer(prose(20_000, 70).encode(), np.uint8)
    whole = suffix_dedup.anchors(raw)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4096)
    parts = suffix_dedup.anchors(raw)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and (whole[2] == parts[2]).all()


def test_queues_in_files_give_the_same(monkeypatch):
    r = random.Random(6)
    left = np.array([[r.choice(b"ab") for _ in range(suffix_dedup.REACH)] for _ in range(40)], np.uint8)
    right = left[:, ::-1].copy()
    order = sorted(range(40), key=lambda i: (i % 3, bytes(right[i])))
    groups = np.array([i % 3 for i in order])
    one = suffix_dedup.induced(groups, left[order], right[order])
    monkeypatch.setattr(suffix_dedup, "QUEUE_ROWS", 1)
    assert (suffix_dedup.induced(groups, left[order], right[order]) == one).all()


def test_a_text_is_hashed_by_one_python_node(spark):
    # A second one, in the same tasks, took another worker's memory for each of an executor's cores.
    docs = documents(spark)
    keys = spark.createDataFrame([(1, b"1")], "doc_id bigint, key binary")
    for found in (near_dups._sets(docs.select("doc_id", "text"), keys), near_dups.kept(docs)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_classes_take_few_jobs(spark):
    # The driver keeps something of every job, stage and task, and plans each stage anew: it took 79 jobs before.
    docs = spark.createDataFrame(list(enumerate(variants())), "doc_id bigint, text string").repartition(5)
    context = spark.sparkContext
    context.setJobGroup("jobs of classes", "")
    try:
        near_dups.kept(docs).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup("jobs of classes"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 65


def test_long_chains_of_links_are_one_class(spark, monkeypatch):
    # 120 links in a row and some apart, joined in parts of a few links by several tasks.
    chain = [b"%03d" % k for k in range(121)]
    random.Random(9).shuffle(chain)
    links = [*zip(chain, chain[1:]), (b"x", b"z"), (b"z", b"y"), (b"x", b"z"), (b"q", b"p")]
    random.Random(8).shuffle(links)
    monkeypatch.setattr(near_dups, "JOINED", 20)
    got = near_dups.components(spark.createDataFrame(links, "a binary, b binary").repartition(12), len(links)).collect()
    want = dict.fromkeys(chain, b"000") | {b"x": b"x", b"y": b"x", b"z": b"x", b"p": b"p", b"q": b"p"}
    assert {bytes(r.key): bytes(r["class"]) for r in got} == want and len(got) == len(want)


def test_links_of_the_last_round_are_kept(spark, monkeypatch):
    texts = variants()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    # No round finds enough to go on; what it has found counts, although a bucket's first hub is not met again.
    monkeypatch.setattr(near_dups, "FEW", 1e9)
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == smallest_ids(texts)
