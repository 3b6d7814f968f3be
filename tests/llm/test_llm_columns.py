"""Rules, classifier, shards, top-k and quoted messages: edges and plain versions."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from logweir.llm import fm_quality, quality_rules, quote_links, sharding, topk
from tests.llm.llm_helpers import documents, nothing, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    seen, repeated = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeated.update(j for i in places for j in range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
    )


def test_rule_counts_of_awkward_rows(spark):
    docs = documents(spark)
    got = quality_rules.measured(docs, "m").collect()
    assert set(got[0].asDict()) == {*docs.columns, "m"}
    for r in got:
        m = r.m
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == plain_counts(r.text or ""), r.doc_id
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 3, 7, 12]
    assert quality_rules.accepted(nothing(spark)).count() == 0


def test_divergence_tells_prose_from_junk(spark):
    r = random.Random(2)
    common = quality_rules.COMMON_WORDS["en"]

    def english(n, seed):
        words = prose(n, seed).split(" ")
        return " ".join(r.choice(common) if r.random() < 0.4 else w for w in words)

    good = [english(200, k) for k in range(60)]
    shouting = [" ".join(w.upper() + "!!" for w in english(200, 90 + k).split(" ")) for k in range(3)]
    tables = [" | ".join(prose(200, 95 + k).split(" ")) for k in range(3)]
    texts = good + shouting + tables
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    assert sorted(x.doc_id for x in quality_rules.accepted(docs).collect()) == list(range(60))


def test_distance():
    assert quality_rules.distance_in([1, 1], [5, 5]) == 0
    assert quality_rules.distance_in([1, 0], [0, 9]) == pytest.approx(1)


def test_sum_of_squares_is_the_sum_over_pairs():
    r = np.random.default_rng(1)
    model = fm_quality.Model(0.3, r.normal(size=50), r.normal(size=(50, 4)))
    at, x = np.array([3, 9, 20, 41]), np.array([0.5, -1.0, 2.0, 0.1])
    pairs = sum(
        float(model.factors[at[i]] @ model.factors[at[j]]) * x[i] * x[j] for i, j in itertools.combinations(range(4), 2)
    )
    assert model.margin(at, x)[0] == pytest.approx(0.3 + float(model.linear[at] @ x) + pairs)


def test_classifier_learns_from_the_open_part_only(spark):
    r, texts, labels = random.Random(5), [], []
    for i in range(500):
        good = r.random() < 0.6
        texts.append((i, prose(60, i) if good else prose(60, i).upper() + " ###" * 8, None if i % 50 == 0 else 400))
        # Labels of held-out documents are wrong: they must not matter.
        open_ = zlib.crc32(str(i).encode()) % 3 != 1
        labels.append((i, int(good) if open_ else int(not good)))
    labels += [(0, None), (None, 1)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, n_chars bigint")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = fm_quality.train(docs, known)
    out = {x.doc_id: x.score for x in fm_quality.scored(docs, model).collect()}
    truth = {i: q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q for i, q in labels[:500]}
    assert np.mean([(out[i] >= 0.5) == truth[i] for i in truth]) > 0.97
    awkward = fm_quality.scored(documents(spark), model).collect()
    assert len(awkward) == len(rows()) and all(0 <= x.score <= 1 for x in awkward)
    assert fm_quality.scored(nothing(spark), model).count() == 0
    one_label = fm_quality.train(docs, known.where("quality = 1"))
    assert fm_quality.scored(docs, one_label).where("score <> 0.5").count() == 0


def test_a_repeated_document_is_learned_from_once(spark, monkeypatch):
    texts = [(i % 20, prose(40, i), 100 + i) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    collect, collected, models = type(labels).collect, [], []
    monkeypatch.setattr(type(labels), "collect", lambda df: collected.append(collect(df)) or collected[-1])
    for order in (texts, texts[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, n_chars bigint")
        models.append(fm_quality.train(docs, labels))
    assert (models[0].linear == models[1].linear).all() and (models[0].mean == models[1].mean).all()
    assert all(len(c) <= 20 for c in collected)


def test_the_pipeline_learns_from_documents_that_the_rules_reject(spark, tmp_path):
    texts = [(i, prose(60, i) if i % 2 else prose(60, i).upper() + " ###" * 8, "en", "s", 400) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    # No labelled document that is bad comes through; two without a label do.
    more = [(1000, texts[0][1], "en", "s", 400), (1001, prose(60, 1001).upper() + " ###" * 8, "en", "s", 400)]
    left = docs.where("doc_id % 2 = 1").unionByName(spark.createDataFrame(more, docs.schema))
    got = sorted(r.doc_id for r in corpus_pipeline.classifier(spark, left, str(tmp_path)).collect())
    assert got == list(range(1, 300, 2))


def shard_rows(found, count):
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(count))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {k: sum(r.size for r in own) for k, own in by.items()}


def test_shards_are_even_though_a_text_is_a_third(spark):
    hot, r = prose(40, 1), random.Random(3)
    texts = [hot if i % 3 == 0 else prose(r.randint(1, 80), i) for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = sharding.shards(docs, 16).collect()
    sizes = shard_rows(found, 16)
    assert len(found) == 3000 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in found)
    for r in found:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    again = sharding.shards(docs.repartition(7), 16, per_range=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found)), "samples do not decide where a row goes"


def test_overfull_ranges_are_subdivided(spark):
    key = [(k, 0, 0, 10 if k != 50 else 2000, 10 if k != 50 else 2000) for k in range(100)]
    # Many rows of one key, half of them equal in the tie as well.
    key += [(60, t if t % 2 else 7, t + 1, 10, 10) for t in range(500)]
    frame = spark.createDataFrame(key, "key bigint, tie bigint, row bigint, size bigint, weight bigint")
    total = sum(w for *_, w in key)
    found, sizes = sharding.splitters_of(frame, 8, 1, total)
    assert found == sorted(found) and sum(s["n"] for s in sizes if s) == len(key)
    # A single row cannot be divided; the many rows of one key can.
    assert sorted(s["weight"] for s in sizes if s)[-2] <= 2 * total / 8 + 10


def test_equal_rows_without_an_id_are_divided(spark):
    docs = spark.range(4000).selectExpr("cast(null as bigint) as doc_id", "'the same text' as text")
    sizes = shard_rows(sharding.shards(docs, 16).collect(), 16)
    assert set(sizes.values()) == {250 * 14}
    rows = docs.selectExpr("5L as key", "0L as tie", "monotonically_increasing_id() as row", "14L as size", "28L as weight")
    _, found = sharding.splitters_of(rows, 8, 16, 4000 * 28)
    assert max(s["n"] for s in found if s) <= 1100


def test_shards_of_awkward_rows(spark):
    found = sharding.shards(documents(spark), 4).collect()
    shard_rows(found, 4)
    assert sorted((r.doc_id or -1, r.size) for r in found) == sorted((i or -1, len((t or "").encode()) + 1) for i, t, *_ in rows())
    assert sharding.shards(nothing(spark), 4).count() == 0


def best(vectors, queries, top):
    out = []
    for q, x in queries:
        scored = sorted((-int(np.dot(x, y)), v) for v, y in vectors if v != q and len(y) == len(x))
        out += [(q, k + 1, v, -s) for k, (s, v) in enumerate(scored[:top])]
    return sorted(out)


@pytest.mark.parametrize("fragments", [1, 2, 3])
def test_top_scores_against_all_pairs(spark, fragments):
    r = np.random.default_rng(fragments)
    data = [(i, [float(x) for x in r.normal(0, 0.2, 7)]) for i in range(300)]
    data += [(400 + i, data[3][1]) for i in range(60)]  # copies, more than the result holds
    data += [(500, [1.0, float("nan")] + [0.0] * 5), (501, None), (502, [None] * 7), (503, [float("inf")] * 7), (504, [0.5] * 4), (None, data[0][1])]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    whole = topk.whole_vectors(frame)
    exact = [(x.vec_id, np.array(x.v)) for x in whole.collect()]
    assert len(exact) == 361
    assert all((np.array(v) == [math.floor(64 * np.float32(c)) for c in data[i][1]]).all() for i, v in exact if i < 300)
    queries = [(i, v) for i, v in exact if i % 20 == 0]
    got = topk.top_scores(whole, whole.where("vec_id % 20 = 0"), 5, fragments, vector_block=100, query_block=6)
    assert sorted(map(tuple, got.collect())) == best(exact, queries, 5)
    few = whole.where("vec_id < 3")
    assert topk.top_scores(few, few, 5, fragments).count() == 6
    assert topk.top_scores(whole.limit(0), whole.limit(0), 5).count() == 0


@pytest.mark.parametrize("repeated", ["equal", "different", "queries"])
def test_top_scores_of_repeated_ids(spark, repeated):
    r = np.random.default_rng(3)
    some = lambda: [float(x) for x in r.normal(0, 0.4, 8)]
    data = [(i, some()) for i in range(120)]
    more = {"equal": data, "different": [(i, some()) for i in range(120)], "queries": []}[repeated]
    whole = topk.whole_vectors(spark.createDataFrame(data + more, "vec_id bigint, embedding array<float>"))
    asked = whole.where("vec_id % 2 = 0")
    asked = asked.unionByName(asked) if repeated == "queries" else asked
    vectors, queries = ([(x.vec_id, np.array(x.v)) for x in f.collect()] for f in (whole, asked))
    want = []
    for q in sorted({i for i, _ in queries}):
        # Rows are candidates of their own, and each row of a query has its own pairs.
        scored = sorted((-int(x @ y), v) for i, x in queries if i == q for v, y in vectors if v != q)
        want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(scored[:4])]
    got = topk.top_scores(whole, asked, 4, 2, vector_block=50, query_block=6)
    assert sorted(map(tuple, got.collect())) == want


def test_few_pairs_are_resolved():
    """Signed components: the cutoff from named candidates leaves less than a tenth of the pairs."""
    r = np.random.default_rng(6)
    v = np.floor(64 * r.normal(0, 0.4, (4000, 64))).astype(np.int64)
    ids, queries = np.arange(4000), np.arange(0, 4000, 40)
    rows, scores = topk.named(ids, v, queries, v[::40], 20, 2, False)
    cutoffs = np.array([np.sort(scores[rows == k])[-20] for k in range(100)])
    (rows, found, scores), pairs = topk.resolved(ids, v, queries, v[::40], cutoffs, 2, False)
    assert pairs < 0.1 * 4000 * 100
    for k in range(100):
        every = sorted(((int(v[40 * k] @ v[i]), -i) for i in ids.tolist() if i != 40 * k), reverse=True)[:20]
        mine = sorted(((s, -i) for s, i in zip(scores[rows == k].tolist(), found[rows == k].tolist())), reverse=True)[:20]
        assert mine == every


def test_scores_beyond_exact_doubles(spark):
    r = np.random.default_rng(8)
    data = [(i, [float(np.float32(x)) for x in r.normal(0, 0.4, 6)]) for i in range(60)]
    data += [(100 + i, [float(np.float32(x)) for x in r.normal(0, 3e6, 6)]) for i in range(30)]
    data += [(200, [1e9] * 6), (201, [-1e9] * 6), (202, [3e38] + [0.0] * 5), (203, [])]
    whole = topk.whole_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<float>"))
    got = {}
    for x in topk.top_scores(whole, whole, 7, 2, vector_block=40, query_block=11).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    vectors = {x.vec_id: list(x.v) for x in whole.collect()}
    for q, a in vectors.items():
        every = []
        for i, b in vectors.items():
            if i != q and len(a) == len(b):
                score = sum(x * y for x, y in zip(a, b))
                every.append((-min(max(score, -(2**63)), 2**63 - 1), i))
        assert sorted(got.get(q, [])) == [(k, i, -s) for k, (s, i) in enumerate(sorted(every)[:7], 1)], q


def test_quoted_messages(spark, monkeypatch):
    monkeypatch.setattr(quote_links, "BLOCK", 2)
    said = [
        (1, 0, "u", "Hello all\nsecond  line"),
        (1, 1, "a", "I agree\n> hello ALL\n> second line"),
        (1, 2, "u", "Why?\n> I agree\n> > Hello all\n>> second line"),
        (1, 3, "a", "Other branch\n> second line"),
        (1, 4, "u", "> not said before"),
        (1, 5, "u", None),
        (1, 5, "u", None),
        (2, 0, "u", "I agree"),
        (2, 7, "a", "Me too\n\n> I agree"),
        (None, 1, "u", "x\n> y"),
        (3, None, "u", "z"),
    ]
    frame = spark.createDataFrame([(*s, 1) for s in said], "conv_id bigint, turn bigint, role string, text string, line int")
    got = {(r.conv_id, r.turn): r for r in quote_links.conversations(frame).collect()}
    links = {k: (r.reply_to, r.root, r.depth, r.position) for k, r in got.items()}
    assert links == {
        (1, 0): (None, 0, 0, 0), (1, 1): (0, 0, 1, 1), (1, 3): (0, 0, 1, 2), (1, 2): (1, 0, 2, 3),
        (1, 4): (None, 4, 0, 4), (1, 5): (None, 5, 0, 5), (2, 0): (None, 0, 0, 0), (2, 7): (0, 0, 1, 1),
        (None, 1): (None,) * 4, (3, None): (None,) * 4,
    }
    assert [got[1, 2].body, got[1, 2].quoted, got[1, 2].levels] == ["Why?", 3, 2]
    assert got[2, 7].body == "Me too\n" and got[1, 5].body == ""
    assert quote_links.conversations(frame).count() == len(said)
    assert quote_links.conversations(frame.limit(0)).count() == 0


def test_a_long_thread_with_one_common_line(spark, monkeypatch):
    monkeypatch.setattr(quote_links, "BLOCK", 8)
    frame = spark.createDataFrame([(9, t, "u", f"thanks\nnumber {t}") for t in range(60)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: r for r in quote_links.conversations(quote_links.as_mails(frame)).collect()}
    # Of the two lines quoted one leads to the turn before; ties go to the later turn.
    assert [got[t].position for t in range(60)] == list(range(60))
    assert all(got[t].reply_to == t - 1 for t in range(1, 60))
    assert got[30].body == "thanks\nnumber 30"


def test_deeper_quotes_link_where_the_first_level_leads_nowhere(spark):
    said = [
        (1, 0, "u", "First words"),
        (1, 1, "a", None),
        (1, 2, "u", "Third\n> edited beyond knowing\n> > first  WORDS"),
        (1, 3, "u", "Fourth\n> Third\n> > First words"),
    ]
    frame = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: (r.reply_to, r.root, r.depth) for r in quote_links.conversations(frame).collect()}
    assert got == {0: (None, 0, 0), 1: (None, 1, 0), 2: (0, 0, 1), 3: (2, 0, 2)}


def test_a_conversation_of_roots_only(spark):
    """No window holds a row for each root: positions still count through."""
    rows = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "'u' as role", "concat('text ', id) as text")
    found = quote_links.conversations(rows)
    assert found.where("position <> turn or root <> turn or reply_to is not null").count() == 0
    assert found.count() == 20_000


def test_mails_of_a_table_with_clashing_columns(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, said string, c int, t int, mail string, at int, lines int"
    frame = spark.createDataFrame([(1, k, "u", f"text {k}", "x", 1, 2, "m", 3, 4) for k in range(4)], schema)
    mails = quote_links.as_mails(frame)
    assert mails.columns == ["conv_id", "turn", "role", "text"]
    assert {r.turn: r.text for r in mails.collect()}[2] == "text 2\n> text 1\n> > text 0"
