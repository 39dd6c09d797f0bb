"""Passages at low identity, inside worse stretches, and with seeds that several earlier documents hold."""

import itertools
import random

import pytest

from strandline.llm.substring import repeated_passages


@pytest.fixture
def fresh_words():
    numbers = itertools.count()
    return lambda n: [f"w{next(numbers)}" for _ in range(n)]


def found(spark, docs):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    return repeated_passages(df).collect()


def test_recall_at_low_identity(spark, fresh_words):
    rng, docs, want = random.Random(2), [], []
    for n, changes in [*itertools.product((50, 55, 80), (5, 6, 7, 8)), *((55, None) for _ in range(30)), *((80, "drop") for _ in range(8))]:
        passage = fresh_words(n)
        places = rng.sample(range(1, n - 1), n // 5) if changes is None else range(4, n, 9) if changes == "drop" else range(changes - 1, n, changes)
        drop = changes == "drop"
        copy = [w if k not in places else fresh_words(1)[0] for k, w in enumerate(passage) if not (drop and k in places)]
        docs += [(len(docs), [*fresh_words(60), *passage, *fresh_words(60)]), (len(docs) + 1, [*fresh_words(70), *copy, *fresh_words(50)])]
        # words that agree, and what they span: changed words at the ends belong to no passage
        same = [k for k in range(n) if k not in places]
        if same[-1] - same[0] + 1 - (len(places) if drop else 0) >= 50:
            want.append(docs[-1][0])
    got = {r.doc_id: r for r in found(spark, docs)}
    assert len(want) > 40
    assert sorted(set(want) - set(got)) == []
    assert all(r.rep_doc_id == d - 1 and r.identity >= 0.8 for d, r in got.items())


def test_best_part_of_a_worse_stretch(spark, fresh_words):
    exact, few, tail = fresh_words(55), [fresh_words(4) for _ in range(2)], fresh_words(20)
    text = lambda: [*fresh_words(30), *exact, *fresh_words(8), *few[0], *fresh_words(8), *few[1], *fresh_words(8), *tail, *fresh_words(30)]
    (r,) = found(spark, [(1, text()), (2, text())])
    assert (r.doc_id, r.rep_doc_id, r.start_word) == (2, 1, 30) and 55 <= r.n_words <= 107 and r.n_same >= 55 and r.identity >= 0.8


def test_seeds_of_several_firsts(spark, fresh_words):
    p = fresh_words(60)
    got = found(spark, [(1, [*fresh_words(40), *p[:30], *fresh_words(40)]), (2, [*fresh_words(40), *p[30:], *fresh_words(40)]), (3, [*fresh_words(20), *p]), (4, [*p, *fresh_words(20)])])
    assert [(r.doc_id, r.rep_doc_id, r.start_word, r.end_word) for r in got] == [(4, 3, 0, 60)]
    scattered = [*itertools.chain(*([*p[i : i + 10], *fresh_words(30)] for i in range(0, 60, 10))), *p, *fresh_words(9)]
    (r,) = found(spark, [(1, scattered), (2, [*fresh_words(9), *p])])
    assert (r.doc_id, r.rep_doc_id, r.start_word, r.end_word, r.rep_start_word) == (2, 1, 9, 69, 240)


def test_exact_repeat_whose_parts_have_other_firsts(spark, fresh_words):
    a, b = fresh_words(40), fresh_words(40)
    both = lambda: [*fresh_words(30), *a, *b, *fresh_words(30)]
    halves = [(1, [*fresh_words(50), *a, *fresh_words(50)]), (2, [*fresh_words(50), *b, *fresh_words(50)])]
    assert [(r.doc_id, r.rep_doc_id, r.start_word, r.end_word) for r in found(spark, [*halves, (3, both()), (4, both())])] == [(4, 3, 30, 110)]
    # parts that overlap leave no border seed, and a third and a fourth hold the middle
    whole = [*a, *b]
    parts = [(i, [*fresh_words(40), *whole[lo:hi], *fresh_words(40)]) for i, (lo, hi) in enumerate([(0, 45), (35, 80), (20, 65), (10, 55)])]
    got = {(r.doc_id, r.rep_doc_id): (r.start_word, r.end_word) for r in found(spark, [*parts, (8, both()), (9, both())])}
    assert got[9, 8] == (30, 110)


def test_rows_that_share_an_id(spark, fresh_words):
    shared, other = fresh_words(90), fresh_words(300)
    got = found(spark, [(1, [*shared, *fresh_words(20)]), (2, other), (2, [*fresh_words(25), *shared])])
    assert [(r.doc_id, r.rep_doc_id, r.start_word, r.end_word) for r in got] == [(2, 1, 25, 115)]
    # two texts of one id that share a passage are two documents; identical rows are one
    got = found(spark, [(5, [*shared, *fresh_words(20)]), (5, [*fresh_words(25), *shared]), (6, other), (6, other)])
    assert [(r.doc_id, r.rep_doc_id, r.n_words) for r in got] == [(5, 5, 90)]
    assert got[0].version != got[0].rep_version


def test_every_exact_repeat_is_covered(spark):
    """Brute force over all texts: words of any 50 that a document with a smaller id holds, too, belong to passages."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").lower().encode().split() for r in docs.collect()}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(hash(tuple(texts[i][k : k + 50])), i)
    want = {(i, k + j) for i, t in texts.items() for k in range(len(t) - 49) if first[hash(tuple(t[k : k + 50]))] != i for j in range(50)}
    got = {(r.doc_id, w) for r in repeated_passages(docs).collect() for w in range(r.start_word, r.end_word)}
    assert len(want) > 30_000
    assert not want - got


@pytest.mark.parametrize(("how", "least"), [("change", {0.05: 1.0, 0.1: 1.0, 0.15: 0.97, 0.18: 0.95}), ("indel", {0.05: 1.0, 0.1: 0.97, 0.15: 0.95})])
def test_recall_by_rate_of_edits(spark, fresh_words, how, least):
    rng, docs, rate_of = random.Random(8), [], {}
    for rate in least:
        for _ in range(60):
            passage = fresh_words(100)
            copy = []
            for w in passage:
                hit = rng.random() < rate
                copy += [w] if not hit else fresh_words(1) if how == "change" else [] if rng.random() < 0.5 else [w, *fresh_words(1)]
            docs += [(len(docs), [*fresh_words(60), *passage, *fresh_words(60)]), (len(docs) + 1, [*fresh_words(70), *copy, *fresh_words(50)])]
            rate_of[len(docs) - 1] = rate
    got = {r.doc_id for r in found(spark, docs)}
    for rate, wanted in least.items():
        own = [d for d, x in rate_of.items() if x == rate]
        assert sum(d in got for d in own) >= wanted * len(own), rate
