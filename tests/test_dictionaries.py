"""Spelling, associations, set similarity and sketches against brute force."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.operators import dedup as D
from strandline.operators import dictionaries as Y
from strandline.operators import sketches as K
from strandline.plans import analytics  # noqa: F401  it fills the registry
from strandline.plans.registry import REGISTRY
from strandline.session import scratch_path
from strandline.sources.tables import query_log


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, before[j + 1] + 1, before[j] + (x != y)))
    return row[-1]


def test_corrections_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8)))
    terms = {word(): rng.randrange(1, 9) for _ in range(300)} | {"a" * 40: 5}
    asked = {word() for _ in range(120)} | {"", "z", "a" * 39}
    want = set()
    for w in asked - set(terms):
        near = sorted((d, -n, t) for t, n in terms.items() if len(t) <= 32 and len(w) <= 32 and (d := edits(w, t)) <= 2)
        want |= {(w, t, d, -n, i + 1) for i, (d, n, t) in enumerate(near[:3])}
    index = Y.delete_index(spark.createDataFrame(list(terms.items()), "term string, df long"))
    got = Y.corrections(spark.createDataFrame([(w,) for w in asked] * 2, "word string"), index)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_corrections_make_deletes_of_terms_within_reach(spark):
    """The same corrections as by an index of all terms, and no deletes of terms that are too short or too long for every word."""
    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 33))): rng.randrange(1, 9) for _ in range(400)}
    rows = spark.createDataFrame(list(terms.items()), "term string, df long")
    made = []
    for asked in (["abc", "abca", "cabbac", None], ["", "bb", "a" * 40], []):
        words = spark.createDataFrame([(w,) for w in asked] * 2, "word string")
        got = Y.corrections_of(words, rows)
        want = Y.corrections(words, Y.delete_index(rows)).collect()
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want}
        made.append(len(want))
    assert made[0] > 5


def test_associations_brute_force(spark):
    rng = random.Random(4)
    docs = [" ".join(rng.choice(["red", "blue", "green", "big", "sky", "x"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", "one"]
    n = Counter()
    for d in docs:
        t = [w for w in (d or "").split() if len(w) > 1]
        for i, j in itertools.combinations(range(len(t)), 2):
            if j - i <= 4 and t[i] != t[j]:
                n[tuple(sorted((t[i], t[j])))] += 1
    both = n + Counter({(b, a): k for (a, b), k in n.items()})
    alone = Counter()
    for (a, _), k in both.items():
        alone[a] += k
    want = {(a, b, k): pytest.approx(math.log(k * sum(alone.values()) / (alone[a] * alone[b]))) for (a, b), k in both.items() if k >= 5}
    pairs = Y.associations(spark.createDataFrame([(d,) for d in docs], "content string"))
    assert {(r.a, r.b, r.n): r.pmi for r in pairs.collect()} == want
    dictionary = Y.related_terms(pairs, least=-9.0, limit=2)
    got = Y.expanded_by(spark.createDataFrame([(1, "red sky"), (2, "nothing"), (3, None)], "id long, text string"), dictionary, ["id"])
    rows = {r.id: r.expansion for r in got.collect()}
    assert rows[2] == rows[3] == "" and rows[1] and not {"red", "sky"} & set(rows[1].split())


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_similar_sets_brute_force(spark, threshold):
    rng = random.Random(6)
    sets = {i: [f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(0, 12))] for i in range(150)}
    sets |= {200: [], 201: ["only"], 202: ["only", "only"], 203: ["only", "w1"]}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = set(sets[a]), set(sets[b])
        if x and y and len(x & y) / len(x | y) >= threshold:
            want[a, b] = pytest.approx(len(x & y) / len(x | y))
    got = D.similar_sets(spark.createDataFrame(list(sets.items()), "id long, items array<string>"), threshold)
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == want and (201, 202) in want


def test_sketched_ranks_are_bounded(spark):
    sf = "/root/testdata/sf0.1"
    path = scratch_path(spark, "test-sketches")
    K.write_sketches(K.daily_sketches(query_log(spark, sf), "timestamp", ["kind"], "latency_ms"), path)
    read = K.merged(spark, path, "2024-01-03", "2024-01-25", ["kind"])
    assert "events.parquet" not in read._jdf.queryExecution().toString()
    found = {r.kind: r for r in K.quantiles(read, ["kind"], p05=0.05, p50=0.5, p95=0.95).collect()}
    rows = query_log(spark, sf).where("to_date(timestamp) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' AND latency_ms IS NOT NULL").groupBy("kind").agg(F.collect_list("latency_ms").alias("v")).collect()
    for r in rows:
        got = found[r.kind]
        assert got.n == len(r.v)
        for share, x in ((0.05, got.p05), (0.5, got.p50), (0.95, got.p95)):
            assert sum(v < x for v in r.v) / len(r.v) - K.RANK_ERROR <= share <= sum(v <= x for v in r.v) / len(r.v) + K.RANK_ERROR
    assert REGISTRY["sketch_history"].run(spark, "/root/testdata/sf0.001").count() == 5


def test_nearest_rank_brute_force(spark):
    from strandline.operators import metrics as M

    rng = random.Random(9)
    inf = float("inf")
    groups = {"even": [rng.random() for _ in range(500)], "skew": [rng.paretovariate(0.3) for _ in range(400)], "same": [7.0] * 50, "one": [-3.5], None: [1.0, 2.0, 2.0, inf], "ends": [-inf, 0.0, 1.0, 5.0, inf, inf], "none": [None, None]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for share in (0.0, 0.5, 0.95, 1.0):
        want = {k: sorted(vs)[min(int(len(vs) * share), len(vs) - 1)] for k, vs in groups.items() if k != "none"}
        assert {r.k: r.p for r in M.nearest_rank(df, ["k"], "v", share, "p", bins=16).collect()} == want


def test_shingles_of_long_files(spark):
    from strandline.operators import changes as H

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh \n") for _ in range(100_000))
    df = spark.createDataFrame([(text,), ("abc",), ("",), ("abcdef",)], "t string").select("t", F.size(H.shingles(F.col("t"))).alias("n"))
    got = {len(r.t): r.n for r in df.collect()}
    assert got == {100_000: len({text[i : i + 5] for i in range(99_996)}), 3: 1, 0: 1, 6: 2}


def test_similar_sets_compare_few_pairs(spark):
    """Sets of two hundred items that all share frequent ones, near copies and equal copies: hardly more pairs are compared than found."""
    import glob

    rng = random.Random(8)
    sets = {i: sorted({int(rng.paretovariate(0.6)) % 3000 for _ in range(400)}) for i in range(120)}
    sets |= {200 + i: sets[i][: len(sets[i]) - 12] for i in range(20)} | {300 + i: sets[0] for i in range(60)}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(x := set(sets[a]) & set(sets[b])) >= 0.6 * (len(sets[a]) + len(sets[b]) - len(x))}
    before = set(glob.glob(f"{scratch_path(spark, '').rpartition('/')[0]}/met-sets-*"))
    got = D.similar_sets(spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in sets.items()], "id long, items array<string>"), 0.6)
    assert {(r.a, r.b) for r in got.collect()} == want
    (met,) = set(glob.glob(f"{scratch_path(spark, '').rpartition('/')[0]}/met-sets-*")) - before
    assert spark.read.parquet(met).count() < 1000 < len(want)  # of 9,730 pairs of different sets


def _shuffled(spark):
    context = spark._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


def _jaccards(sets, threshold):
    n = {(a, b): len(set(sets[a]) & set(sets[b])) for a, b in itertools.combinations(sorted(sets), 2)}
    found = {(a, b): i / (len(sets[a]) + len(sets[b]) - i) for (a, b), i in n.items() if i}
    return {p: pytest.approx(x) for p, x in found.items() if x >= threshold}


@pytest.mark.parametrize("threshold", [0.02, 0.3, 0.6, 0.9])
def test_similar_sets_in_small_blocks(spark, threshold, monkeypatch):
    """Bands of several blocks, tasks that sort and compare in many steps: all pairs of all sizes."""
    from strandline.operators import set_pairs

    for name, value in (("BLOCK_ITEMS", 400), ("MEETINGS", 60), ("PAIRS", 7), ("KNOWN_ITEMS", 20)):
        monkeypatch.setattr(set_pairs, name, value)
    rng = random.Random(4)
    sets = {i: sorted({int(rng.paretovariate(0.7)) % 500 for _ in range(rng.choice((1, 3, 12, 60, 150)))}) for i in range(90)}
    sets |= {100 + i: sets[i][rng.randrange(0, 4) :] + [900 + i] for i in range(60)}
    got = D.similar_sets(spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in sets.items()], "id long, items array<string>"), threshold)
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == _jaccards(sets, threshold)


def test_similar_sets_shuffle_no_pairs_that_only_meet(spark):
    """1,500 sets of two hundred items, nearly all pairs of which have some rare items in common: a million pairs meet, none leaves its task. Items are made once."""
    rng = random.Random(2)
    sets = {i: rng.sample(range(1500), 80) + rng.sample(range(2000, 2240), 120) for i in range(1500)}
    sets |= {2000 + i: sets[i][5:] for i in range(10)}
    made = spark.sparkContext.accumulator(0)

    def items(rows):
        for batch in rows:
            made.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in sets.items()], "id long, items array<string>").mapInPandas(items, "id long, items array<string>")
    before = _shuffled(spark)
    got = D.similar_sets(rows, 0.6).collect()
    assert {(r.a, r.b) for r in got} >= {(i, 2000 + i) for i in range(10)} and len(got) < 40
    assert made.value == len(sets)
    assert _shuffled(spark) - before < 6_000_000
