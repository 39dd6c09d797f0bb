"""Strong components, leaders, closures and rename candidates against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import changes as H
from strandline.operators import dedup as D
from strandline.operators import graph as R
from strandline.plans import structure  # noqa: F401  it fills the registry
from strandline.plans.registry import REGISTRY
from strandline.sources.tables import table


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {n} for n in nodes}
    grew = True
    while grew:
        grew = False
        for a, b in edges:
            new = out[b] - out[a]
            if new:
                out[a] |= new
                grew = True
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(100, 100), (200, 201), (201, 200)]
    far = reach(edges)
    want = {n: min(m for m in far[n] if n in far[m]) for n in far}
    got = R.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_a_dense_acyclic_graph_has_no_paths_to_follow(spark):
    edges = spark.createDataFrame([(i, j) for i in range(30) for j in range(i + 1, 30)], "src long, dst long")
    assert R.cycles(edges, longest=30).count() == 0
    assert {r.component for r in R.strong_components(edges).collect()} == set(range(30))
    assert R.strong_components(edges.where("false")).count() == 0


def test_strong_components_of_long_rings_and_chains(spark):
    """A ring of 250 nodes, 20 pairs of which each leads to the next one, and a way into the ring: jobs don't follow the ways."""
    ring = [(i, i - 1) for i in range(1, 250)] + [(0, 249), (900, 249)]
    pairs = [e for i in range(300, 340, 2) for e in ((i, i + 1), (i + 1, i), (i + 1, i + 2))]
    spark.sparkContext.setJobGroup("long-rings", "")
    try:
        got = {r.node: r.component for r in R.strong_components(spark.createDataFrame(ring + pairs, "src long, dst long")).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long-rings"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {n: 0 for n in range(250)} | {n: n - n % 2 for n in range(300, 340)} | {340: 340, 900: 900}
    assert jobs < 600


def test_leaders_in_rounds_brute_force(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)} | {(100 + i, 101 + i) for i in range(12)}
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    taken, want = set(), set()
    for a in sorted(after):
        if a not in taken:
            mine = [b for b in after[a] if b not in taken]
            taken |= {a, *mine}
            want |= {(a, b) for b in mine}
    got = D.greedy_leaders(spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert {(r.leader, r.member) for r in got.collect()} == want
    assert D.greedy_leaders(spark.createDataFrame([], "a long, b long")).count() == 0


def test_closure_and_path_over_stored_edges(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (1, 3), (3, 4), (4, 5), (9, 0)], "src long, dst long")
    start = spark.createDataFrame([(0,), (0,)], "node long")
    assert {(r.node, r.depth) for r in R.reachable(edges, start).collect()} == {(1, 1), (2, 2), (3, 2), (4, 3), (5, 4)}
    assert {(r.node, r.depth) for r in R.reachable(edges, start, 2).collect()} == {(1, 1), (2, 2), (3, 2)}
    assert R.reachable(edges, start.where("false")).count() == 0
    paths = [(r.path, r.hops) for r in R.shortest_path(edges, 0, 5).collect()]
    assert paths == [([0, 1, 3, 4, 5], 4)] and R.shortest_path(edges, 5, 0).count() == 0 and R.shortest_path(edges, 3, 3).first().hops == 0
    assert R.shortest_path(edges, 0, 5, depth=3).count() == 0


def test_renames_of_all_pairs(spark):
    """Every pair of benchmark texts, edited by words, letters and moved parts, against a comparison of all with all."""
    rng = random.Random(5)
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "benchmark").orderBy("item_id").collect()]

    def edited(t):
        share = rng.choice([0.02, 0.05, 0.1, 0.15])
        if rng.random() < 0.5:
            return "".join(rng.choice("xyz ") if rng.random() < share else c for c in t)
        return " ".join(w for w in (rng.choice(["", "new", w + "s"]) if rng.random() < share else w for w in t.split(" ")) if w)

    old = [(f"old/{i}", t) for i, t in enumerate(texts)] + [("old/empty", ""), ("old/short", "ab"), ("old/null", None)]
    new = [(f"new/{i}", edited(t)) for i, t in enumerate(texts)] + [("new/empty", ""), ("new/short", "ab"), ("new/same", texts[0])]
    best = {}
    for p, a in old:
        for q, b in new:
            a_, b_ = a or "", b or ""
            if min(len(a_), len(b_)) / max(len(a_), len(b_), 1) >= 0.5 or not a_ and not b_ and a is not None:
                s = difflib.SequenceMatcher(None, a_, b_).ratio()
                if s >= 0.8 and (p not in best or (-s, q) < best[p]):
                    best[p] = (-s, q)
    kind = "path string, content string"
    got = {r.old_path: (-r.similarity, r.new_path) for r in H.renames(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).collect()}
    assert len(best) > 20 and {p: x for p, x in got.items() if p != "old/empty"} == {p: x for p, x in best.items() if p != "old/empty"}
    pairs = H.rename_candidates(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind))
    assert pairs.count() < len(old) * len(new) / 2


def test_calls_are_found(spark, sf):
    calls = REGISTRY["call_edges"].run(spark, sf)
    assert calls.count() > 100 and calls.where(F.col("dst").startswith("unknown")).count() == 0
