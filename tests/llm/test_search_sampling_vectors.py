"""Operators 11 to 13 against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def items(spark, odd_docs):
    texts = [r.text for r in odd_docs.select("text").collect() if r.text]
    rows = [(1, "alpha3 BETA7 délta1 unknownterm"), (2, None), (3, ""), (4, texts[0]), (5, "same line here same"), (6, texts[3]), (7, "alpha1 alpha2"), (7, "alpha2 gamma9"), (None, "the4 of5 and6 42 İ"), (8, " ,;- ")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, term string, doc_id int")


# 11


def brute_search(docs, items, k=50):
    docs = [(i, terms_of(t)) for i, t in docs]
    docs = [(i, w, Counter(w)) for i, w in docs if w]
    n_docs, n_terms = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms_of(t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, w, c in docs:
            m = 50 + (50 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return Counter(out)


def pairs_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_search_brute_force(spark, odd_docs, no_docs, items):
    from strandline.llm.lexical import ranked_search

    docs, wanted = pairs_of(odd_docs, "doc_id", "text"), pairs_of(items, "item_id", "text")
    assert Counter(map(tuple, ranked_search(odd_docs, items).collect())) == brute_search(docs, wanted)
    assert Counter(map(tuple, ranked_search(odd_docs, items, k=3).collect())) == brute_search(docs, wanted, 3)
    assert ranked_search(no_docs, items).count() == 0 and ranked_search(odd_docs, items.where("false")).count() == 0


def test_search_of_many_shards_groups_and_ties(spark, monkeypatch):
    from strandline.llm import lexical

    monkeypatch.setattr(lexical, "SHARD_DOCS", 150)
    monkeypatch.setattr(lexical, "GROUP_TERMS", 20)
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))
    hot = text(30)
    docs = [(i, text(rng.randrange(1, 60))) for i in range(1500)] + [(5000 + i, hot) for i in range(900)] + [(None, hot)] * 3
    wanted = [(i, text(12)) for i in range(15)] + [(90, hot), (91, "w1")]
    rng.shuffle(docs)
    got = lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(wanted, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_search(docs, wanted)


def test_blocks_below_the_threshold_stay_compressed():
    import pyarrow as pa

    from strandline.llm.lexical import BLOCK, INDEX_ARROW, Lists, Shard
    from strandline.llm.terms import batch_terms

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(20)) + (" rare" * 9 if 7000 <= i < 7060 else "") for i in range(8000)]
    terms, counts = batch_terms(pa.array([t.encode() for t in texts]))
    shard, corpus = Shard(), (len(texts), len(terms))
    shard.add(pa.array(range(8000)), counts, terms)
    lists = Lists(pa.Table.from_batches(list(shard.rows(0, corpus)), INDEX_ARROW), corpus)
    scores, places = lists.best([(b"rare", 5000), *((c.encode(), 10) for c in "abcdefgh")], 50, 0)
    assert len(lists.first) > 8000 // BLOCK * 7 and len(lists.open) < len(lists.first) / 10
    assert all(7000 <= p < 7060 for p in places) and (np.diff(scores) <= 0).all()


def test_packing_round_trip():
    from strandline.llm.lexical import packed, unpacked

    rng = np.random.default_rng(2)
    runs = [rng.integers(0, 1 << b, n) for b, n in ((1, 64), (8, 3), (9, 64), (16, 1), (17, 64), (31, 5))]
    data = packed(np.concatenate(runs), np.cumsum([0, *map(len, runs)])[:-1]).to_pylist()
    assert [len(d) // len(r) for d, r in zip(data, runs, strict=True)] == [1, 1, 2, 2, 4, 4]
    assert all((unpacked(d, len(r)) == r).all() for d, r in zip(data, runs, strict=True))


# 12


def features_of(text):
    w = terms_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute_resampling(docs, target, share=(5, 100), buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features_of(x)[0]) for texts in ([d for _, d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, x in docs:
        f, n = features_of(x)
        weight = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * share[0] // share[1]]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_brute_force(spark, odd_docs, no_docs, items):
    from strandline.llm.resampling import importance_resampling

    docs, target = pairs_of(odd_docs, "doc_id", "text"), [t for (t,) in pairs_of(items, "text")]
    for share in ((5, 100), (1, 2), (1, 1)):
        got = importance_resampling(odd_docs, items, share).collect()
        assert Counter(map(tuple, got)) == brute_resampling(docs, target, share)
    assert importance_resampling(no_docs, items).count() == 0
    assert Counter(map(tuple, importance_resampling(odd_docs, items.where("false")).collect())) == brute_resampling(docs, [])


def test_resampling_of_equal_rows(spark):
    from strandline.llm.resampling import importance_resampling

    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(10, 40)))
    docs = [(i, text()) for i in range(800)] + [(None, docs_text := text() + " a" * 20)] * 700 + [(7, docs_text)] * 40
    got = importance_resampling(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame([(text(),) for _ in range(20)], "text string"), (1, 2)).collect()
    assert len(got) == len(docs)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(drawn) + 1)) and len(drawn) == sum(len(terms_of(t)) >= 20 for _, t in docs) // 2
    assert all((-a.score, a.doc_id is None, a.doc_id or 0) <= (-b.score, b.doc_id is None, b.doc_id or 0) for a, b in zip(drawn, drawn[1:], strict=False))


def test_hashes_of_runs():
    import pyarrow as pa

    from strandline.llm.resampling import batch_buckets

    texts = ["", "one", "Über die Brücke 中文🙂 x", "y" * 5000 + " z " + "é" * 70 + " " + "y" * 5000, "a b", "A\tB,c"]
    bucket, doc, counts = batch_buckets(pa.array([t.encode() for t in texts]).slice(0), 10_000)
    assert counts.tolist() == [len(terms_of(t)) for t in texts]
    got, want = Counter(zip(doc.tolist(), bucket.tolist(), strict=True)), Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in features_of(t)[0])
    assert got == want


def test_resampling_prefers_the_target(spark):
    from strandline.llm.resampling import importance_resampling

    rng = random.Random(8)
    near = lambda: " ".join(f"t{rng.randrange(60)}" for _ in range(40))
    far = lambda: " ".join(f"o{rng.randrange(60)}" for _ in range(40))
    docs = [(i, near() if i % 10 == 0 else far()) for i in range(500)]
    got = importance_resampling(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(near(),) for _ in range(30)], "text string")).collect()
    assert all(r.doc_id % 10 == 0 for r in got if r["rank"]) and sum(r["rank"] is not None for r in got) == 25


# 13


def brute_links(rows, threshold=0.95):
    able = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = defaultdict(list)
    for n, i in enumerate(able):
        for j in able[n + 1 :]:
            a, b = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
            if len(a) == len(b) and float(a / np.abs(a).max() @ (b / np.abs(b).max())) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()) >= threshold:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((vec_id, len(near[i]), min(ids) if ids else None, vec_id is not None and vec_id == min(ids)))
    return Counter(out)


def planted(rng, n, sizes=(8, 8, 5)):
    """Vectors around others at cosines from 0.93 to 1, and alone."""
    out = []
    for size in sizes:
        for _ in range(n):
            v = rng.standard_normal(size)
            out.append(v)
            for c in rng.uniform(0.93, 1.0, 2):
                w = rng.standard_normal(size)
                w -= w @ v / (v @ v) * v
                out.append(c * v / np.linalg.norm(v) + math.sqrt(1 - c * c) * w / np.linalg.norm(w))
    return out


def test_vector_links_on_odd_rows(spark):
    from strandline.llm.vector_links import near_vectors

    rng = np.random.default_rng(3)
    vectors = [v.tolist() for v in planted(rng, 12, (64, 64, 30))]
    nan, inf = float("nan"), float("inf")
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200, None), (201, []), (202, [0.0] * 64), (203, [1.0, None]), (204, [nan, 1.0]), (205, [inf, 1.0]), (None, vectors[0]), (None, None), (206, [5.0]), (207, [1e300]), (208, [-1.0])]
    rows += [(3, vectors[5]), (3, vectors[5]), (300, [-x for x in vectors[9]]), (301, [1e-200 * x for x in vectors[9]]), (302, vectors[9]), (302, vectors[9]), (None, [0.5, 0.5]), (None, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<double>, label long, v string")
    assert Counter(map(tuple, near_vectors(df.repartition(4)).select("vec_id", "n_links", "component_id", "kept").collect())) == brute_links(rows)
    assert near_vectors(df.where("false")).count() == 0


def test_vector_recall_at_the_threshold(spark):
    """Pairs at a cosine of exactly 0.95 to 0.96, the hardest ones, at the registered parameters."""
    from strandline.llm.vector_links import near_vectors

    rng = np.random.default_rng(5)
    rows, pairs = [], 600
    for i in range(pairs):
        v, w = rng.standard_normal(64), rng.standard_normal(64)
        v /= np.linalg.norm(v)
        w -= w @ v * v
        c = rng.uniform(0.9501, 0.96)
        rows += [(2 * i, v.tolist()), (2 * i + 1, (c * v + math.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist())]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) / 2 >= 0.96 * pairs
    assert all(r.component_id in (r.vec_id, r.vec_id - r.vec_id % 2) for r in got)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    from strandline.llm import vector_links

    rng = np.random.default_rng(9)
    centre = rng.standard_normal(64)
    near = [(i, (centre + 0.01 * rng.standard_normal(64)).tolist()) for i in range(700)]
    rows = near + [(1000 + i, rng.standard_normal(64).tolist()) for i in range(100)] + [(2000 + i, near[5][1]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    distinct = df.where("vec_id < 2000").selectExpr("vec_id AS uid", "1L AS n", "embedding AS v")
    held = vector_links.stored(vector_links.with_buckets(distinct, 6, 9, 1), "test-buckets")
    links = vector_links.counted_links(held, 9, 0.95, block_rows=100).groupBy("uid").sum("links").collect()
    assert sorted(map(tuple, links)) == [(i, 699) for i in range(700)]
    got = {r.vec_id: r for r in vector_links.near_vectors(df).collect()}
    assert all(got[i].n_links == 999 and got[i].component_id == 0 for i in [*range(700), *range(2000, 2300)])
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(100))
