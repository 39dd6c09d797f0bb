"""The stored index, the stream that resumes, jobs, caches and ids, on small fixtures."""

import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.operators import keyword_index as N
from strandline.operators import search as S
from strandline.operators import upkeep as U
from strandline.session import scratch_path


def test_index_versions(spark, tmp_path):
    rows = [(1, "alpha beta beta"), (2, "beta gamma"), (3, ""), (4, None), (5, "alpha alpha alpha delta")]
    docs = spark.createDataFrame(rows, "id long, content string")
    path = str(tmp_path / "index")
    assert N.versions(spark, path) == []
    assert N.write_index(docs.where("id < 3"), path) == 1 and N.write_index(docs, path) == 2
    (tmp_path / "index" / "v3" / "postings").mkdir(parents=True)  # a version that was never finished
    assert N.versions(spark, path) == [1, 2]
    f = N.figures(spark, path).first()
    assert (f.n_docs, f.n_tokens, f.n_terms) == (5, 9, 4)
    for q in ("alpha beta", "beta beta", "nothing", "", "ALPHA, delta!"):
        for delta in (None, 1.0):
            scan = {r.id: pytest.approx(r.bm25) for r in S.bm25_scores(docs, q, delta=delta).collect()}
            assert {r.id: r.bm25 for r in N.index_scores(spark, path, q, ids=docs.select("id"), delta=delta).collect()} == scan
    now = N.Version(spark, path)
    lists = now.of_terms("postings", ["alpha"])
    plan = lists._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1]
    assert {f.split("/bucket=")[1].split("/")[0] for f in lists.inputFiles()} == {str(zlib.crc32(b"alpha") % N.BUCKETS)}


def test_index_segments(spark, tmp_path, monkeypatch):
    """Replacing 1 % writes no old file again, scores are those of a fresh index, and a top-k reads fewer rows than the lists hold."""
    import random
    from pathlib import Path

    rng = random.Random(1)
    text = lambda i: " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(5, 400))) + (" rare" * 3 if i % 100 == 7 else "")
    first = {i: text(i) for i in range(3000)}
    table = lambda d: spark.createDataFrame(sorted(d.items()), "id long, content string").repartition(4)
    path, fresh = str(tmp_path / "index"), str(tmp_path / "fresh")
    N.write_index(table(first), path)
    before = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    changed = {i: text(i) for i in range(2990, 3020)}
    gone = [5, 7, 107, 2991, 99_999]
    N.change_index(spark, path, table(changed))
    N.change_index(spark, path, deleted=spark.createDataFrame([(i,) for i in gone], "id long"))
    after = {f: f.stat().st_mtime_ns for f in before}
    assert after == before
    now = {i: t for i, t in (first | changed).items() if i not in gone}
    N.write_index(table(now), fresh)

    def same(few=N.FEW_POSTINGS):
        monkeypatch.setattr(N, "FEW_POSTINGS", few)
        for q in ("w1 w2 rare", "rare", "w3 w50 w3", "nothing", ""):
            want = {r.id: pytest.approx(r.bm25) for r in N.index_scores(spark, fresh, q).collect()}
            assert {r.id: r.bm25 for r in N.index_scores(spark, path, q).collect()} == want
            top = [(r.id, r.bm25) for r in N.index_top(spark, path, q, 10).collect()]
            assert top == [(i, pytest.approx(s.expected)) for i, s in sorted(want.items(), key=lambda x: (-x[1].expected, x[0]))[:10]]
        a, b = N.figures(spark, path).first(), N.figures(spark, fresh).first()
        assert (a.n_docs, a.n_tokens, a.n_terms) == (b.n_docs, b.n_tokens, b.n_terms)
        assert sorted(map(tuple, N.document_frequencies(spark, path).select("term", "df").collect())) == sorted(map(tuple, N.document_frequencies(spark, fresh).select("term", "df").collect()))

    same()
    same(few=0)  # however short the lists are, blocks are left out
    q = N.Query(spark, fresh, "rare w1", N.K1, N.B)
    rows = lambda b: b.agg(F.sum("n")).first()[0]
    assert rows(N.needed_blocks(q, 10)) < 0.7 * rows(q.blocks)
    N.merge(spark, path)
    N.drop_versions(spark, path, keep=1)
    assert N.versions(spark, path) == [4] and not [f for f in before if f.exists()]
    same()
    padded = N.index_top(spark, path, "nothing", 3, ids=table(now).select("id")).collect()
    assert [(r.id, r.bm25) for r in padded] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_usage_stream_resumes(spark, tmp_path):
    from strandline.streaming.streams import upserted_usage

    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    make = lambda ids: spark.createDataFrame([(i, i % 2, "2024-01-01 00:00:00", 1.0) for i in ids], "id long, session_id long, t string, latency_ms double").select("id", "session_id", F.to_timestamp("t").alias("timestamp"), "latency_ms")
    make(range(6)).write.parquet(folder)
    stream = lambda: spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    assert {(r.item, r.use_count) for r in upserted_usage(stream(), state).collect()} == {(0, 3), (1, 3)}
    make(range(6, 10)).write.mode("append").parquet(folder)
    assert {(r.item, r.use_count) for r in upserted_usage(stream(), state).collect()} == {(0, 5), (1, 5)}
    assert {(r.item, r.use_count) for r in upserted_usage(stream(), state).collect()} == {(0, 5), (1, 5)}


def test_jobs_and_ids(spark):
    ups = [("a", 1, "running"), ("a", 2, "paused"), ("a", 3, "completed"), ("a", 4, "running"), ("a", 5, "completed"), ("b", 1, "completed"), ("c", 1, "running"), ("c", 2, "failed"), ("c", 3, "queued")]
    got = {r.job: (r.status, r.n_moves, r.n_refused) for r in U.job_states(spark.createDataFrame(ups, "job string, at int, status string")).collect()}
    assert got == {"a": ("completed", 4, 1), "b": ("queued", 0, 1), "c": ("queued", 3, 0)}
    names = ["", "x", "commit:42", "naïve 🙂"] + [str(i) for i in range(40)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(U.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_scratch_must_be_shared_on_a_cluster(spark):
    from types import SimpleNamespace

    from strandline.session import scratch_root

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch_root(cluster)


def test_bonus_counts_before_rows_are_ranked(spark):
    """Rows that differ in the last bits of their score alone are equal with a bonus, and go by id."""
    words = ["alpha", "beta", "gamma"]
    rows = [(i, " ".join([words[i % 3]] * 2 + [words[(i + 1) % 3]] + ["filler"] * (i % 4))) for i in range(60)] + [(60 + i, "other") for i in range(60)]
    path = scratch_path(spark, "test-index")
    N.write_index(spark.createDataFrame(rows, "id long, content string"), path)
    every = N.index_scores(spark, path, "gamma alpha beta", delta=1e17)
    want = sorted(((-r.bm25, r.id) for r in every.collect()))[:25]
    assert [(-r.bm25, r.id) for r in N.index_top(spark, path, "gamma alpha beta", 25, delta=1e17).collect()] == want
    same = N.index_scores(spark, path, "beta gamma alpha").join(spark.createDataFrame(rows, "id long, content string"), "id").groupBy("content").agg(F.countDistinct("bm25").alias("n"))
    assert same.where("n > 1").isEmpty()


def test_confidence_rounds_as_sql_does(spark):
    """Similarities of nine digits give halves at the ninth digit of the confidence: DuckDB's figures and places."""
    import duckdb

    from strandline.operators import suggestions as P

    d = duckdb.sql("SELECT i % 40 AS session, i AS id, ((i * 7919777) % 1000003) / 1000003 AS x, (20 + i % 5 * 4) / 100 AS importance, i % 3 = 0 AS verified, [3, 20, 60, 100, 300][i % 5 + 1] AS age FROM range(4000) t(i)")
    d = duckdb.sql("SELECT session, id, round(x, 9) AS similarity, importance, verified, age FROM d")
    sql = "SELECT session, id, round(greatest(0, least(1, 0.5 * similarity + 0.2 * CASE WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.8 WHEN age <= 90 THEN 0.5 WHEN age <= 180 THEN 0.3 ELSE 0.1 END + 0.2 * importance + 0.1 * verified::INT))::DOUBLE, 9) AS confidence FROM d"
    want = duckdb.sql(f"SELECT session, id, confidence, row_number() OVER (PARTITION BY session ORDER BY confidence DESC, id) AS place FROM ({sql}) WHERE confidence >= 0.3 QUALIFY place <= 50").fetchall()
    rows = spark.createDataFrame(d.df())
    got = P.suggested(rows.select("session", "id", "similarity"), rows.select("id", "importance", "verified", "age"), rows.select("session", "id").where("false"), F.col("age"), threshold=0.3, most=50, session="session")
    assert sorted(map(tuple, got.select("session", "id", "confidence", "place").collect())) == sorted(want)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_candidates_brute_force(spark, kind, monkeypatch):
    """Many rounds, ranges, blocks of sessions and steps; equal similarities, replaced and deleted rows, terms that no row holds, a session of no name."""
    import math
    import random

    from strandline.operators import suggestions as P

    for name, value in (("FIRST_ROWS", 8), ("ROUND_FACTOR", 3), ("RANGE_ROWS", 16), ("BLOCK_SESSIONS", 11), ("BROUGHT", 20)):
        monkeypatch.setattr(P, name, value)
    rng = random.Random(5)
    word = lambda: f"w{min(60, int(rng.paretovariate(0.5)))}"
    docs = {i * 7 - 300: {word() for _ in range(rng.randrange(0, 9))} for i in range(200)}
    path = scratch_path(spark, "test-candidates")
    schema = f"id {kind}, content string"
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i}")
    table = lambda d: spark.createDataFrame([(name(i), " ".join(sorted(t))) for i, t in d.items()], schema)
    N.write_index(table({i: t if i % 3 else {"old", "w1"} for i, t in docs.items()}), path)
    N.change_index(spark, path, table({i: t for i, t in docs.items() if i % 3 == 0}))
    gone = [i for i in docs if i % 10 == 0]
    N.change_index(spark, path, deleted=spark.createDataFrame([(name(i),) for i in gone], f"id {kind}"))
    docs = {i: t for i, t in docs.items() if i % 10}
    df = {f"w{k}": sum(f"w{k}" in t for t in docs.values()) for k in range(1, 61)}
    idf = {t: math.log((len(docs) - n + 0.5) / (n + 0.5) + 1) for t, n in df.items()}
    asked = {s: rng.sample(sorted(idf, key=lambda t: -df[t])[: rng.choice((4, 12, 60))], rng.randrange(1, 5)) for s in range(60)}
    rows = [(s, t, df[t], idf[t]) for s, ts in asked.items() for t in ts] + [(None, "w1", df["w1"], idf["w1"])]
    got = P.candidates(spark, path, spark.createDataFrame(rows, "s int, term string, df long, idf double"), "s", 5)
    want = {}
    for s, ts in asked.items():
        of = {name(i): math.floor(sum(idf[t] for t in sorted(ts) if t in held) / sum(idf[t] for t in sorted(ts)) * 1e9 + 0.5) / 1e9 for i, held in docs.items() if held & set(ts)}
        for i in sorted(of, key=lambda i: (-of[i], i))[:5]:
            want[s, i] = pytest.approx(of[i], abs=2e-9)
    assert {(r.s, r.id): r.similarity for r in got.collect()} == want and len(want) > 150
    assert got.schema["id"].dataType.simpleString() == {"long": "bigint", "string": "string"}[kind]


def test_candidates_of_frequent_terms_leave_most_rows(spark):
    """600 sessions ask for terms that a third of 6,000 rows hold: millions of rows of sessions, of which few are shuffled."""
    from strandline.operators import suggestions as P

    def shuffled():
        context = spark._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    path = scratch_path(spark, "test-frequent")
    docs = spark.range(6000).select("id", F.concat_ws(" ", F.lit("all"), *[F.when(F.pmod(F.xxhash64("id", F.lit(k)), 3) == 0, F.lit(f"term{k}")) for k in range(12)]).alias("content"))
    N.write_index(docs, path)
    terms = spark.range(600).select(F.col("id").alias("s"), F.explode(F.array(*[F.concat(F.lit("term"), (F.col("id") * 5 + k * 4) % 12) for k in range(3)])).alias("term"))
    before = shuffled()
    got = P.candidates(spark, path, terms.join(N.document_frequencies(spark, path), "term"), "s").collect()
    assert shuffled() - before < 3_000_000
    assert len(got) == 600 * 20 and all(r.similarity == 1.0 for r in got)
