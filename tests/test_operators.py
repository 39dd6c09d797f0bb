"""Operators on small fixtures with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.functions import code as C
from strandline.functions import text as T
from strandline.operators import changes as H
from strandline.operators import dedup as D
from strandline.operators import graph as R
from strandline.operators import lifecycle as L
from strandline.operators import metrics as M
from strandline.operators import search as S
from strandline.operators.filters import MemoryFilter, parse_date, parse_query, validated_sort
from strandline.sources import code as K
from strandline.sources import statements


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_bm25_fixture(spark):
    docs = spark.createDataFrame([(0, "alpha beta beta"), (1, "beta gamma"), (2, "delta x")], "id long, content string")
    scores = lambda q, **k: {r.id: round(r.bm25, 6) for r in S.bm25_scores(docs, q, **k).collect()}
    assert scores("beta") == {0: 0.578466, 1: 0.470004, 2: 0.0}
    assert scores("beta gamma") == {0: 0.578466, 1: 1.450833, 2: 0.0}
    assert scores("beta", delta=1.0) == {0: 1.04847, 1: 0.940007, 2: 0.470004}
    assert scores("beta beta")[0] == pytest.approx(2 * 0.578466, abs=1e-5)
    assert scores("") == {0: 0.0, 1: 0.0, 2: 0.0}


def test_normalisation_and_fusion(spark):
    v = spark.createDataFrame([(1, 0.95), (3, 0.88), (2, 0.45), (4, 0.30)], "id long, similarity double")
    k = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, 4.0), (4, 0.0)], "id long, bm25 double")
    rrf = {r.id: r.score for r in S.rrf_fusion(v, k, 10, 10).collect()}
    assert rrf[1] == pytest.approx(1 / 61 + 1 / 62) and rrf[3] == pytest.approx(1 / 62 + 1 / 61)
    assert [r.id for r in S.rrf_fusion(v, k, 10, 10).collect()][:2] == [1, 3]
    w = [r.id for r in S.weighted_fusion(v, k, 0.5, 4).collect()]
    assert w[0] == 3 and len(w) == 4
    assert [r.id for r in S.cascade_fusion(v, k, 3).collect()] == [3, 1, 2]
    flat = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id long, s double")
    assert {r.n for r in S.scaled(flat, "s", "n").collect()} == {0.0}
    assert {r.n for r in S.scaled(flat.withColumn("s", F.lit(3.0)), "s", "n").collect()} == {1.0}


def test_mmr_and_diversity(spark):
    rows = [("q", 1, 1.0, "a b c d"), ("q", 2, 0.95, "a b c d"), ("q", 3, 0.7, "x y z"), ("r", 4, 0.5, "only")]
    df = spark.createDataFrame(rows, "query string, id long, score double, content string")
    got = {(r.query, r.position): r.id for r in S.mmr(df, 2, 0.5).collect()}
    assert got == {("q", 1): 1, ("q", 2): 3, ("r", 1): 4}
    assert {r.id: round(r.score, 3) for r in S.diversified(df).collect()} == {1: 1.0, 2: 0.85, 3: 0.7, 4: 0.5}


def test_signals(spark):
    assert one(spark, S.length_penalty(F.lit("x" * 300))) == 0
    assert one(spark, S.length_penalty(F.lit("x" * 50))) == -0.5
    assert one(spark, S.keyword_boost(F.lit("user login handler"), "login user missing")) == pytest.approx(2 / 3)
    now = F.expr("timestamp_ntz'2024-01-08 00:00:00'")
    since = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    assert one(spark, S.recency(since, now)) == pytest.approx(0.5)
    half = F.expr("timestamp_ntz'2024-01-04 12:00:00'")
    assert one(spark, S.composite_score(F.lit(0.9), half, now, F.lit(9))) == pytest.approx(0.748078, abs=1e-6)


def test_filters(spark):
    df = spark.createDataFrame([(1, "en", "p1", ["a", "b"], 0.9), (2, "de", "p2", ["b"], 0.2), (3, None, "p1", None, 0.5)], "id long, category string, project_name string, tags array<string>, importance double")
    ids = lambda f: {r.id for r in df.where(f).collect()}
    assert ids(MemoryFilter(tags_all=["a", "b"]).column()) == {1}
    assert ids(MemoryFilter(tags_any=["a", "b"], min_importance=0.1).column()) == {1, 2}
    assert ids(MemoryFilter(exclude_projects=["p1"]).column()) == {2}
    assert ids(MemoryFilter().column()) == {1, 2, 3}
    with pytest.raises(ValueError):
        MemoryFilter(created_after="2024-02-01", created_before="2024-01-01")
    with pytest.raises(ValueError):
        validated_sort("content")


def test_query_language():
    q = parse_query('error handling language:python unknown:x "two words" -file:test')
    assert q.text == "error handling unknown:x two words" and len(q.conditions) == 2
    with pytest.raises(ValueError):
        parse_query("created:2024-12-31..2024-01-01")
    now = dt.datetime(2024, 3, 10, 12)
    assert parse_date("2 months ago", now) == now - dt.timedelta(days=60)
    assert parse_date("yesterday", now) == dt.datetime(2024, 3, 9)
    with pytest.raises(ValueError):
        parse_date("today")


def test_code_metrics(spark):
    src = F.lit("def simple():\n    return 42")
    assert one(spark, C.cyclomatic(src)) == 1 and one(spark, C.code_lines(src)) == 2 and one(spark, C.nesting(src)) == 1
    assert one(spark, C.parameters(F.lit("def f(self, a, b=0, *c)"))) == 3
    assert one(spark, C.cyclomatic(F.lit("if (a && b) {} else if (c) {}"), F.lit("javascript"))) == 5
    assert one(spark, C.maintainability(F.lit(12), F.lit(150), F.lit(False))) == 61
    assert one(spark, C.documented(F.lit('"""a long docstring"""')))


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("x", "y"), ("y", "x"), ("z", "z")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in R.reachable(edges, start).collect()} == {("b", 1), ("d", 1), ("c", 2), ("e", 3)}
    assert {r.node for r in R.reachable(edges, start, 2).collect()} == {"b", "c", "d"}
    path = R.shortest_path(edges, "a", "e").first()
    assert path.path == ["a", "b", "c", "e"] and path.hops == 3
    assert R.shortest_path(edges, "a", "a").first().path == ["a"] and R.shortest_path(edges, "e", "a").count() == 0
    assert sorted(r.cycle for r in R.cycles(edges).collect()) == [["x", "y"], ["z"]]
    assert R.closes_cycle(edges, "e", "a") and not R.closes_cycle(edges, "a", "e")
    units = spark.createDataFrame([("f", "g(1) + h (2) + f()"), ("g", "print()"), ("h", "g()")], "name string, content string")
    assert {(r.src, r.dst) for r in R.call_edges(units).collect()} == {("f", "g"), ("f", "h"), ("h", "g")}


def test_vectors_and_clusters(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])], "id long, embedding array<float>")
    for blocks in (1, 3):
        assert [(r.a, r.b) for r in D.similar_pairs(v, 0.9, blocks).collect()] == [(0, 1)]
    pairs = spark.createDataFrame([(0, 1, 0.95), (0, 2, 0.9), (5, 6, 0.99), (6, 7, 0.86)], "a long, b long, similarity double")
    m = D.clusters(pairs)
    assert {(r.id, r.cluster) for r in m.collect()} == {(0, 0), (1, 0), (2, 0), (5, 5), (6, 5), (7, 5)}
    assert {(r.leader, r.member) for r in D.greedy_leaders(pairs).collect()} == {(0, 1), (0, 2), (5, 6)}
    rows = spark.createDataFrame([(i, i == 2, 5 - i, i) for i in range(8)], "id long, documented boolean, complexity int, length int")
    assert {(r.cluster, r.canonical) for r in D.canonical(m, rows).collect()} == {(0, 2), (5, 7)}
    f = {r.cluster: (r.auto_merge, r.review) for r in D.merge_candidates(m, pairs).collect()}
    assert f == {0: (False, True), 5: (False, True)}


def test_lsh_recall(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 32))
    both = np.concatenate([base, base + 0.2 * rng.standard_normal(base.shape)])
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(both)], "id long, embedding array<double>")
    exact = {(r.a, r.b) for r in D.similar_pairs(v, 0.9).collect()}
    found = {(r.a, r.b) for r in D.lsh_pairs(v, 0.9).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) > 100


def test_metrics(spark):
    v = spark.createDataFrame([("a", float(x)) for x in (40, 10, 30, 20)] + [("b", 5.0)], "k string, v double")
    assert {(r.k, r.p) for r in M.nearest_rank(v, ["k"], "v", 0.95, "p").collect()} == {("a", 40.0), ("b", 5.0)}
    t = spark.createDataFrame([(f"2024-01-0{d}", 10.0 * d) for d in range(1, 8)], "d string, v double").withColumn("t", F.col("d").cast("timestamp_ntz"))
    g = M.growth(t, "t", "v").first()
    assert g.slope == pytest.approx(10) and g.last == 70
    assert M.growth(t.limit(1), "t", "v").first().slope == 0
    f = M.forecast(M.growth(t, "t", "v"), 10, 100, 1000, 1).first()
    assert (f.trend, f.days_to_warning, f.status) == ("GROWING", 3, "WARNING")
    assert one(spark, M.worst(F.lit("HEALTHY"), F.lit("CRITICAL"), F.lit("WARNING"))) == "CRITICAL"


def test_writes(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id long, v string, version int")
    b = spark.createDataFrame([(2, "z", 1), (3, "w", 1), (1, "old", 0)], "id long, v string, version int")
    assert {(r.id, r.v) for r in L.upsert(a, b, "id", "version").collect()} == {(1, "x"), (2, "z"), (3, "w")}
    get = lambda mode: {(r.id, r.v) for r in L.imported(a.drop("version"), b.drop("version"), "id", mode).collect()}
    assert get("skip") == {(1, "x"), (2, "y"), (3, "w")} and get("overwrite") == {(1, "old"), (2, "z"), (3, "w")}
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    soft = L.soft_deleted(a, F.col("id") == 1, "r1", now)
    assert L.rolled_back(soft, "r1").where("deletion IS NOT NULL").count() == 0
    assert L.rolled_back(soft, "r2").where("deletion IS NOT NULL").count() == 1
    later = F.expr("timestamp_ntz'2024-03-01 00:00:00'")
    assert L.purged(soft, now).count() == 2 and L.purged(soft, later).count() == 1
    store = L.read_only(a)
    assert store.count() == 2
    for what in ("write", "writeTo"):
        with pytest.raises(PermissionError):
            getattr(store, what)


def test_changes(spark):
    text = lambda n: " ".join(f"word{i}" for i in range(n))
    old = spark.createDataFrame([("a", text(30)), ("b", "same"), ("c", "1")], "path string, content string")
    new = spark.createDataFrame([("z", text(31)), ("b", "same"), ("c", "2")], "path string, content string")
    assert {(r.path, r.change) for r in H.file_diff(old, new).collect()} == {("a", "deleted"), ("z", "added"), ("c", "modified")}
    found = H.renames(old.where("path = 'a'"), new.where("path = 'z'")).collect()
    assert [(r.old_path, r.new_path) for r in found] == [("a", "z")] and found[0].similarity > 0.95
    plan = H.index_plan(H.file_diff(old, new), new).first()
    assert (plan.to_add, plan.to_update, plan.to_delete, plan.full_reindex) == (1, 1, 1, True)


def test_code_sources(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text('import os\nfrom .b import c\n\nclass A:\n    """Doc of A."""\n    def f(self):\n        return 1\n')
    (tmp_path / "pkg" / "x.js").write_text("import q from './q'\nexport function go(a) {\n  return { a };\n}\n")
    files = K.read_files(spark, str(tmp_path))
    units = {(r.name, r.unit_type, r.start_line, r.end_line) for r in K.code_units(files).collect()}
    assert units == {("A", "class", 4, 7), ("f", "function", 6, 7), ("go", "function", 2, 4)}
    found = {(r.module, r.line, r.relative) for r in statements.import_details(files).collect()}
    assert found == {("os", 1, False), (".b", 2, True), ("./q", 1, True)}
    assert K.parse_units("def broken(", "python") == [] and [u["name"] for u in K.parse_units('a = 1\n[b]\nc = 2', "toml")] == ["a", "b"]
    paths = spark.createDataFrame([("src/a.py",), ("build/x.o",), ("a/node_modules/b.js",), ("x.log",)], "p string")
    assert [r.p for r in paths.where(K.not_ignored(F.col("p"), ["build/", "node_modules/", "*.log", "# no", "!x.log"])).collect()] == ["src/a.py"]


def test_text(spark):
    assert one(spark, T.injection(F.lit("x'; DROP TABLE y"))) == "sql" and one(spark, T.injection(F.lit("fine"))) is None
    assert one(spark, T.sanitized(F.lit(" a\x00b\x07 "))) == "ab"
    assert T.expanded("auth bug", T.SYNONYMS, 1) == "auth bug authentication defect"
    assert one(spark, T.expanded_column(F.lit("auth bug"), T.SYNONYMS, 1)) == "auth bug authentication defect"
    assert one(spark, T.spelling_candidates(F.lit("fucntion"), ["function", "junction"], 2))[0] == "function"
    with pytest.raises(ValueError):
        T.preset("@preset:none")
    assert [(m.line, m.column) for m in one(spark, T.match_lines(F.lit("a\nb TODO: x\nTODO y"), "@preset:TODO_comments"))] == [(2, 3), (3, 1)]


def test_streams(spark, tmp_path):
    from strandline.streaming.streams import debounced, drained, shown_ids, sliding_stream

    rows = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:10:00"), (3, 7, "2024-01-01 02:00:00"), (4, 8, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id long, session_id long, t string").select("id", "session_id", F.to_timestamp("t").alias("timestamp"), F.lit(1.0).alias("latency_ms"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("timestamp", "1 day")
    assert {(r.session_id, r.n_shown) for r in drained(shown_ids(stream()), "update").collect()} >= {(7, 1), (8, 1)}
    assert drained(debounced(stream().withColumnRenamed("session_id", "path")), "append").count() == 2
    assert drained(sliding_stream(stream(), "2 days", "1 day"), "complete").agg(F.sum("n")).first()[0] == 8


def test_nearest_over_blocks(spark):
    import numpy as np

    m = np.random.default_rng(3).standard_normal((90, 8))
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, embedding array<double>")
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -2)
    want = {(q, int(i)) for q in range(90) for i in np.argsort(-s[q])[:5]}
    for block_rows in (25, 1000):
        assert {(r.query, r.id) for r in S.nearest(v, 5, block_rows).collect()} == want
    assert S.nearest(v.limit(1), 5).count() == 0 and S.nearest(v.where("false"), 5).count() == 0


def test_stream_times_are_the_nearest_milliseconds(spark, tmp_path):
    """Times of microseconds, on both sides of half a millisecond; the watermark passes one path's quiet time by its rounded time alone."""
    import duckdb

    from strandline.plans import flows  # noqa: F401  it fills the registry
    from strandline.plans.registry import REGISTRY

    hour = 3600 * 10**6
    times = {1: [1_500, 2 * hour + 1_500, 5 * hour + 2_499], 2: [7_499], 3: [7_500, 12 * hour + 500], 4: [8 * hour], 5: [11 * hour + 499]}
    rows = [(i, u, t + 1_704_067_200_000_000) for i, (u, t) in enumerate((u, t) for u, ts in times.items() for t in ts)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t long").select("event_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name, columns in (("stream_debounced", ["path", "at_ms", "event_id"]), ("stream_shown_ids", ["session_id", "last", "n_shown"])):
        got = REGISTRY[name].run(spark, str(tmp_path)).select(columns).collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({REGISTRY[name].sql})").fetchall())
