"""Data sources, stateful streams and the stored vector index: restarts, ranges, odd rows, recall."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import vector_index as V
from strandline.plans import retrieval
from strandline.plans.registry import REGISTRY
from strandline.session import scratch_path
from strandline.sources import folders
from strandline.sources.tables import table
from strandline.streaming import state


def folder(name):
    return tempfile.mkdtemp(prefix=f"spark-{name}-")


DUMP = "@a1|Ann|ann@x|2024-01-02T03:04:05+00:00|first | with bars\n1\t2\tsrc/a b.py\n-\t-\tlogo.png\n\n@b2|Bob Ü|b@x|not a date|second\n@broken\n5\t5\tlost.py\n@c3|Ann|ann@x|2024-02-01T00:00:00+00:00|\n7\t0\té.py\nnot a change\n"


def test_dump_ranges_read_each_commit_once():
    path = f"{folder('dump')}/d.txt"
    with open(path, "w") as f:
        f.write(DUMP * 3)
    size = os.path.getsize(path)
    whole = [x.decode() for x in folders.lines_between(path, 0, size)]
    assert whole == (DUMP * 3).split("\n")[:-1] + ([""] if whole[-1] == "" else [])
    for step in (1, 7, 40, 100, size):
        assert [x.decode() for a in range(0, size, step) for x in folders.lines_between(path, a, min(a + step, size))] == whole


def test_dumps_with_odd_lines(spark):
    folders.register(spark)
    at = folder("dump")
    for name in ("a.txt", "b.txt", "_hidden", ".crc"):
        with open(f"{at}/{name}", "w") as f:
            f.write(DUMP)
    read = spark.read.format("git_dump").option("range_bytes", 50)
    commits = list(map(tuple, spark.read.format("git_dump").option("range_bytes", 50).option("table", "commits").load(at).select("commit_hash", "author_name", F.col("author_date").cast("string"), "message").collect()))
    one = [("a1", "Ann", "2024-01-02 03:04:05", "first | with bars"), ("b2", "Bob Ü", None, "second"), ("c3", "Ann", "2024-02-01 00:00:00", "")]
    assert sorted(commits, key=str) == sorted(one * 2, key=str)
    changes = spark.read.format("git_dump").load(f"{at}/a.txt")
    assert sorted(map(tuple, changes.collect())) == [("a1", "logo.png", 0, 0), ("a1", "src/a b.py", 1, 2), ("c3", "é.py", 7, 0)]
    mine = changes.where("commit_hash = 'a1'")
    assert mine.count() == 2 and "= a1" not in mine._jdf.queryExecution().executedPlan().toString()  # the source tests it
    assert read.load(folder("empty")).count() == 0


def test_folder_stream_resumes(spark):
    folders.register(spark)
    at, check, out = folder("watched"), folder("check"), folder("out")

    def run():
        s = spark.readStream.format("watched_folder").option("suffix", ".py").load(at)
        q = s.select("path", "content").writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((os.path.basename(r.path), r.content) for r in spark.read.schema("path string, content string").parquet(out).collect())

    def put(name, text, when):
        with open(f"{at}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{at}/{name}", (when, when))

    put("a.py", "1", 1000)
    put("b.txt", "no", 1001)
    assert run() == [("a.py", "1")]
    put("c.py", "3", 1000)  # the same time, a later path
    put("a.py", "2", 2000)
    assert run() == run() == [("a.py", "1"), ("a.py", "2"), ("c.py", "3")]
    late = spark.read.format("watched_folder").load(at).where("modified > '1970-01-01 00:20:00'")
    assert [os.path.basename(r.path) for r in late.collect()] == ["a.py"]


def debounce(spark, files, quiet):
    """The output of a stream over files that come one after the other, in two runs on one checkpoint."""
    state.with_rocksdb(spark)
    at, check, out = folder("events"), folder("check"), folder("out")
    schema = "path string, at long, place long, v string"
    seen = []
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/{n}")
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(at).withColumn("time", F.timestamp_millis("at")).withWatermark("time", "0 seconds")
        q = state.last_after_quiet(s, "path", {"v": "string"}, quiet_ms=quiet).writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(sorted((r.path, r.at, r.v) for r in spark.read.schema("path string, at long, v string").parquet(out).collect()))
    return seen


def test_debounced_last_event_survives_a_restart(spark):
    first = [("a", 1000, 0, "a1"), ("a", 1500, 1, "a2"), ("b", 1200, 2, "b1"), ("b", 9000, 3, "b2"), ("a", 1500, 4, "a3")]
    second = [("b", 9400, 5, "b3"), ("c", 9500, 6, None), ("z", 30_000, 7, "z")]
    one, two = debounce(spark, [first, second], 1000)
    assert one == [("a", 1500, "a3"), ("b", 1200, "b1")]
    assert two == [("a", 1500, "a3"), ("b", 1200, "b1"), ("b", 9400, "b3"), ("c", 9500, None)]


def test_vector_index_recall_and_versions(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    exact = {(r["query"], r.id) for r in REGISTRY["nearest_of_all"].run(spark, sf).where("query % 20 = 0").collect()}
    got = REGISTRY["vector_index_topk"].run(spark, sf).collect()
    assert len(got) == len(exact) and sum((r["query"], r.id) in exact for r in got) >= 0.9 * len(exact)
    path = scratch_path(spark, "test-index")
    assert V.write_vector_index(rows.where("id < 50"), path) == 1 and V.write_vector_index(rows, path, copies=1) == 2
    assert V.index_rows(spark, path).count() == rows.count()
    lists = V.index_rows(spark, path, [3, 5])
    assert "PartitionFilters: [part" in lists._jdf.queryExecution().executedPlan().toString() and {r.list for r in lists.select("list").collect()} <= {3, 5}
    one = V.nearest_in_index(retrieval._asked(spark, sf).where("query = 20"), path, 3, probes=2)
    assert one.count() == 3


def test_all_lists_meet_a_query_once_a_group(spark, monkeypatch):
    """Groups of pieces, several blocks of queries: all lists probed give the exact answer, and a query is sent a group, not a list."""
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(V, "GROUP_NUMBERS", 150 * 64)
    monkeypatch.setattr(V, "PIECE_ROWS", 60)
    monkeypatch.setattr(V, "QUERY_ROWS", 10)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path, asked = scratch_path(spark, "grouped-index"), retrieval._asked(spark, sf)
    V.write_vector_index(vectors, path, copies=3)
    lists = V.index_lists(spark, path).count()
    want = {(r["query"], r.id): r.similarity for r in REGISTRY["nearest_of_all"].run(spark, sf).where("query % 20 = 0").collect()}
    for probes in (lists, lists - 1):  # all of them by first copies, and hardly fewer by pieces
        got = V.nearest_in_index(asked, path, 10, probes)
        rows = got.collect()
        found = {(r["query"], r.id): round(r.similarity, 6) for r in rows}
        assert len(found) == len(rows) == len(want)
        same = found.keys() & want.keys()
        assert len(same) == len(want) if probes == lists else len(same) >= 0.99 * len(want)
        assert all(found[x] == pytest.approx(want[x], abs=2e-6) for x in same)


def test_all_lists_are_exact_among_near_copies(spark):
    """More near copies than the bytes tell apart, and equal vectors: the best ones, ties to the smaller id."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    m = base + np.concatenate([rng.normal(size=(400, 32)) * 1e-3, np.zeros((200, 32))])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    path = scratch_path(spark, "near-copies")
    V.write_vector_index(rows, path)
    asked = spark.createDataFrame([(i, m[i].tolist()) for i in (0, 7, 500)], "query long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q, found in {q: sorted((r for r in V.nearest_in_index(asked, path, 5, 1000).collect() if r["query"] == q), key=lambda r: (-r.similarity, r.id)) for q in (0, 7, 500)}.items():
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-round(float(u[i] @ u[q]), 13), i))[:5]
        assert [r.id for r in found] == want


def test_vector_index_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [0.9, 0.1]), (6, [-1.0, 0.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    path = scratch_path(spark, "odd-index")
    V.write_vector_index(df, path, lists=2)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (9, None)], "query long, v array<double>")
    got = V.nearest_in_index(asked, path, 2, probes=2).orderBy(F.col("similarity").desc(), "id").collect()
    assert [(r["query"], r.id) for r in got] == [(1, 7), (1, 5)] and got[0].similarity == pytest.approx(1)
    assert V.nearest_in_index(asked.where("false"), path, 2).count() == 0
    assert np.allclose(V.unit_matrix(df.where("id in (1, 2)").toArrow().column("embedding")), [[1, 0], [0, 0]])


def test_dumps_follow_the_rows(spark, sf, monkeypatch):
    """A task sorts one dump, so there are more of them where there are more rows."""
    from strandline.plans import ingest

    monkeypatch.setattr(ingest, "DUMP_LINES", 500)
    files = [f for f in os.listdir(ingest._dumps(spark, sf)) if f.endswith(".txt")]
    rows = table(spark, sf, "orders").count() + table(spark, sf, "lineitem").count()
    assert len(files) >= rows // 500 > 4
