"""Stored commits and changes: ids of their keys, once each, whatever is null or comes again."""

import uuid

from pyspark.sql import functions as F

from strandline.operators import upkeep as U


def test_git_sinks_store_each_key_once(spark, tmp_path):
    day = F.timestamp_micros(F.lit(5_000_000)).cast("timestamp_ntz")
    commits = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,), ("",)], "commit_hash string").withColumn("author_date", day)
    pairs = [("a", "f"), ("a", "f"), ("a", None), (None, "a"), (None, None), ("", None), ("a:f", None), ("b", "f")]
    changes = spark.createDataFrame(pairs, "commit_hash string, file_path string")
    for _ in range(2):
        c, d = U.store_git(spark, str(tmp_path), commits, changes)
    own = lambda name: str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert sorted(r.id for r in c.collect()) == sorted(["", own("commit:a"), own("commit:b"), own("commit:")])
    assert sorted(r.id for r in d.collect()) == sorted({own(":".join(["change", *[x for x in p if x is not None]])) for p in pairs})
    assert {r.author_date for r in c.collect()} == {5} and set(c.columns) == {"commit_hash", "author_date", "id"}


def test_git_sinks_shuffle_keys_and_no_ids(spark, tmp_path, monkeypatch):
    """Rows meet before their ids are made: an id is longer than the key that it comes from."""
    made = []
    monkeypatch.setattr(U, "uuid5", lambda name: made.append(name) or F.concat(F.lit("id of "), name))
    rows = spark.createDataFrame([("a", "f")], "commit_hash string, file_path string")
    U.store_git(spark, str(tmp_path), rows.select("commit_hash").withColumn("author_date", F.timestamp_micros(F.lit(0)).cast("timestamp_ntz")), rows)
    assert len(made) == 2 and all("_key" in str(n) for n in made)
