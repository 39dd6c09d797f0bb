"""Properties that hold for any input."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import dedup as D
from strandline.operators import search as S
from strandline.operators.filters import MemoryFilter
from strandline.sources import code as K


def lists(spark, seed):
    rng = random.Random(seed)
    v = spark.createDataFrame([(i, rng.random()) for i in rng.sample(range(100), 40)], "id long, similarity double")
    k = spark.createDataFrame([(i, rng.choice([0.0, rng.random() * 9])) for i in rng.sample(range(100), 40)], "id long, bm25 double")
    return v, k


def test_fusion_properties(spark):
    v, k = lists(spark, 1)
    rrf = {r.id: r.score for r in S.rrf_fusion(v, k, 200, 100).collect()}
    swapped = S.rrf_fusion(k.withColumnRenamed("bm25", "similarity").where("similarity > 0"), v.withColumnRenamed("similarity", "bm25"), 200, 100)
    assert {r.id: r.score for r in swapped.collect()} == rrf  # neither list is preferred
    weighted = S.weighted_fusion(v, k, 0.3, 200).collect()
    assert all(0 <= r.score <= 1 for r in weighted)
    top = [r.id for r in S.weighted_fusion(v, k, 0.3, 7).collect()]
    assert top == [r.id for r in weighted][:7]
    cascade = [r.id for r in S.cascade_fusion(v, k, 30).collect()]
    assert len(cascade) == len(set(cascade)) == 30


def test_clusters_are_stable(spark):
    rng = random.Random(2)
    pairs = spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(50)) if a != b], "a long, b long, similarity double")
    once = D.clusters(pairs)
    again = D.clusters(once.where("id <> cluster").select(F.col("cluster").alias("a"), F.col("id").alias("b")))
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in again.collect()}


def test_filters_commute(spark):
    df = spark.range(200).select("id", (F.col("id") % 10 / 10).alias("importance"), F.array(F.concat(F.lit("t"), F.col("id") % 3)).alias("tags"), F.lit("en").alias("category"), F.lit("p").alias("project_name"))
    a, b = MemoryFilter(min_importance=0.4).column(), MemoryFilter(tags_any=["t1", "t2"]).column()
    ids = lambda d: {r.id for r in d.collect()}
    assert ids(df.where(a).where(b)) == ids(df.where(b).where(a)) == ids(df.where(MemoryFilter(min_importance=0.4, tags_any=["t1", "t2"]).column()))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc*?./[]\\", max_size=12), st.text(alphabet="abc./[]\\", max_size=12))
def test_globs_match_like_the_shell(pattern, name):
    import fnmatch
    import re

    plain = pattern.replace("[", "[[]")  # brackets are ordinary characters here
    assert bool(re.match(T.glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, plain)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_parsers_take_any_text(source):
    for language in ("python", "go", "json", "toml", "javascript"):
        for u in K.parse_units(source, language):
            assert 1 <= u["start_line"] <= u["end_line"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["auth", "db", "user", "word", "Auth"]), max_size=6))
def test_expansion_keeps_the_query(words):
    query = " ".join(words)
    out = T.expanded_full(query)
    assert out.startswith(query) and len(out.split()) >= len(words)
