"""Tokens and pairs that are found in whole Arrow batches, against the Column expressions and brute force on odd texts."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.functions import token_batches as B
from strandline.functions.text import tokens
from strandline.operators import keyword_index as N

ODD = [None, "", " ", "a", "ab", "a b cd", "ab", "ab", "x_y __ _", "Kelvin K9 İstanbul ÀB ab", "éabécdé", "AB\x00cd\nAB\tab", "😀no😀 no", "a" * 70_000 + " zz", "end1", "1start", "ab ab ab cd ab"]


@pytest.mark.parametrize("size", [1, 10, 1 << 20])
def test_index_counts_the_tokens_of_odd_texts(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(B, "SLICE_BYTES", size)
    docs = spark.createDataFrame(list(enumerate(ODD)), "id long, content string").coalesce(1)
    want = {r.id: r.t or [] for r in docs.select("id", tokens(F.col("content")).alias("t")).collect()}
    path = str(tmp_path / "index")
    N.write_index(docs, path)
    now = N.Version(spark, path)
    rows = {r.id: r for r in now.forward.collect()}
    assert {i: r.dl for i, r in rows.items()} == {i: len(t) for i, t in want.items()}
    assert {i: dict(zip(r.words.split(), r.tf, strict=True)) for i, r in rows.items()} == {i: dict(Counter(t)) for i, t in want.items()}
    df = Counter(t for x in want.values() for t in set(x))
    assert {r.term: r.df for r in N.document_frequencies(spark, path).collect()} == df


def test_slices_and_runs():
    batch = pa.RecordBatch.from_arrays([pa.array([b"ab", b"", b"cdefgh", b"x", b"yz"])], ["body"])
    for size in (1, 3, 100):
        parts = list(B.slices(batch, "body"))
        assert [v for p in parts for v in p["body"].to_pylist()] == batch["body"].to_pylist()
    words, n = B.batch_tokens(batch["body"].slice(2))
    assert words.to_pylist() == ["cdefgh", "yz"] and n.tolist() == [1, 0, 1]
    for keys in ([], [3], [3, 1, 3]):
        values, often = B.runs(np.array(keys, np.int64))
        assert dict(zip(values.tolist(), often.tolist(), strict=True)) == Counter(keys)


def test_tokens_are_those_of_a_regex():
    bodies = pa.array([(t or "").lower().encode() for t in ODD if t is None or t.isascii()])
    words, n = B.batch_tokens(bodies)
    want = [[w for w in re.findall("[a-z0-9_]+", t.decode()) if len(w) > 1] for t in bodies.to_pylist()]
    assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_pairs_of_odd_texts(spark, monkeypatch, size):
    """Chunks of one text and of all, buckets that hold one pair or many: the same pairs as by brute force."""
    from strandline.operators import dictionaries as Y

    monkeypatch.setattr(Y, "CHUNK_BYTES", size)
    monkeypatch.setattr(Y, "BUCKET_ENDS", size)
    docs = spark.createDataFrame([(t,) for t in [*ODD, *ODD, "zz ab cd"]], "content string").coalesce(2)
    n = Counter()
    for r in docs.select(tokens(F.col("content")).alias("t")).collect():
        t = r.t or []
        n.update((min(a, b), max(a, b)) for i, a in enumerate(t) for b in t[i + 1 : i + 5] if a != b)
    alone = Counter()
    for p, k in n.items():
        alone.update({p[0]: k, p[1]: k})
    whole = sum(alone.values())
    want = {(a, b): (k, np.log(k * whole / (alone[a] * alone[b]))) for p, k in n.items() if k >= 3 for a, b in (p, p[::-1])}
    got = {(r.a, r.b): (r.n, r.pmi) for r in Y.associations(docs, support=3).collect()}
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-12 for p in want)
    assert Y.associations(docs.where("content IS NULL")).count() == 0
