"""Very many identical rows, and dense groups."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import queries as Q

HOT = 200_000


@pytest.fixture(scope="module")
def hot_docs(spark):
    """Identical rows with and without an id, among others."""
    same = spark.range(0, HOT, 1, 8).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"), F.lit("a").alias("source"), F.lit("en").alias("lang"))
    rest = spark.range(1000, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), (F.col("id") % 30).cast("int")), F.md5(F.col("id").cast("string"))).alias("text"), F.when(F.col("id") % 3 > 0, "b").alias("source"), F.lit("de").alias("lang"))
    return same.unionByName(rest)


def test_mixing_of_hot_rows(spark, hot_docs):
    from strandline.llm.mixing import PIECE, mix, mixing_plan

    plan = mixing_plan(hot_docs).cache()
    assert plan.count() == HOT + 2000
    per = {r.source: r for r in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert all(abs(r.taken - r.target) <= 31 for r in per.values())
    sizes = [r[0] for r in plan.where("size = 4").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 1 and PIECE * 10 < HOT and max(sizes) < 0.75 * HOT
    mixed = mix(hot_docs).groupBy("doc_id").count().collect()
    want = {r.doc_id: r.n for r in plan.groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()}
    assert {r.doc_id: r["count"] for r in mixed} == want


def test_mixed_twins_keep_their_own_columns(spark):
    from strandline.llm.mixing import mix, mixing_plan

    rows = [(1, "one two", "a", f"of {i}", i) for i in range(40)] + [(i, "x y z", "b", "mix_part", 0) for i in range(2, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_part string, of_before long").repartition(5)
    n = mixing_plan(df).where("doc_id = 1").agg(F.sum("copies")).first()[0]
    got = mix(df).where("doc_id = 1").collect()
    assert len(got) == n and all(r.mix_part == f"of {r.of_before}" for r in got)
    per = Counter(r.of_before for r in got)
    assert max(per.values()) - min([*per.values(), *([0] if len(per) < 40 else [])]) <= 1


def test_token_files_of_hot_rows(spark, hot_docs):
    from tokenizers import Tokenizer

    from strandline.llm.common import scratch_path
    from strandline.llm.token_files import file_digest, read_token_files, write_token_files

    path = Q.tokenizer_path("word_bpe_49k.json")
    ids = np.array([*Tokenizer.from_file(path).encode("the same few words", add_special_tokens=False).ids, 2], dtype="<u4")
    folder = scratch_path(spark, "hot-tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all of these few bytes are one partition
    write_token_files(hot_docs, folder, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in read_token_files(spark, folder).where(f"n_tokens = {len(ids)}").groupBy("_metadata.file_name").count().collect()]
    assert sum(sizes) >= HOT and max(sizes) < 0.75 * HOT
    got = file_digest(spark, folder).where("doc_id IS NULL OR doc_id = 7")
    assert got.agg(F.count("*"), F.countDistinct("start"), F.min("start"), F.max("start"), F.max("ids_crc32"), F.min("ids_crc32")).first() == (HOT, HOT, 0, (HOT - 1) * len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(ids.tobytes()))


def test_fingerprints_of_hot_rows(spark, hot_docs):
    from strandline.llm.simhash import simhash_components

    got = simhash_components(hot_docs).where("doc_id IS NULL OR doc_id = 7").groupBy("doc_id", "component_id").count().collect()
    assert sorted((r.doc_id or 0, r.component_id, r["count"]) for r in got) == [(0, 7, HOT // 2), (7, 7, HOT // 2)]


def test_links_of_a_dense_group():
    """A few thousand fingerprints that all link: a forest leaves, whatever the pairs."""
    from strandline.llm.simhash import spanning_links
    from strandline.llm.unions import Unions

    rng = np.random.default_rng(1)
    centre = np.uint64(rng.integers(1 << 62))
    near = np.unique([centre] + [centre ^ np.uint64((1 << int(i)) | (1 << int(j))) for i in range(64) for j in range(i)])
    far = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    home, visitors = np.sort(np.concatenate([near[::2], far[:250]])), np.concatenate([near[1::2], far[250:]])
    a, b = spanning_links(home, visitors, 3)
    assert len(a) <= len(home) + len(visitors)
    every = np.unique(np.concatenate([home, visitors]))
    parts = Unions(len(every))
    parts.link(np.searchsorted(every, a), np.searchsorted(every, b))
    want = Unions(len(every))
    x, y = np.nonzero(np.bitwise_count(home[:, None] ^ every[None, :]) <= 3)
    want.link(np.searchsorted(every, home[x]), y)
    assert (parts.label == want.label).all() and len(set(want.label[np.searchsorted(every, near)])) == 1


def test_longest_common_subsequence():
    from strandline.llm.substring import _common

    rng = np.random.default_rng(4)
    shifted = np.concatenate([[99], np.arange(19)])
    assert len(_common(np.arange(20), shifted)) == 19
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(0, 25)), rng.integers(0, 4, rng.integers(0, 25))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (a[i] == b[j]))
        got = _common(a, b)
        assert len(got) == table[-1, -1] and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_slots_hold_all_seeds_once():
    """Whatever the number of slots, both turns together exchange each distinct seed of a block once."""
    from strandline.llm.shared_seeds import LONG, TURNS, Block, Seeds, slot_count, told

    assert slot_count(0, 8) == 8 * TURNS and slot_count(10**12, 8) > 10**12 // (1 << 21)
    rng = np.random.default_rng(7)
    block = Block({"block": 3, "doc_ids": [1, 2], "versions": [0, 0], "lengths": [900, 1100], "codes": rng.integers(0, 30, 2000).astype("<u4").tobytes()})
    at = block.places(4)
    whole = len(Seeds(block, at, 4, 1).key)
    for slots in (16, 1000, 1 << 20):
        parts = [Seeds(block, at, 4, slots, (slots * t // TURNS, slots * (t + 1) // TURNS)) for t in range(TURNS)]
        assert sum(len(p.key) for p in parts) == whole
        rows = [r for p in parts for r in p.entries()]
        assert sum(len(d) // 10 for _, _, d in rows) == whole and len({s for s, _, _ in rows}) == len(rows)
        wide = Seeds(block, block.places(10), 10, slots, whole=True)
        assert sum(len(d) // 14 for _, _, d in wide.entries()) == len(wide.key) == len(np.unique(wide.key))
    import pyarrow as pa

    key, row, pos = told(pa.table({"k": [LONG], "slot": [5], "data": [np.array([1 << 60], "<u8").tobytes() + np.array([9], "<i8").tobytes() + np.array([4], "<u4").tobytes()]}), LONG)
    assert (key.tolist(), row.tolist(), pos.tolist()) == ([1 << 60], [9], [4])
