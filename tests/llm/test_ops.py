"""Each operator against brute force, on odd rows, and on empty tables."""

import json
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import queries as Q


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


def words(text):
    return text.encode().split()


# 1


def test_chat_collapses_prefixes_and_copies(spark):
    from strandline.llm.chat import format_chats

    turns = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "bot", "other"), (5, 0, None, None), (5, None, "user", ""), (None, 0, "user", "nobody"), (6, 0, "user", "a"), (6, 0, "user", "a"), (7, 300, "user", "<|im_end|>"), (7, 2, "bot", None)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, part string")
    got = {(r.conv_id, r.part): r for r in format_chats(df).collect()}
    assert {c for c, _ in got} == {2, 4, 5, None, 7}
    assert got[2, 0].n_copies == 2 and got[2, 0].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[7, 1].rendered.count("< |im_end|>") == 1 and got[7, 0].rendered == "<|im_start|>bot\n<|im_end|>\n"
    assert format_chats(df.where("false")).count() == 0


def test_chat_brute_force(spark):
    import random

    from strandline.llm.chat import format_chats

    rng, turns = random.Random(5), []
    for c in range(120):
        base = [rng.choice("ab") for _ in range(rng.randrange(1, 7))]
        turns += [(c, i, "user" if i % 2 == 0 else "bot", x) for i, x in enumerate(base)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    text = defaultdict(list)
    for c, _, r, t in turns:
        text[c].append((r, t))
    keep = {c for c in text if not any(text[o][: len(text[c])] == text[c] and (len(text[o]) > len(text[c]) or o < c) for o in text if o != c)}
    assert {r.conv_id for r in format_chats(df, part_turns=2).collect()} == keep


# 2


def test_token_files(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    from strandline.llm.common import scratch_path
    from strandline.llm.token_files import lookup, read_token_files, token_files, write_token_files

    path = Q.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = sorted(token_files(odd_docs, path).collect(), key=lambda r: r.start)
    want = sorted(((-1 if i is None else i, t) for i, t, _ in rows_of(odd_docs)), key=lambda x: x[0])
    start = 0
    by_id = defaultdict(list)
    for i, t in want:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        by_id[i].append((len(ids), zlib.crc32(ids.tobytes())))
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == [i for i, _ in want]
    for r in got:
        assert r.start == start
        start += r.n_tokens
        by_id[-1 if r.doc_id is None else r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert token_files(no_docs, path).count() == 0
    folder = scratch_path(spark, "test-tokens")
    write_token_files(odd_docs, folder, path)
    assert lookup(spark, folder, [3, 4]).count() == 2 and read_token_files(spark, folder).count() == len(want)


# 3


@pytest.fixture(scope="module")
def unigram():
    from strandline.llm.unigram import load_unigram

    return load_unigram(Q.tokenizer_path("piece_bpe_32k.model"))


def brute_score(model, unit):
    """The best score over all ways to cut a short unit."""
    ids = {p: i for i, p in enumerate(model.pieces) if model.scores[i] != 0}
    best = {0: 0.0}
    for s in range(len(unit)):
        if s not in best or unit[s] & 0xC0 == 0x80:
            continue
        n = 1 if unit[s] < 0x80 else 2 if unit[s] < 0xE0 else 3 if unit[s] < 0xF0 else 4
        for e in range(s + 1, len(unit) + 1):
            if unit[s:e] in ids:
                best[e] = max(best.get(e, -np.inf), best[s] + model.scores[ids[unit[s:e]]])
        if unit[s : s + n] not in ids:
            best[s + n] = max(best.get(s + n, -np.inf), best[s] + model.unknown)
    return best[len(unit)]


def test_unigram_is_the_best_path(unigram):
    from strandline.llm.unigram import MARKER

    units = [w.replace(b" ", MARKER) for w in (b" the", b" internationalisation", " über".encode(), "  é🙂x".encode(), b" qzxv", b"\n", b" aaaaaaaa", " 中文字".encode(), b" " + b"thestring" * 12)]
    byte_ids = set(unigram.byte_ids.tolist())
    for u, path in zip(units, unigram.best_paths(units), strict=True):
        total, i = 0.0, 0
        while i < len(path):
            if path[i] in byte_ids:
                first = unigram.spelling[path[i]][0]
                i += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                total += unigram.unknown
            else:
                total += unigram.scores[path[i]]
                i += 1
        assert total == pytest.approx(brute_score(unigram, u))


def test_unigram_matches_the_library(unigram, sf, spark):
    sp = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from strandline.llm.unigram import encode_texts

    proto = pb.ModelProto()
    with open(Q.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = float(unigram.scores[i])
    library = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    same = 0
    for t, blob in zip(texts, encode_texts(unigram, [t.encode() for t in texts]), strict=True):
        mine, theirs = np.frombuffer(blob, "<i4").tolist(), library.encode(t)
        same += mine == theirs
        assert unigram.scores[mine].sum() == pytest.approx(unigram.scores[theirs].sum(), abs=0.01)
    assert same > 0.9 * len(texts)  # the rest are ties


def test_sentencepiece_round_trip(spark, odd_docs, no_docs, unigram):
    from strandline.llm.unigram import decode_documents, encode_documents, encoding_digest

    got = encoding_digest(odd_docs, unigram).collect()
    assert len(got) == odd_docs.count() and all(r.round_trip for r in got)
    assert [r.n_tokens for r in got if r.doc_id == 3] == [0]
    back = Counter((r.doc_id, r.text) for r in decode_documents(encode_documents(odd_docs, unigram), unigram).collect())
    assert back == Counter((i, t.replace("▁", " ")) for i, t, _ in rows_of(odd_docs))
    assert encoding_digest(no_docs, unigram).count() == 0


# 4


def test_quality_rules(odd_docs, no_docs):
    from strandline.llm.quality_rules import RULES, Doc, quality_rules, repeat_words

    got = Counter(tuple(r) for r in quality_rules(odd_docs).collect())
    want = Counter()
    for i, t, _ in rows_of(odd_docs):
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for k in (p, p + 1, p + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        base = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        kept = not base and not any(rule(Doc(t.encode())) for rule in RULES.values())
        want[i, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), base, kept] += 1
    assert got == want
    assert quality_rules(odd_docs, order=sorted(RULES)).exceptAll(quality_rules(odd_docs, order=sorted(RULES)[::-1])).count() == 0
    assert quality_rules(no_docs).count() == 0
    many = [b"a", b"b", b"c", b"d"] * 30 + [str(i).encode() for i in range(250_000)]
    assert repeat_words(many) == 120


# 5


def test_passages_brute_force(spark, odd_docs, no_docs):
    from strandline.llm.substring import repeated_passages

    got = repeated_passages(odd_docs).collect()
    assert {(r.doc_id, r.rep_doc_id) for r in got} == {(9, 8), (12, 1)}
    for r in got:
        assert r.n_words >= 80 and r.identity >= 0.95
    assert repeated_passages(no_docs).count() == 0


def test_fuzzy_passages_and_removal(spark):
    import random

    from strandline.llm.substring import remove_passages, repeated_passages

    rng = random.Random(1)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, docs = prose(90), []
    for i in range(40):
        p = list(passage)
        for k in range(7, 90, 13):
            p[k] = f"e{i}_{k}"
        if i % 3 == 0:
            del p[30]
        docs.append((i, " ".join([*prose(50), *p, *prose(50)]) if i % 2 == 0 else " ".join(prose(150))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = repeated_passages(df).cache()
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == set(range(2, 40, 2))
    assert got.where("rep_doc_id % 2 = 1").count() == 0
    left = {r.doc_id: r.text for r in remove_passages(df, got).collect()}
    assert left[0] == docs[0][1] and left[1] == docs[1][1]
    assert all(100 <= len(left[i].split()) <= 130 for i in range(2, 40, 2))


def test_chaining_and_fenwick():
    from strandline.llm.substring import Fenwick, align, chain, without_words

    tree, seen = Fenwick(50), {}
    rng = np.random.default_rng(0)
    for i in range(300):
        p, v = int(rng.integers(50)), float(rng.integers(1000))
        tree.put(p, v, i)
        seen[i] = (p, v)
        q = int(rng.integers(51))
        best = max(((v, k) for k, (p, v) in seen.items() if p < q), default=(-np.inf, -1))
        assert tree.below(q) == best
    assert chain([0, 10, 20, 21], [100, 112, 5, 121], [8, 8, 8, 8])[0] == [0, 1, 3]
    a = np.arange(100, dtype=np.uint32)
    b = np.concatenate([a[:50], [999], a[50:]]).astype(np.uint32)
    assert align(a, b, [[10, 10, 20], [60, 61, 20]], True, True) == [(0, 100, 0, 101, 100)]
    assert without_words(b"a b  c d\n", [(1, 3)]) == b"a d\n"


# 6


def test_mixing(odd_docs, no_docs, spark, sf):
    from strandline.llm.mixing import mix, mixing_plan, source_targets

    plan = mixing_plan(odd_docs).collect()
    assert len(plan) == odd_docs.count()
    sizes = Counter((i, len(words(t)), s) for i, t, s in rows_of(odd_docs))
    assert Counter((r.doc_id, r.size, r.source) for r in plan) == sizes
    assert all(r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in plan)
    mixed = mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing_plan(no_docs).count() == 0 and mix(no_docs).count() == 0
    s = spark.createDataFrame([("a", 100), ("b", 900), ("c", 5), (None, 0)], "source string, size long")
    t = {r.source: r.target for r in source_targets(s).collect()}
    assert t["a"] == 300 and t["c"] == 15 and t[None] == 0 and t["b"] == pytest.approx(690)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    per = mixing_plan(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("m")).collect()
    assert all(abs(r.k - r.t) <= 3 * r.m for r in per)


# 7


def test_classifier(spark, odd_docs, no_docs):
    from strandline.llm.quality_model import fit, held_out, quality_scores, scores

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_scores(docs, labels)
    kept = got.join(labels, "doc_id").where("held_out")
    right, n = kept.where("predicted = quality").count(), kept.count()
    assert n > 50 and right / n > 0.95
    model = fit(docs, labels)
    twice = fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(model.threshold, twice.threshold) and np.array_equal(model.leaf, twice.leaf)
    odd = scores(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert scores(no_docs, model).count() == 0
    none = quality_scores(odd_docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    odd_labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (8, 1), (9, 0)], "doc_id long, quality int")
    assert quality_scores(odd_docs, odd_labels).count() == odd_docs.count()
    held = {r.i for r in spark.range(200).select(F.col("id").alias("i"), held_out("id").alias("h")).where("h").collect()}
    assert held == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_trees_fit_a_rule():
    from strandline.llm.gbdt import train

    rng = np.random.default_rng(2)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = train(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97

    def walk(row):
        total = model.bias
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])


# 8


def test_media(odd_docs, no_docs):
    import hashlib

    from strandline.llm.media import media_column, media_digest, pad

    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media_digest(media_column(odd_docs)).collect())
    want = Counter()
    for i, t, _ in rows_of(odd_docs):
        p = pad(t.encode())
        want[i, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
        assert len(p) % 64 == 0 and p
    assert got == want
    assert media_digest(media_column(no_docs)).count() == 0


def test_png_filters_and_damage():
    from strandline.llm.media import _chunk, _unfiltered, cosine_hash, png_decode, png_encode

    rng = np.random.default_rng(4)
    rows = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    kinds, out = rng.integers(0, 5, 40).astype(np.uint8), np.zeros_like(rows)
    for y in range(40):
        for x in range(64):
            a, b, c = (int(rows[y, x - 1]) if x else 0), (int(rows[y - 1, x]) if y else 0), (int(rows[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kinds[y]]
            out[y, x] = (int(rows[y, x]) - guess) % 256
    assert np.array_equal(_unfiltered(kinds, out), rows)
    simple = kinds % 3
    for y in range(40):
        up = rows[y - 1] if y else 0
        out[y] = rows[y] - [0, np.concatenate([[0], rows[y, :-1]]).astype(np.uint8), up][simple[y]]
    assert np.array_equal(_unfiltered(simple, out), rows)
    payload = rows.tobytes()
    data = png_encode(payload)
    assert png_decode(data).tobytes() == payload
    for broken in (data[:-3], data[:60] + bytes([data[60] ^ 1]) + data[61:], b"x" + data[1:]):
        with pytest.raises((ValueError, zlib.error)):
            png_decode(broken)
    assert _chunk(b"IEND", b"") == b"\0\0\0\0IEND\xaeB`\x82"
    assert cosine_hash(rows) == cosine_hash(rows.copy()) and len(cosine_hash(rows)) == 16


# 9


def brute_fingerprint(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    w = text.encode().translate(low).split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_components(fps, ids, radius=3):
    above = list(range(len(fps)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                above[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash(spark, odd_docs, no_docs, sf):
    from strandline.llm.simhash import simhash_components

    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = rows_of(docs)
        fps = [brute_fingerprint(t) for _, t, _ in rows]
        want = Counter(zip([i for i, _, _ in rows], [f"{f:016x}" for f in fps], brute_components(fps, [i for i, _, _ in rows]), strict=True))
        assert Counter(tuple(r) for r in simhash_components(docs).collect()) == want
    assert simhash_components(no_docs).count() == 0


def test_vantage_tree_links_across_shards(spark):
    from strandline.llm.components import connected_components
    from strandline.llm.simhash import fingerprint_links

    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = base[rng.integers(0, 1500, 1500)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    labels = {r.node: r.label for r in connected_components(fingerprint_links(df, len(fps), 3, shard_rows=100, sample_rows=500)).collect()}
    signed = [int(x) for x in fps.view(np.int64)]
    want = brute_components([int(x) for x in fps], signed)
    assert [labels.get(s, s) for s in signed] == want


def test_components_of_long_chains(spark):
    from strandline.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 200 - i) for i in range(20)] + [(300, 300 + i) for i in range(1, 40)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[200 - i] == 100 + i for i in range(20)) and all(got[300 + i] == 300 for i in range(1, 40))


# 10


def test_sharding(spark, odd_docs, no_docs, sf):
    from strandline.llm.sharding import pack, shard

    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        got = shard(docs).collect()
        want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in rows_of(docs))
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(16))
    assert shard(no_docs).count() == 0
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, F.lit("hot text here " * 30)).otherwise(F.concat(F.lit("cold "), F.repeat(F.md5(F.col("id").cast("string")), 12))).alias("text"))
    per = shard(hot).groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    mean = sum(r.b for r in per) / 16
    assert len(per) == 16 and all(abs(r.b / mean - 1) < 0.05 for r in per)
    rng = np.random.default_rng(1)
    loads = rng.lognormal(0, 1, (3000, 3)) * [100, 20, 1]
    where = pack(loads, 16)
    total = np.array([loads[where == s].sum(axis=0) for s in range(16)])
    assert (np.abs(total[:, 0] / total[:, 0].mean() - 1) < 0.02).all()


# the package and the pipeline


def test_queries_are_whole():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 14)]
    json.dumps(Q.oracle_sql())


def test_pipeline_stages(spark, sf, odd_docs, no_docs):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        out = C.stored(stage(spark, docs, sf), "test-stage")
        seen[name] = (docs, out)
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    before, after = seen["simhash_near_dedup"]
    rows = rows_of(before)
    comps = brute_components([brute_fingerprint(t) for _, t, _ in rows], [i for i, _, _ in rows])
    assert {r.doc_id for r in after.collect()} == set(comps)
    before, after = seen["substring_dedup"]
    old = {r.doc_id: r.text for r in before.collect()}
    assert all(len(r.text) <= len(old[r.doc_id]) for r in after.collect())
    assert seen["sentencepiece"][1].count() == seen["mixing"][1].count() > 0
    for name, stage in C.STAGES:
        assert stage(spark, no_docs, sf).count() == 0, name
    assert os.path.isdir(sf)


def test_pipeline_stages_on_odd_rows(spark, sf, odd_docs):
    """Each stage on the same odd rows: what stays is what its docstring says, with all columns as they were."""
    import corpus_pipeline as C
    from strandline.llm.mixing import mixing_plan
    from strandline.llm.quality_model import fit, with_scores

    stages = dict(C.STAGES)
    whole = Counter(map(repr, odd_docs.collect()))
    out = {name: stages[name](spark, odd_docs, sf).collect() for name in stages}
    rows = lambda name: Counter(map(repr, out[name]))
    # accepted rows stay as they are, repeated ones as often; fitted on this table's own labelled rows
    model = fit(odd_docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = with_scores(odd_docs, model, "s").where(F.col("s") >= C.THRESHOLD).drop("s").collect()
    assert rows("quality_classifier") == Counter(map(repr, kept)) and not rows("quality_classifier") - whole
    # one row of each component, and all rows without an id
    assert not rows("simhash_near_dedup") - whole
    ids = [r.doc_id for r in out["simhash_near_dedup"]]
    assert ids.count(None) == 1 and len({(r.doc_id, r.text) for r in out["simhash_near_dedup"]}) == len(ids)
    given = rows_of(odd_docs)
    comps = brute_components([brute_fingerprint(t) for _, t, _ in given], [i for i, _, _ in given])
    assert {i for i in ids if i is not None} == {c for c in comps if c is not None}
    # the later of two documents loses the passage that both hold, with its words alone; rows without words in common stay
    before = Counter((r.doc_id, r.text) for r in odd_docs.collect())
    after = Counter((r.doc_id, r.text) for r in out["substring_dedup"])
    assert all(before[k] for k in after if k[0] not in (9, 12)) and len(out["substring_dedup"]) <= len(given)
    eight = next(t for i, t, _ in given if i == 8).split()
    nine = [r.text.split() for r in out["substring_dedup"] if r.doc_id == 9]
    assert nine and all(len(w) == 80 and not set(zip(w, w[1:], w[2:], strict=False)) & set(zip(eight[40:120], eight[41:120], eight[42:120], strict=False)) for w in nine)
    assert not [r for r in out["substring_dedup"] if r.doc_id == 12]  # a copy of 1: nothing is left
    # as many rows as the plan takes, each one of the table's
    assert sum(rows("mixing").values()) == sum(r.copies for r in mixing_plan(odd_docs).collect()) and not set(rows("mixing")) - set(whole)
    # a row each; null and empty texts have no pieces
    assert len(out["sentencepiece"]) == len(given)
    assert all((r.n_tokens == 0) == (r.doc_id in (3, 4)) and len(r.ids) == r.n_tokens for r in out["sentencepiece"])


def test_chat_hot_turns_are_cut_by_rows(spark):
    from strandline.llm.chat import format_chats

    rows = [(None, 0, "user", f"{i:05d}") for i in range(3000)] + [(None, None, "user", "first"), (None, -700, "user", "low"), (4, 0, "user", "00000")] + [(9, 0, "user", "same")] * 500
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    hot = sorted((r for r in got if r.conv_id is None and r.part == 0), key=lambda r: r.piece)
    assert [r.n_turns for r in hot] == [256] * 11 + [184]
    assert "".join(r.rendered for r in hot) == "".join(f"<|im_start|>user\n{i:05d}<|im_end|>\n" for i in range(3000))
    assert {(r.conv_id, r.part, r.n_turns) for r in got if r.conv_id is not None or r.part < 0} == {(None, -1, 1), (None, -3, 1), (4, 0, 1), (9, 0, 1)}


def test_cosine_hash_brute_force():
    from strandline.llm.media import cosine_hash

    rng = np.random.default_rng(6)
    for height in (1, 5, 32, 77):
        rows = rng.integers(0, 256, (height, 64)).astype(np.uint8)
        columns = [[(int(r[2 * x]) + int(r[2 * x + 1])) / 2 for x in range(32)] for r in rows]
        grid = []
        for band in range(32):
            lo, hi = band * height // 32, max((band + 1) * height // 32, band * height // 32 + 1)
            grid.append([sum(columns[y][x] for y in range(lo, hi)) / (hi - lo) for x in range(32)])
        low = [round(sum(grid[y][x] * np.cos(np.pi / 32 * (y + 0.5) * v) * np.cos(np.pi / 32 * (x + 0.5) * u) for y in range(32) for x in range(32)), 6) for v in range(8) for u in range(8)]
        middle = sorted(low[1:])[31]
        assert cosine_hash(rows) == f"{int(''.join('1' if c > middle else '0' for c in low), 2):016x}"


def test_sharding_of_equal_rows(spark):
    from strandline.llm.sharding import shard

    hot = [(None, "the same text, over and over, without an id") for _ in range(3000)]
    rest = [(i, f"text {i} " * (1 + i % 7)) for i in range(1000)] + [(i, f"pair {i % 150}") for i in range(2000, 2300)]
    got = shard(spark.createDataFrame(hot + rest, "doc_id long, text string")).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 16
    assert len(size) == 16 and all(abs(v / mean - 1) < 0.03 for v in size.values())
    of = {r.doc_id: r.shard for r in got if r.doc_id is not None}
    assert all(of[2000 + k] == of[2150 + k] for k in range(150))  # equal texts stay together
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_statistics_brute_force():
    from strandline.llm.quality_model import STATISTICS, statistics

    body = "The cat, the dog!\n\nThe cat, 42 | a@b.c\nThe cat, the dog!\n#1".encode()
    got = dict(zip(STATISTICS, statistics(body), strict=True))
    w = body.split()
    assert got["log_words"] == pytest.approx(np.log(1 + len(w))) and got["word_length"] == pytest.approx(sum(map(len, w)) / len(w))
    assert got["distinct_words"] == pytest.approx(len(set(w)) / len(w) ** 0.8) and got["common_word"] == pytest.approx(3 / len(w))
    assert got["capitals"] == pytest.approx(3 / len(body)) and got["pipes"] == pytest.approx(1 / len(body)) and got["digits"] == pytest.approx(3 / len(body))
    assert got["log_lines"] == pytest.approx(np.log(5)) and got["repeated_lines"] == pytest.approx(1 / 4)
    pairs = list(zip(w, w[1:], strict=False))
    assert got["repeated_pairs"] == pytest.approx(1 - len(set(pairs)) / len(pairs))
    assert statistics(b"")[0] == 0 and len(statistics(b"")) == len(STATISTICS)


def test_mixing_of_equal_rows_and_missing_ids(spark):
    from strandline.llm.mixing import mix, mixing_plan

    rows = [(None, f"{'word ' * (1 + i % 40)}{i}", "a") for i in range(800)] + [(7, "same words here", "b")] * 900 + [(1000 + i, "x " * 30, "c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing_plan(df).collect()
    assert len(plan) == len(rows) and sum(r.doc_id == 7 for r in plan) == 900
    taken, target = Counter(), {}
    for r in plan:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 42 for s, t in target.items())
    again = mixing_plan(df.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, plan))
    assert mix(df).count() == sum(r.copies for r in plan)
