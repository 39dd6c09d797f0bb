"""Operator 9: SimHash near-duplicates, found with vantage-point trees.

Each text's fingerprint is the bitwise majority of its shingles' hashes. Distinct fingerprints
are split into shards by a vantage-point tree that is built on the driver from a bounded sample:
a node sends a fingerprint inside or outside by its Hamming distance to the node's vantage
point. A fingerprint is at home in one shard. Where it stands less than the search radius from
an inner border it also visits the outer side, and a visitor follows every branch that the triangle
inequality doesn't exclude. So each pair within the radius meets in exactly the larger side's home
shard. In a shard, a smaller tree of the same kind prunes until blocks are compared bit by bit,
and only a spanning forest of the links leaves it: rows stay linear in fingerprints even in a dense
group. Components come from star rounds over these links.

Equal fingerprints meet in an aggregation before any of this, so a group of copies costs one
fingerprint, whatever its size.

Defined results: a null or empty text, or one without words, has fingerprint 0, which links like
any other; a bit that half of the hashes have is 0; very long texts are hashed in parts; repeated rows share fingerprint and component; a null doc_id takes part but is never a
component's id unless all of its ids are null; an empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import arrow_map, doc_bytes, stored
from strandline.llm.components import connected_components
from strandline.llm.unions import Unions

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15


def shingle_hashes(body: bytes, n: int = 3) -> np.ndarray:
    """XXH64 of every n-word shingle, repeats included."""
    words = body.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < n:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)


def fingerprint(body: bytes, n: int = 3) -> int:
    """Bits set in over half of the shingles' hashes; 0 without words."""
    hashes = shingle_hashes(body, n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, version (the hash of the text) and fp (the fingerprint's 64 bits as a signed long) for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(b) for b in batch.column("body").to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(fps)], names=["doc_id", "version", "fp"])

    return arrow_map(doc_bytes(docs, F.xxhash64("text").alias("version")), run, "doc_id long, version long, fp long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class VantageTree:
    """A complete binary tree of vantage points; leaves are shards.

    As many levels as the sample can split well have vantage points from it. Below, however deep, a node's point
    follows from its number, with a radius of 31: half of all fingerprints are nearer.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.sampled = min(depth, int(np.log2(max(1, len(sample) / 5))))
        inner = (1 << self.sampled) - 1
        self.points = np.zeros(inner, dtype=np.uint64)
        self.radii = np.full(inner, 31, dtype=np.int64)
        parts = {0: sample}
        for node in range(inner):
            own = parts.pop(node)
            if len(own):
                self.points[node] = own[len(own) // 2]
                away = np.bitwise_count(own ^ self.points[node]).astype(np.int64)
                self.radii[node] = int(np.median(away))
                parts[2 * node + 1], parts[2 * node + 2] = own[away <= self.radii[node]], own[away > self.radii[node]]
            else:
                parts[2 * node + 1] = parts[2 * node + 2] = own

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, shards and whether the row is at home there."""
        rows, node, home = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), np.ones(len(fps), dtype=bool)
        for level in range(self.depth):
            points, mu = (self.points[node], self.radii[node]) if level < self.sampled else (_mixed(node), 31)
            away = np.bitwise_count(fps[rows] ^ points).astype(np.int64)
            inside = np.where(home, away <= mu, away <= mu + radius)
            outside = np.where(home, away > mu, away > mu - radius)
            visits = home & (away <= mu) & (away > mu - radius)
            parts = [(inside, 1, home), (outside, 2, home), (visits, 2, np.zeros(len(rows), dtype=bool))]
            rows, node, home = (np.concatenate([x[keep] for keep, x in pairs]) for pairs in ([(k, rows) for k, _, _ in parts], [(k, 2 * node + c) for k, c, _ in parts], [(k, h) for k, _, h in parts]))
        return rows, node - ((1 << self.depth) - 1), home


def _links(home: np.ndarray, seek: np.ndarray, radius: int, link, leaf: int = 1024) -> None:
    """Calls link(a, b) with arrays of pairs within the radius, home against seek, by a local tree."""
    if not len(home) or not len(seek):
        return
    if len(home) <= leaf:
        step = max(1, (1 << 19) // len(home))
        for i in range(0, len(seek), step):
            near = np.bitwise_count(seek[i : i + step, None] ^ home[None, :]) <= radius
            a, b = np.nonzero(near)
            if len(a):
                link(seek[i + a], home[b])
        return
    point = home[len(home) // 2]
    away, sought = np.bitwise_count(home ^ point).astype(np.int64), np.bitwise_count(seek ^ point).astype(np.int64)
    mu = int(np.median(away))
    if (away <= mu).all():
        mu -= 1
    if (away <= mu).any() and (away > mu).any():
        _links(home[away <= mu], seek[sought <= mu + radius], radius, link, leaf)
        _links(home[away > mu], seek[sought > mu - radius], radius, link, leaf)
    else:
        for i in range(0, len(home), leaf):
            _links(home[i : i + leaf], seek, radius, link, leaf)


def spanning_links(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all pairs within the radius, of home with home and visitors."""
    every = np.unique(np.concatenate([home, visitors]))
    parts = Unions(len(every))
    _links(home, np.concatenate([home, visitors]), radius, lambda a, b: parts.link(np.searchsorted(every, a), np.searchsorted(every, b)))
    linked = np.flatnonzero(parts.label != np.arange(len(every)))
    return every[linked], every[parts.label[linked]]


def fingerprint_links(distinct: DataFrame, count: int, radius: int, shard_rows: int = 8192, sample_rows: int = 20_000) -> DataFrame:
    """u, v: links that connect all fingerprints within the radius. distinct: fp, no repeats."""
    spark = distinct.sparkSession
    depth = max(0, int(np.ceil(np.log2(max(1, count / shard_rows)))))
    share = min(1.0, sample_rows / max(1, count))
    picked = distinct.where((F.xxhash64("fp") / 2.0**64 + 0.5) <= share).orderBy(F.xxhash64("fp")).limit(2 * sample_rows)
    sample = np.array([r[0] for r in picked.collect()], dtype=np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(VantageTree(sample, depth))

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        rows, shard, home = tree.value.route(fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(home), pa.array(fps[rows].view(np.int64))], names=["shard", "home", "fp"])

    def search(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        a, b = spanning_links(np.sort(fps[home]), fps[~home], radius)
        signed = lambda x: pa.array(x.astype(np.uint64).view(np.int64))
        return pa.table({"u": signed(a), "v": signed(b)})

    routed = arrow_map(distinct.select("fp"), route, "shard long, home boolean, fp long")
    return routed.groupBy("shard").applyInArrow(search, "u long, v long")


def placed_components(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, version, fp, label (the smallest fingerprint of its component) and component_id for every row of docs."""
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    labels = connected_components(fingerprint_links(distinct, distinct.count(), radius))
    placed = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = placed.join(ids, "label").select("fp", "label", "component_id")
    return rows.join(placed, "fp")


def simhash_components(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of docs."""
    return placed_components(docs, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
