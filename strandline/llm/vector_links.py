"""Operator 13: near-duplicate vectors by Euclidean p-stable hashing.

Vectors are scaled to length 1, where a cosine of c is a distance of sqrt(2 - 2c). A table's hash is ``projections``
random projections, each shifted and cut into intervals of one width; near vectors fall into the same intervals with a
probability that the distance and the width alone decide. From it follow the number of projections (so that a
vector shares a bucket with less than one unrelated vector on average, at whatever size of the table) and of tables (so
that a pair at the threshold meets in some table with the probability asked for). Both grow with the logarithm and a small
power of the number of vectors; nothing is capped.

Equal vectors meet in an aggregation first, so a group of copies is one vector with a count. Buckets of one vector leave before
any vector is sent; larger ones are cut into blocks, and each pair of blocks is one group of bounded size. There cosines
are computed exactly, in double precision. A pair counts in the first table where it shares a bucket only,
which the two lists of buckets tell, so links are counted without being listed: what leaves a group is
a row for each of its linked vectors, with the number of its links and one vector that it is connected with.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, links with nothing and is its own component;
vectors of different lengths never link; copies link with each other; of repeated vec_ids each row stands for itself, and kept is true
for all of them if it is for one; a null vec_id takes part, but names a component (null) only where all its ids are null,
and isn't kept; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import arrow_map, bounded_batches, discard, stored
from strandline.llm.components import connected_components
from strandline.llm.unions import Unions

#: Width of an interval, for vectors of length 1.
WIDTH = 2.0
#: Vectors of one block; a group compares two blocks.
BLOCK_ROWS = 2048
SLICE = 512


def meeting_chance(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors at this distance share an interval of a random projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def hashing_plan(count: int, threshold: float, recall: float = 0.98, strangers: float = 0.25) -> tuple[int, int]:
    """Projections a table and tables. strangers: how many unrelated (orthogonal) vectors a bucket holds on average."""
    near, far = meeting_chance(math.sqrt(2 - 2 * threshold)), meeting_chance(math.sqrt(2))
    projections = max(4, math.ceil(math.log(max(count, 2) / strangers) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


@lru_cache(maxsize=8)
def _projections(tables: int, projections: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts, and odd numbers that mix a table's intervals into one hash."""
    rng = np.random.default_rng([seed, size])
    mix = rng.integers(0, 1 << 63, (tables, projections), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.standard_normal((size, tables * projections)), rng.random(tables * projections) * WIDTH, mix


def unit_rows(flat: np.ndarray, size: int) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so no square overflows or vanishes."""
    rows = flat.astype(np.float64).reshape(-1, size)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit rows, for each length of vectors."""
    offsets, flat = vectors.offsets.to_numpy().astype(np.int64), vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == size)
        yield which, unit_rows(flat[offsets[which][:, None] + np.arange(size)].ravel(), size)


def with_buckets(vectors: DataFrame, projections: int, tables: int, seed: int) -> DataFrame:
    """uid, n, v and buckets (a hash for each table) of vectors with uid, n, v."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((batch.num_rows, tables), dtype=np.uint64)
        for which, unit in _by_length(batch.column("v")):
            ways, shifts, mix = _projections(tables, projections, unit.shape[1], seed)
            cut = np.floor((unit @ ways + shifts) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
            h = (cut * mix).sum(axis=2, dtype=np.uint64)
            out[which] = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(unit.shape[1])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * tables), pa.array(out.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("n"), batch.column("v"), lists], names=["uid", "n", "v", "buckets"])

    return arrow_map(vectors.select("uid", "n", "v"), run, "uid long, n long, v array<double>, buckets array<long>")


def _rows_of(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def compare(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uid, links and uid of a connected vector, for each vector of two blocks (or one, with itself) of a bucket that links with another."""
    t, p, q = (group.column(c)[0].as_py() for c in ("t", "p", "q"))
    uid, n, block = (group.column(c).to_numpy() for c in ("uid", "n", "block"))
    unit = unit_rows(group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), len(group.column("v")[0]))
    buckets = _rows_of(group.column("buckets").combine_chunks())[:, :t]
    links, parts = np.zeros(len(uid), dtype=np.int64), Unions(len(uid))
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    for i in range(0, len(left), SLICE):
        x, y = np.nonzero(unit[left[i : i + SLICE]] @ unit[right].T >= threshold)
        x, y = left[i + x], right[y]
        once = x < y if p == q else np.ones(len(x), dtype=bool)
        x, y = x[once], y[once]
        for j in range(0, len(x), 1 << 16):  # a pair that met in an earlier table was counted there
            a, b = x[j : j + (1 << 16)], y[j : j + (1 << 16)]
            new = ~(buckets[a] == buckets[b]).any(axis=1)
            a, b = a[new], b[new]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            parts.link(a, b)
    linked = np.flatnonzero(links)
    return uid[linked], links[linked], uid[parts.label[linked]]


def counted_links(held: DataFrame, tables: int, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """uid, links, root: the links that each group finds. held: a stored table of uid, n, v, buckets."""
    keyed = held.select("uid", F.posexplode("buckets").alias("t", "bucket"))
    shared = keyed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    placed = keyed.join(shared, ["t", "bucket"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("uid", "t", "bucket", "block", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"))
    sent = placed.join(held, "uid").repartition("t", "bucket", "p", "q").sortWithinPartitions("t", "bucket", "p", "q")
    bounded_batches(held.sparkSession)

    def found(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        out = [compare(g, threshold) for g in groups]
        columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest is None or not rest.num_rows:
                continue
            keys = [rest.column(c).to_numpy() for c in ("t", "bucket", "p", "q")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            edges = [0, *cuts.tolist(), *([rest.num_rows] if batch is None else [])]
            if len(edges) > 1:
                whole = rest.combine_chunks()
                yield from found([whole.slice(a, b - a) for a, b in itertools.pairwise(edges)])
                rest = whole.slice(edges[-1])

    return sent.select("t", "bucket", "p", "q", "block", "uid", "n", "v", "buckets").mapInArrow(run, "uid long, links long, root long")


def near_vectors(rows: DataFrame, threshold: float = 0.95, recall: float = 0.98, seed: int = 13) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of rows (vec_id, embedding)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("able", F.coalesce(finite, F.lit(False)))
    able = rows.where("able").select("vec_id", "v")
    distinct = able.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = stored(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct-vectors")
    projections, tables = hashing_plan(distinct.count(), threshold, recall)
    held = stored(with_buckets(distinct, projections, tables, seed), "vector-buckets")
    found = stored(counted_links(held, tables, threshold), "vector-links")
    discard(held)
    labels = connected_components(found.where("uid <> root").select(F.col("uid").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    placed = distinct.join(links, "uid", "left").join(labels, F.col("uid") == F.col("node"), "left")
    placed = placed.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "uid").alias("label"))
    ids = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = placed.join(ids, "label").select(F.col("v").alias("own"), "n_links", "component_id")
    linked = able.join(placed.hint("shuffle_hash"), F.col("v") == F.col("own")).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = r"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS u, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
a AS (SELECT * FROM e WHERE len(v) > 0 AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in v if x <> 0]) > 0),
l AS (SELECT a.u AS a, b.u AS b FROM a JOIN a AS b ON a.u < b.u AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
s AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT u, u FROM e UNION SELECT r.x, s.y FROM r JOIN s ON s.x = r.y),
c AS (SELECT r.x, min(e.vec_id) AS component_id FROM r JOIN e ON e.u = r.y GROUP BY r.x),
n AS (SELECT x, count(*) AS n FROM s GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, false) AS kept
FROM e JOIN c ON c.x = e.u LEFT JOIN n ON n.x = e.u
"""
