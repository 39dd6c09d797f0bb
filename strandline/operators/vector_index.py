"""A stored vector index: inverted lists of quantised vectors, so that a search reads a few lists and no other vector.

Centroids come from k-means over a bounded sample, each round one job over the sample's partitions. Every
row is assigned to the lists of its nearest centroids (``copies`` of them) and stored there as one byte a component with a scale, beside its exact
vector. Lists are partitions' parts: a search finds the lists nearest to its queries, reads the bytes of these alone,
keeps the best rows of each query by them, and ranks those by their exact vectors.

It is written in versions, like the keyword index; the table of lists comes last, and a version without it isn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.keyword_index import claimed_version, versions
from strandline.session import stored

#: Folders that lists are dealt over, rows of a piece of a list, and queries that meet a group of pieces at once.
PARTS, PIECE_ROWS, QUERY_ROWS = 64, 8192, 1 << 15
#: Components of all vectors of a group of pieces: a task holds one group.
GROUP_NUMBERS = 1 << 22
#: Lists of an index at most (they are sent to all tasks), and sampled rows a list.
MOST_LISTS, SAMPLE_A_LIST = 1 << 16, 64


def unit_matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1 in double precision; zero rows stay."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def list_count(rows: int) -> int:
    """As many lists as a list has rows, up to MOST_LISTS."""
    return min(MOST_LISTS, max(1, round(rows**0.5)))


def fit_centroids(sample: DataFrame, lists: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids of a stored sample (v). Sums of a round leave a task as one row a list."""
    first = sample.orderBy(F.xxhash64("v")).limit(lists).toArrow()
    centroids = unit_matrix(first.column("v"))

    def one_round(now: np.ndarray) -> np.ndarray:
        sent = sample.sparkSession.sparkContext.broadcast(now)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(sent.value), np.zeros(len(sent.value), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    m = unit_matrix(batch.column("v"))
                    near = (m @ sent.value.T).argmax(axis=1)
                    np.add.at(total, near, m)
                    n += np.bincount(near, minlength=len(n))
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(list(total[held]), type=pa.list_(pa.float64()))], names=["list", "total"])

        def added(table: pa.Table) -> pa.Table:
            m = table.column("total").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
            return pa.table({"list": table.column("list")[:1], "total": pa.array([m], type=pa.list_(pa.float64()))})

        found = sample.mapInArrow(sums, "list long, total array<double>").groupBy("list").applyInArrow(added, "list long, total array<double>").toArrow()
        out = now.copy()
        if found.num_rows:
            out[found.column("list").to_numpy()] = unit_matrix(found.column("total"))
        return out

    for _ in range(rounds):
        moved = one_round(centroids)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def write_vector_index(rows: DataFrame, path: str, id_: str = "id", embedding: str = "embedding", lists: int | None = None, copies: int = 2) -> int:
    """Writes the next version of the index of rows whose embedding isn't null, and returns its number."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_).cast("long").alias("id"), F.col(embedding).alias("v")).where("v IS NOT NULL AND size(v) > 0")
    count = rows.count()
    lists = lists or list_count(count)
    share = min(1.0, 1.2 * lists * SAMPLE_A_LIST / max(1, count))
    sample = stored(rows.where((F.xxhash64("id", F.lit(1)) / 2.0**64 + 0.5) <= share).select("v"), "vector-sample")
    centroids = fit_centroids(sample, lists)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = unit_matrix(batch.column("v"))
                n = min(copies, len(sent.value))
                near = np.argsort(-(m @ sent.value.T), axis=1, kind="stable")[:, :n].ravel()
                scale = np.abs(m).max(axis=1) / 127
                codes = np.rint(np.divide(m, scale[:, None], out=np.zeros_like(m), where=scale[:, None] > 0)).astype(np.int8)
                each = pa.array(np.repeat(np.arange(len(m)), n))
                code = pa.array([c.tobytes() for c in codes], type=pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(m))), batch.column("id").take(each), pa.array(scale.astype(np.float32)).take(each), code.take(each), batch.column("v").take(each)], names=["list", "copy", "id", "scale", "code", "v"])

    version = claimed_version(spark, path)
    at, kind = f"{path}/v{version}", dict(rows.dtypes)["v"]
    placed = stored(rows.mapInArrow(assign, f"list int, copy int, id long, scale float, code binary, v {kind}"), "vector-lists")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("copy") == 0).alias("firsts")).withColumn("pieces", F.ceil(F.col("n") / PIECE_ROWS).cast("int"))
    cut = placed.join(F.broadcast(sizes.select("list", "pieces")), "list")  # a row a list
    cut = cut.select((F.col("list") % PARTS).alias("part"), "list", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "copy", "id", "scale", "code", "v")
    cut.hint("rebalance", "part").sortWithinPartitions("part", "list", "piece").write.mode("overwrite").partitionBy("part").parquet(f"{at}/rows")
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    centres.join(sizes, "list", "left").select("list", F.coalesce("pieces", F.lit(0)).alias("pieces"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("firsts", F.lit(0)).alias("firsts"), "centroid").coalesce(1).write.mode("overwrite").parquet(f"{at}/figures")
    return version


def index_lists(spark: SparkSession, path: str) -> DataFrame:
    """list, pieces, n, firsts (rows whose nearest list it is) and centroid of the newest whole version: MOST_LISTS rows at most."""
    return spark.read.parquet(f"{path}/v{versions(spark, path)[-1]}/figures")


def index_rows(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    """Rows of the newest version, or of some of its lists: only their folders and row groups are read."""
    rows = spark.read.parquet(f"{path}/v{versions(spark, path)[-1]}/rows")
    if lists is None:
        return rows
    return rows.where(F.col("part").isin(sorted({x % PARTS for x in lists})) & F.col("list").isin(lists))


def nearest_in_index(queries: DataFrame, path: str, k: int = 10, probes: int = 8, refine: int = 8, others: bool = True) -> DataFrame:
    """query, id, similarity: for each query the k rows of greatest cosine in its probes nearest lists, ties to the smaller id.

    queries: query (long) and v. Pieces of lists stand in groups of bounded size. A query meets a group once, with all its lists there: refine * k rows of it (with all lists probed: all that the error
    of bytes leaves open, so the answer is exact) are chosen by their bytes and ranked exactly in the same task, and k rows leave it. What is shuffled is the probed rows, and a row a query and group. others: a row isn't an answer to the query of its own id.
    """
    spark = queries.sparkSession
    figures = index_lists(spark, path).orderBy("list").toArrow()
    centres, pieces = unit_matrix(figures.column("centroid")), figures.column("pieces").to_numpy()
    every = probes >= len(centres)  # then a row's first copy is enough
    sizes = figures.column("firsts" if every else "n").to_numpy()
    first = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)
    load = np.repeat(np.divide(sizes, pieces, out=np.zeros(len(pieces)), where=pieces > 0), pieces)
    group = ((np.cumsum(load) - load) // max(PIECE_ROWS, GROUP_NUMBERS // max(1, centres.shape[1]))).astype(np.int32)  # of each piece, list by list
    sent = spark.sparkContext.broadcast((centres, pieces, first, group))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, pieces, first, group = sent.value
        for batch in batches:
            if every and len(batch):
                groups = np.unique(group)
                take = pa.array(np.repeat(np.arange(len(batch)), len(groups)))
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(take) + 1, np.int32)), pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("query").take(take), pa.array(np.tile(groups, len(batch))), none, batch.column("v").take(take)], names=["query", "group", "places", "asked"])
                continue
            step = max(1, (1 << 22) // len(centres))
            for at in range(0, len(batch), step):
                rows = batch.slice(at, step)
                m = unit_matrix(rows.column("v"))
                near = np.sort(np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes], axis=1)
                each, lists = np.repeat(np.arange(len(m)), near.shape[1]), near.ravel()
                n = pieces[lists]
                each, lists, piece = np.repeat(each, n), np.repeat(lists, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = first[lists] + piece
                # a query's pieces come in order, so those of a group stand together
                begins = np.flatnonzero(np.concatenate([[True], (each[1:] != each[:-1]) | (group[place[1:]] != group[place[:-1]])])[: len(each)])
                ends = pa.array(np.append(begins, len(each)).astype(np.int32))
                met = pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32)))
                take = pa.array(each[begins])
                yield pa.RecordBatch.from_arrays([rows.column("query").take(take), pa.array(group[place[begins]]), met, rows.column("v").take(take)], names=["query", "group", "places", "asked"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, first, group = sent.value
        for batch in batches:
            place = first[batch.column("list").to_numpy()] + batch.column("piece").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(group[place]), pa.array(place.astype(np.int32)), *(batch.column(c) for c in ("copy", "id", "scale", "code", "v"))], names=["group", "place", "copy", "id", "scale", "code", "v"])

    asked = queries.select(F.col("query").cast("long").alias("query"), "v").where("v IS NOT NULL AND size(v) > 0")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    probed = asked.mapInArrow(probe, f"query long, group int, places array<int>, asked {dict(queries.dtypes)['v']}")
    # where many queries ask, they come in blocks
    probed = probed.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    if every:
        rows = index_rows(spark, path).where("copy = 0")
    else:
        probed = stored(probed, "probes")
        places = [r[0] for r in probed.select(F.explode("places")).distinct().collect()]  # as many as pieces at most
        rows = index_rows(spark, path, sorted({int(x) for x in np.searchsorted(first, places, side="right") - 1}))
    rows = rows.select("list", "piece", "copy", "id", "scale", "code", "v")
    rows = rows.mapInArrow(grouped, f"group int, place int, copy int, id long, scale float, code binary, v {dict(rows.dtypes)['v']}").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keep = refine * k

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            left = left.sort_by([("place", "ascending"), ("id", "ascending")]).combine_chunks()
            ids, places = left.column("id").to_numpy(), left.column("place").to_numpy()
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), dtype=np.int8).reshape(len(ids), -1).astype(np.float32) * left.column("scale").to_numpy().astype(np.float32)[:, None]
            query, exact, v = right.column("query").to_numpy(), unit_matrix(right.column("asked")), left.column("v")
            unit = exact.astype(np.float32)
            def ranked(by: np.ndarray, of: np.ndarray) -> None:
                """Adds the k best of pairs of a query's and a row's place; all pairs of a query come at once, in order."""
                s = np.zeros(len(by))
                for x in range(0, len(by), 1 << 14):  # row by row: a pair's sum is the same whichever pairs stand beside it
                    s[x : x + (1 << 14)] = (exact[by[x : x + (1 << 14)]] * unit_matrix(v.take(pa.array(of[x : x + (1 << 14)])))).sum(axis=1)
                order = np.lexsort((ids[of], -s, by))
                by, id_, s = by[order], ids[of[order]], s[order]
                first = np.ones(len(by), bool)
                first[1:] = (by[1:] != by[:-1]) | (id_[1:] != id_[:-1])  # copies of a row have the same cosine
                by, id_, s = by[first], id_[first], s[first]
                mine = np.arange(len(by)) - np.searchsorted(by, by) < k
                found.append((query[by[mine]], id_[mine], s[mine]))

            if every:
                # a cosine by bytes is off by this at most, so no row below the k-th one by twice as much is among the k best
                off = np.nanmax(left.column("scale").to_numpy()) / 2 * np.abs(exact).sum(axis=1, keepdims=True) + 1e-5
                step = max(1, (1 << 23) // len(ids))
                for i in range(0, len(query), step):
                    s = unit[i : i + step] @ code.T
                    if others:
                        s[query[i : i + step, None] == ids] = -np.inf
                    least = -np.partition(-s, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1, None] - 2 * off[i : i + step]
                    by, of = np.nonzero((s >= least) & (s > -np.inf))
                    ranked(by + i, of)
            else:
                names, begins = np.unique(places, return_index=True)
                wants = right.column("places").combine_chunks()
                n = pc.list_value_length(wants).to_numpy()
                by, to = np.repeat(np.arange(len(query)), n), wants.flatten().to_numpy()
                order = np.argsort(to, kind="stable")
                by, to = by[order], to[order]
                wide = keep * (1 + int(left.column("copy").to_numpy().max()))  # copies of a row may take that many places
                best_s = np.full((len(query), wide), -np.inf, dtype=np.float32)
                best_i = np.full((len(query), wide), -1, dtype=np.int32)
                for x, y, i, j in zip(begins, np.append(begins[1:], len(ids)), np.searchsorted(to, names), np.searchsorted(to, names, side="right"), strict=True):
                    for i_ in range(i, j, 256):
                        at = by[i_ : min(j, i_ + 256)]
                        s = np.concatenate([best_s[at], unit[at] @ code[x:y].T], axis=1)
                        if others:
                            s[:, wide:][query[at][:, None] == ids[x:y]] = -np.inf
                        top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
                        of = np.where(top < wide, np.take_along_axis(best_i[at], np.minimum(top, wide - 1), axis=1), top - wide + x)
                        best_s[at], best_i[at] = np.take_along_axis(s, top, axis=1), of
                for i in range(0, len(query), 256):
                    known = np.isfinite(best_s[i : i + 256])
                    ranked(np.nonzero(known)[0] + i, best_i[i : i + 256][known])
        q, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query": q, "id": i, "similarity": s})

    keys = ["group", "block"]
    near = rows.groupBy(*keys).cogroup(probed.groupBy(*keys)).applyInArrow(score, "query long, id long, similarity double")
    if not every:
        near = near.groupBy("query", "id").agg(F.max("similarity").alias("similarity"))  # a row may stand in several probed lists
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
    return near.withColumn("place", best).where(F.col("place") <= k).select("query", "id", "similarity")
