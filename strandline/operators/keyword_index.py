"""A stored keyword index in segments: a search reads the lists of its own terms, and of these the blocks it needs.

A segment holds the postings of some documents: a row for each term and zone, a zone being some 256 documents of like length.
The row's head says how often its term stands in a document at most and how long the shortest one is, which bounds the zone's scores whatever the
corpus becomes. A segment is never changed. What replaces or deletes a document is a later segment with a list of dead (segment, id) and with
document frequencies that may be negative: those of all segments add up to the corpus' own. merge() writes what lives as one segment.

A version is a manifest: which segments count, and the corpus' figures. It comes last, so readers change from one whole version to the next.
Writers claim a version by creating a file, which only one of them can.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import query_tokens
from strandline.functions.token_batches import batch_tokens, lowered, numbered, runs, slices
from strandline.operators.search import K1, B
from strandline.session import spread, stored

BUCKETS, ZONE = 64, 256
#: Changes with the columns below: an index of another format isn't read.
FORMAT = 2
#: A zone of long documents holds fewer of them: a task inverts one zone at a time.
ZONE_TOKENS = 500_000
#: Postings that a task sorts and writes.
TASK_POSTINGS = 1_000_000
#: Zones that a search for the best rows looks into for its first threshold.
FIRST_ZONES = 8
BLOCKS = "term string, zone int, n int, max_tf int, min_dl int, ids array<{id}>, tfs array<int>, dls array<int>"
POSTINGS = BLOCKS + ", segment int, bucket int"
#: A document's distinct terms in order, with spaces between, and how often each stands there.
FORWARD = "id {id}, dl int, words string, tf array<int>, segment int"
TERMS = "term string, df long, segment int, bucket int"
DEAD = "in_segment int, id {id}, segment int"
FIGURES = "n_docs long, n_tokens long, avg_doc_len double, n_terms long, id_type string, stamp string, segments array<int>, term_segments array<int>, dead_segments array<int>"
#: Lists of a query that hold no more postings than this in all are read whole: that is cheaper than finding out which blocks may be left out.
FEW_POSTINGS = 1_000_000


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of what is stored below a path, in order."""
    folder, fs = _fs(spark, path)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(_fs(spark, f"{path}/{n}/figures/_SUCCESS")[0]))


def claimed_version(spark: SparkSession, path: str) -> int:
    """A version number that no other writer has or gets."""
    folder, fs = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    n = max((int(x[1:].partition(".")[0]) for x in names if x[0] == "v" and x[1:].partition(".")[0].isdigit()), default=0) + 1
    while not fs.createNewFile(_fs(spark, f"{path}/v{n}.claim")[0]):
        n += 1
    return n


def figures(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """n_docs, n_tokens, avg_doc_len, n_terms and what a version consists of: one row."""
    return spark.read.schema(FIGURES).parquet(f"{path}/v{version or versions(spark, path)[-1]}/figures")


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def _read(spark: SparkSession, path: str, what: str, segments: list[int], schema: str, buckets: list[int] | None = None) -> DataFrame:
    """Some segments of a table; with buckets only the folders of these are listed."""
    at = [f"{path}/{what}/segment={n}" for n in segments]
    if buckets is not None:
        at = [f for x in at for b in buckets if (folder := _fs(spark, f"{x}/bucket={b}"))[1].exists(folder[0]) for f in [f"{x}/bucket={b}"]]
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{what}").parquet(*at)


class Version:
    """The tables of one version. Each is listed when it is first asked for."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self.row = figures(spark, path, version).first()
        self.kind = self.row["id_type"]

    def _whole(self, what: str, buckets: list[int] | None = None) -> DataFrame:
        column, schema = {"postings": ("segments", POSTINGS), "forward": ("segments", FORWARD), "terms": ("term_segments", TERMS), "dead": ("dead_segments", DEAD)}[what]
        return _read(self.spark, self.path, what, self.row[column], schema.format(id=self.kind), buckets)

    @cached_property
    def postings(self) -> DataFrame:
        return self._whole("postings")

    @cached_property
    def forward(self) -> DataFrame:
        return self._whole("forward")

    @cached_property
    def terms(self) -> DataFrame:
        return self._whole("terms")

    @cached_property
    def dead(self) -> DataFrame:
        return self._whole("dead").select(F.col("in_segment").alias("segment"), "id")

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (segment, id, ...) without dead ones."""
        return rows.join(self.dead, ["segment", "id"], "left_anti") if self.row["dead_segments"] else rows

    def of_terms(self, what: str, terms: list[str]) -> DataFrame:
        """Rows of some terms in postings or terms: only their buckets are listed, and of these only some row groups read."""
        mine = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        return self._whole(what, mine).where(F.col("bucket").isin(mine) & F.col("term").isin(terms))


def _counted(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, dl, words, tf of every row: one pass over the texts, no shuffle. Ids are unique, as everywhere in the index."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in slices(whole, "body"):
                words, n = batch_tokens(rows["body"])
                codes, names = numbered(words)
                keys, tf = runs(np.repeat(np.arange(len(rows)), n) * max(1, len(names)) + codes)
                doc, term = np.divmod(keys, max(1, len(names)))
                begins = pa.array(np.searchsorted(doc, np.arange(len(rows) + 1)).astype(np.int32))
                terms = pc.binary_join(pa.ListArray.from_arrays(begins, names.take(pa.array(term))), " ")
                counts = pa.ListArray.from_arrays(begins, pa.array(tf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows["id"], pa.array(n.astype(np.int32)), terms, counts], ["id", "dl", "words", "tf"])

    texts = spread(docs.select(F.col(id_).alias("id"), lowered(F.col(text)).alias("body")))
    return texts.mapInArrow(counted, f"id {dict(texts.dtypes)['id']}, dl int, words string, tf array<int>")


def distinct_terms(rows: DataFrame, id_: str, text: str, terms: str) -> DataFrame:
    """id and the distinct terms of every row that has a term, in order."""
    return _counted(rows, id_, text).where("words <> ''").select(F.col("id").alias(id_), F.split("words", " ").alias(terms))


def _write_forward(rows: DataFrame, path: str, number: int) -> DataFrame:
    """A segment's forward rows, written and read back. They count once a version names the segment."""
    rows.sortWithinPartitions("id").write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{path}/forward/segment={number}")
    return _read(rows.sparkSession, path, "forward", [number], FORWARD.format(id=dict(rows.dtypes)["id"])).select("id", "dl", "words", "tf")


def _write_postings(forward: DataFrame, path: str, number: int) -> None:
    """A segment's postings. forward: a written table of id, dl, words, tf.

    Blocks belong to a zone, so whole documents are dealt to their zones and inverted there. What is shuffled is packed: a row a
    document, then a row for each zone and bucket, whose terms are one string and whose numbers stand in arrays.
    """

    def lists(of: pa.Array, begins: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), of)

    def inverted(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        id_, dl, words, tf = (rows.column(c).chunk(0) for c in ("id", "dl", "words", "tf"))
        place = np.repeat(np.arange(len(rows)), pc.list_value_length(tf).to_numpy(zero_copy_only=False))
        coded = pc.split_pattern(words, " ").flatten().dictionary_encode()
        bucket = np.array([zlib.crc32(t) % BUCKETS for t in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
        by = np.argsort(bucket, kind="stable")
        new = np.empty(len(by), np.int64)
        new[by] = np.arange(len(by))
        codes = new[coded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(codes, kind="stable")
        n = np.bincount(codes, minlength=len(by)).astype(np.int32)
        place = place[order]
        at = np.searchsorted(bucket[by], np.arange(BUCKETS + 1))  # where a bucket's terms begin, and where their entries do
        entries = np.concatenate([[0], np.cumsum(n)])[at]
        out = {
            "bucket": pa.array(np.arange(BUCKETS, dtype=np.int32)),
            "zone": pa.array(np.full(BUCKETS, rows.column("zone")[0].as_py(), np.int32)),
            "words": pc.binary_join(lists(coded.dictionary.take(pa.array(by)), at), " "),
            "n": lists(pa.array(n), at),
            "id": lists(id_.take(pa.array(place)), entries),
            "tf": lists(tf.flatten().take(pa.array(order)), entries),
            "dl": lists(dl.take(pa.array(place)), entries),
        }
        return pa.table(out).filter(pa.array(at[1:] > at[:-1]))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 64):
                rows = whole.slice(first, 64)
                n = rows["n"].flatten().to_numpy(zero_copy_only=False)
                begins = np.concatenate([[0], np.cumsum(n)])
                terms = pc.list_value_length(rows["n"]).to_numpy(zero_copy_only=False)
                id_, tf, dl = (rows[c].flatten() for c in ("id", "tf", "dl"))
                out = {
                    "term": pc.split_pattern(rows["words"], " ").flatten(),
                    "zone": pa.array(np.repeat(rows["zone"].to_numpy(zero_copy_only=False), terms)),
                    "n": pa.array(n),
                    "max_tf": pa.array(np.maximum.reduceat(tf.to_numpy(zero_copy_only=False), begins[:-1])),
                    "min_dl": pa.array(np.minimum.reduceat(dl.to_numpy(zero_copy_only=False), begins[:-1])),
                    "ids": lists(id_, begins),
                    "tfs": lists(tf, begins),
                    "dls": lists(dl, begins),
                    "bucket": pa.array(np.repeat(rows["bucket"].to_numpy(zero_copy_only=False), terms)),
                }
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    spark, kind = forward.sparkSession, dict(forward.dtypes)["id"]
    length = F.floor(F.log2(F.col("dl") + 1.0) * 4).cast("int")
    sizes = forward.groupBy(length.alias("k")).agg(F.count(F.lit(1)), F.sum("dl"), F.sum(F.size("tf"))).collect()  # four classes a doubling of length
    first, zones = 0, {}
    for k, n, dl, _ in sorted(sizes):
        zones[k] = (first, max(1, -(-n // ZONE), -(-dl // ZONE_TOKENS)))
        first += zones[k][1]
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in zones.items() for x in (k, v[i])])[length]
    zone = (pick(0) + F.pmod(F.xxhash64("id"), pick(1))).cast("int") if zones else F.lit(0)
    dealt = forward.where("words <> ''").select(zone.alias("zone"), "id", "dl", "words", "tf")
    packed = dealt.groupBy("zone").applyInArrow(inverted, f"bucket int, zone int, words string, n array<int>, id array<{kind}>, tf array<int>, dl array<int>")
    # zones give each bucket about as much, so a bucket that is large is cut by its zones
    parts = -(-sum(r[3] for r in sizes) // TASK_POSTINGS)
    packed = packed.repartition(max(parts, min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))), "bucket", F.col("zone") % max(1, -(-parts // BUCKETS)))
    blocks = packed.mapInArrow(unpacked, BLOCKS.format(id=kind) + ", bucket int").sortWithinPartitions("bucket", "term", "zone")
    blocks.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings/segment={number}")


def _frequencies(spark: SparkSession, path: str, number: int, kind: str) -> DataFrame:
    """term and df of a segment, a row a term and zone: the blocks' heads, no entries and no documents."""
    return _read(spark, path, "postings", [number], POSTINGS.format(id=kind)).select("term", F.col("n").alias("df"))


def _write_terms(counts: DataFrame, path: str, number: int) -> None:
    """counts: term, df (may be negative)."""
    rows = counts.groupBy("term").agg(F.sum("df").cast("long").alias("df")).where("df <> 0").withColumn("bucket", bucket_of(F.col("term")))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms/segment={number}")


def _publish(spark: SparkSession, path: str, number: int, kind: str, parts: dict, docs: int, n_tokens: int, stamp: str) -> int:
    terms = _read(spark, path, "terms", parts["term_segments"], TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").count()
    row = (docs, n_tokens, n_tokens / docs if docs else None, terms, kind, stamp, parts["segments"], parts["term_segments"], parts["dead_segments"])
    spark.createDataFrame([row], FIGURES).coalesce(1).write.mode("overwrite").parquet(f"{path}/v{number}/figures")
    return number


def _totals(forward: DataFrame) -> tuple[int, int]:
    row = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def write_index(docs: DataFrame, path: str, id_: str = "id", text: str = "content", stamp: str = "") -> int:
    """Writes a version that holds these documents alone, as one segment, and returns its number."""
    spark, number = docs.sparkSession, claimed_version(docs.sparkSession, path)
    forward = _write_forward(_counted(docs, id_, text), path, number)
    _write_postings(forward, path, number)
    _write_terms(_frequencies(spark, path, number, dict(forward.dtypes)["id"]), path, number)
    return _publish(spark, path, number, dict(forward.dtypes)["id"], {"segments": [number], "term_segments": [number], "dead_segments": []}, *_totals(forward), stamp)


def change_index(spark: SparkSession, path: str, docs: DataFrame | None = None, deleted: DataFrame | None = None, id_: str = "id", text: str = "content") -> int:
    """The next version: docs replace those of their ids or are new, deleted (id) go. No older segment is written again."""
    number, now = claimed_version(spark, path), Version(spark, path)
    kind, parts = now.row["id_type"], {k: list(now.row[k]) for k in ("segments", "term_segments", "dead_segments")}
    new = _write_forward(_counted(docs, id_, text), path, number) if docs is not None else None
    gone = deleted.select(F.col(id_).cast(kind).alias("id")) if deleted is not None else spark.createDataFrame([], f"id {kind}")
    gone = gone.union(new.select("id")) if new is not None else gone
    dead = stored(now.live(now.forward.join(gone.distinct(), "id", "left_semi")), "dead")
    counts = dead.where("words <> ''").select(F.explode(F.split("words", " ")).alias("term"), F.lit(-1).alias("df"))
    n_docs, n_tokens = now.row["n_docs"], now.row["n_tokens"]
    lost = _totals(dead)
    if lost[0]:
        dead.select(F.col("segment").alias("in_segment"), "id").write.mode("overwrite").parquet(f"{path}/dead/segment={number}")
        parts["dead_segments"].append(number)
    if new is not None and (added := _totals(new))[0]:
        _write_postings(new, path, number)
        parts["segments"].append(number)
        counts = counts.union(_frequencies(spark, path, number, kind))
        n_docs, n_tokens = n_docs + added[0], n_tokens + added[1]
    _write_terms(counts, path, number)
    parts["term_segments"].append(number)
    return _publish(spark, path, number, kind, parts, n_docs - lost[0], n_tokens - lost[1], "")


def merge(spark: SparkSession, path: str) -> int:
    """The next version: all living documents in one segment, from the forward rows; no text is read."""
    number, now = claimed_version(spark, path), Version(spark, path)
    forward = _write_forward(now.live(now.forward).select("id", "dl", "words", "tf"), path, number)
    _write_postings(forward, path, number)
    _write_terms(_frequencies(spark, path, number, now.row["id_type"]), path, number)
    return _publish(spark, path, number, now.row["id_type"], {"segments": [number], "term_segments": [number], "dead_segments": []}, *_totals(forward), now.row["stamp"])


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all versions but the newest, and segments that none of these name."""
    every = versions(spark, path)
    rows = [figures(spark, path, v).first() for v in every[-keep:]]
    for v in every[:-keep]:
        at, fs = _fs(spark, f"{path}/v{v}")
        fs.delete(at, True)
    for what, column in (("postings", "segments"), ("forward", "segments"), ("terms", "term_segments"), ("dead", "dead_segments")):
        folder, fs = _fs(spark, f"{path}/{what}")
        used = {f"segment={n}" for r in rows for n in r[column]}
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            n = f.getPath().getName().partition("=")[2]
            if f.getPath().getName() not in used and n.isdigit() and int(n) <= every[-1]:  # later ones are being written
                fs.delete(f.getPath(), True)


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def document_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """term, df and idf of every term, from the stored counts."""
    now = Version(spark, path)
    df = now.terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return df.select("term", "df", _idf(F.lit(now.row["n_docs"]), F.col("df")).alias("idf"))


class Query:
    """A query's weights in a version: they depend on its own terms alone."""

    def __init__(self, spark: SparkSession, path: str, query: str, k1: float, b: float):
        self.version, self.k1, self.b = Version(spark, path), k1, b
        often = Counter(query_tokens(query))
        rows = self.version.of_terms("terms", sorted(often)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0") if often else None
        rows = rows.select("term", _idf(F.lit(self.version.row["n_docs"]), F.col("df")), "df").collect() if often else []  # a row a term of the query
        self.idf = {r[0]: often[r[0]] * r[1] for r in sorted(rows, key=lambda r: list(often).index(r[0]))}
        self.df = {r[0]: r[2] for r in rows}
        self.blocks = self.version.of_terms("postings", sorted(self.idf) or [""])

    def part(self, tf: Column, dl: Column) -> Column:
        weight = F.create_map(*[F.lit(x) for kv in sorted(self.idf.items()) for x in kv])[F.col("term")] if self.idf else F.lit(0.0)
        return weight * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / F.lit(self.version.row["avg_doc_len"] or 1.0)))

    def plus(self, delta: float | None) -> float:
        return sum(self.idf.values()) * delta if delta else 0.0

    def scores(self, blocks: DataFrame) -> DataFrame:
        """id and bm25. A row's parts are added in the order of the query's terms, so rows of equal texts have equal scores to the last bit."""
        rows = blocks.select("segment", "term", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))).alias("e")).select("segment", "term", "e.id", "e.tf", "e.dl")
        part = self.part(F.col("tf"), F.col("dl"))
        each = [F.coalesce(F.sum(F.when(F.col("term") == t, part)), F.lit(0.0)) for t in self.idf]  # one part a row and term
        return self.version.live(rows).groupBy("id").agg(sum(each[1:], each[0]).alias("bm25") if each else F.lit(0.0).alias("bm25"))

    def zones(self) -> DataFrame:
        """segment, zone and bound: no document of the zone scores more. Heads of blocks are read, no entries."""
        return self.blocks.groupBy("segment", "zone").agg(F.sum(self.part(F.col("max_tf"), F.col("min_dl"))).alias("bound"))


def index_scores(spark: SparkSession, path: str, query: str, k1: float = K1, b: float = B, ids: DataFrame | None = None, delta: float | None = None) -> DataFrame:
    """id and bm25 of the rows that hold a term of the query, or of all ids (0 for the others).

    A term that the query repeats counts as often. With delta every query term that the corpus holds adds idf * delta
    to every id.
    """
    q = Query(spark, path, query, k1, b)
    found = q.scores(q.blocks)
    if ids is not None:
        found = ids.join(found, "id", "left").select("id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
    return found.withColumn("bm25", F.col("bm25") + q.plus(delta)) if delta is not None else found


def needed_blocks(q: Query, k: int, plus: float = 0.0) -> DataFrame:
    """The blocks of zones that may hold one of the k best rows: those whose bound reaches the k-th score of the most promising zones.

    plus: what is added to all scores; those that are equal after that count as equal.
    """
    zones = stored(q.zones(), "zones")
    in_zones = lambda z: q.blocks.join(z.select("segment", "zone"), ["segment", "zone"], "left_semi")
    first = q.scores(in_zones(zones.orderBy(F.col("bound").desc(), "segment", "zone").limit(FIRST_ZONES)))
    best = [r[0] for r in first.select("bm25").orderBy(F.col("bm25").desc()).limit(k).collect()]
    least = best[-1] - 1e-12 * (best[-1] + plus) if len(best) == k else 0.0  # sums may differ in their last bits
    return in_zones(zones.where(F.col("bound") >= least))


def index_top(spark: SparkSession, path: str, query: str, k: int, k1: float = K1, b: float = B, delta: float | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The k best rows by bm25, ties to the smaller id; ids (id) fill up with rows without a term of the query, if fewer match.

    Of long lists, zones that can't reach the k-th place are left out before their entries are read. What delta adds is added before rows are
    ranked: a sum has fewer digits left for the difference of two rows, and equal sums go by id.
    """
    q = Query(spark, path, query, k1, b)
    plus = q.plus(delta)
    blocks = q.blocks if sum(q.df.values()) <= FEW_POSTINGS else needed_blocks(q, k, plus)
    found = q.scores(blocks).withColumn("bm25", F.col("bm25") + plus).orderBy(F.col("bm25").desc(), "id").limit(k)
    if ids is not None and max(q.df.values(), default=0) < k:  # else one term alone has k rows
        found = stored(found, "best")
        if (n := found.count()) < k:
            found = found.union(ids.join(found, "id", "left_anti").orderBy("id").limit(k - n).select("id", F.lit(plus)))
    return found.orderBy(F.col("bm25").desc(), "id")
