"""Operator 12: importance resampling towards a target distribution.

A text's features are its runs of one to three terms, hashed into a fixed number of buckets. A bucket's
gain is the logarithm of its share in the target texts over its share in the corpus; a text's weight is the sum
of its features' gains. Gumbel noise of each document's own is added, and the highest scores are a sample without
replacement, drawn with probability in proportion to the exponential of the weight.

Identical texts are collapsed first, by grouping the full text: features and weights are computed once a text, counts
are multiplied by its multiplicity, and weights are joined back to the documents before the noise is added.
Counts leave a task as one row a bucket. What is sent to all tasks is one number a bucket.

Hashes of runs are joined from hashes of terms: CRC-32 is linear, so the hash of a run follows from that of
its left part, moved on by the length of its right part, and that of the right part; a batch's runs are a few look-ups
in arrays.

Defined results: a null text has no terms, so no features and weight 0, like an empty one; a null doc_id
takes the noise of an empty id and comes last among equal scores; repeated rows are documents of their own, with equal
scores and ranks one after the other; of an empty table there are no rows, and an empty target counts nothing. Further columns
are not read. A text goes to a task whole, with some 60 bytes a term.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import arrow_map, bounded_batches, discard, stored, text_bytes
from strandline.llm.terms import batch_terms, numbered

BUCKETS = 10_000
LONGEST_RUN = 3
ONES = 0xFFFFFFFF
#: Tables of moves by so many bytes are kept in a worker.
KEPT_MOVES = 64
_moves: dict[int, np.ndarray] = {}


def _move_table(length: int) -> np.ndarray:
    """For each byte of a CRC and its value: what it becomes as so many bytes follow."""
    if (known := _moves.get(length)) is not None:
        return known
    zeros = bytes(length)
    bits = [zlib.crc32(zeros, (1 << i) ^ ONES) ^ ONES for i in range(32)]
    table = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            table[byte, 1 << bit : 2 << bit] = table[byte, : 1 << bit] ^ np.uint32(bits[8 * byte + bit])
    if length <= KEPT_MOVES:
        _moves[length] = table
    return table


def run_hashes(words: np.ndarray, terms: list[bytes], doc: np.ndarray, longest: int = LONGEST_RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: CRC-32 of the runs of so many terms joined by spaces, and their texts' numbers. words: numbers of terms."""
    alone = np.array([zlib.crc32(t) for t in terms], dtype=np.uint32)
    spaced = np.array([zlib.crc32(b" " + t) for t in terms], dtype=np.uint32)
    lengths, which = np.unique(np.array([len(t) + 1 for t in terms], dtype=np.int64), return_inverse=True)
    moves = np.stack([_move_table(int(n)) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), dtype=np.uint32)
    run = alone[words]
    yield run, doc
    for n in range(2, longest + 1):
        run, last, by = run[:-1], words[n - 1 :], which[words[n - 1 :]]
        run = moves[by, 0, run & 255] ^ moves[by, 1, (run >> 8) & 255] ^ moves[by, 2, (run >> 16) & 255] ^ moves[by, 3, run >> 24] ^ spaced[last]
        whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
        yield run[whole], doc[: len(doc) - n + 1][whole]


def batch_buckets(bodies: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, their texts' numbers, and how many terms each text has."""
    terms, counts = batch_terms(bodies)
    words, distinct = numbered(terms)
    doc = np.repeat(np.arange(len(counts)), counts)
    found = list(run_hashes(words, distinct, doc))
    return np.concatenate([h % np.uint32(buckets) for h, _ in found]).astype(np.int64), np.concatenate([d for _, d in found]), counts


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and count of features. texts: body and n, its multiplicity."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                bucket, doc, _ = batch_buckets(batch.column("body"), buckets)
                total += np.bincount(bucket, weights=batch.column("n").to_numpy()[doc].astype(np.float64), minlength=buckets).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "count"])

    return texts.select("body", "n").mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(target: DataFrame, corpus: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, on the driver: so many numbers, whatever the corpus. target, corpus: bucket, count."""
    spark = corpus.sparkSession
    both = corpus.withColumnRenamed("count", "s").join(target.withColumnRenamed("count", "t"), "bucket", "full")
    every = spark.range(buckets).join(both, F.col("id") == F.col("bucket"), "left").select("id", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    all_s, all_t = (F.sum(c).over(Window.partitionBy()) for c in ("s", "t"))  # one row a bucket
    gain = F.floor(1000 * F.log((F.col("t") + 1) * (all_s + buckets) / ((F.col("s") + 1) * (all_t + buckets))))
    return np.array([r[0] for r in every.withColumn("gain", gain.cast("long")).orderBy("id").select("gain").collect()], dtype=np.int64)


def text_weights(texts: DataFrame, gains: np.ndarray) -> DataFrame:
    """key, n_words, n_features and weight of every text. texts: key, body."""
    sent = texts.sparkSession.sparkContext.broadcast(gains)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, doc, counts = batch_buckets(batch.column("body"), len(sent.value))
        weight = np.bincount(doc, weights=sent.value[bucket].astype(np.float64), minlength=len(counts)).astype(np.int64)
        features = np.bincount(doc, minlength=len(counts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts.astype(np.int64)), pa.array(features), pa.array(weight)], names=["key", "n_words", "n_features", "weight"])

    return arrow_map(texts.select("key", "body"), run, "key binary, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """The noise of a document, in thousandths, as a long: it depends on its id and the seed alone."""
    digits = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(digits, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, by: list[Column], name: str) -> DataFrame:
    """rows in a stored table with their rank (from 1) in an order. rows: a stored table.

    Ranks are places in range partitions plus the sizes of those before; equal rows are dealt by their place in the table.
    """
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(*by, F.col("place")).sortWithinPartitions(*by, F.col("place"))
    held = stored(ordered.drop("place").withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # a row a partition
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + F.col("seq") + 1).drop("part", "seq", "before")


def importance_resampling(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    body = text_bytes()
    texts = docs.groupBy(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    # the texts' SHA-256 stands for them when weights are joined back
    texts = stored(texts.select(F.unhex(F.sha2("text", 256)).alias("key"), F.col("text").cast("binary").alias("body"), "n"), "distinct-texts")
    wanted = target.select(body.alias("body"), F.lit(1).cast("long").alias("n"))
    gains = bucket_gains(bucket_counts(wanted, buckets), bucket_counts(texts, buckets), buckets)
    weights = stored(text_weights(texts, gains), "text-weights")
    discard(texts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("key"))
    scored = rows.join(weights, "key").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"))
    scored = stored(scored, "scores")
    discard(weights)
    able = scored.where(F.col("n_words") >= min_words)
    draws = able.count() * share[0] // share[1]
    names = ["doc_id", "n_features", "weight", "score"]
    places = ranked(able.select(*names), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "ranks")
    drawn = places.select(*names, F.when(F.col("rank") <= draws, F.col("rank")).cast("long").alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < min_words).select(*names, F.lit(None).cast("long").alias("rank")))


#: A CRC is the XOR of what each byte leaves after the bytes behind it: far(k, b) is byte b with k bytes behind it.
ORACLE_SQL = r"""
WITH RECURSIVE bits(b, i, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL
  SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE i < 8),
t AS (SELECT b, v FROM bits WHERE i = 8),
d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT u, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS f FROM d),
ef AS (SELECT unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS f FROM e),
known AS (SELECT f, hex(f) AS h, strlen(f) AS n FROM (SELECT f FROM df UNION SELECT f FROM ef)),
far(k, b, v) AS (SELECT 0, b, v FROM t UNION ALL SELECT k + 1, far.b, xor(far.v >> 8, t.v) FROM far JOIN t ON t.b = far.v & 255 WHERE k < (SELECT max(n) FROM known)),
none(n, v) AS (SELECT 0, 4294967295 UNION ALL SELECT n + 1, xor(none.v >> 8, t.v) FROM none JOIN t ON t.b = none.v & 255 WHERE n < (SELECT max(n) FROM known)),
bytes AS (SELECT f, n, unnest(range(1, n + 1)) AS i, h FROM known),
crc AS (SELECT f, bit_xor(far.v) AS v, any_value(bytes.n) AS n FROM bytes JOIN far ON far.k = bytes.n - i AND far.b = CAST('0x' || substr(h, CAST(2 * i - 1 AS INTEGER), 2) AS BIGINT) GROUP BY f),
bucket AS (SELECT f, xor(xor(crc.v, none.v), 4294967295) % 10000 AS k FROM crc JOIN none ON none.n = crc.n),
s AS (SELECT k, count(*) AS s FROM df JOIN bucket USING (f) GROUP BY k),
x AS (SELECT k, count(*) AS t FROM ef JOIN bucket USING (f) GROUP BY k),
gain AS (SELECT k, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM x) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN x USING (k)),
weights AS (SELECT u, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM df JOIN bucket USING (f) JOIN gain USING (k) GROUP BY u),
r AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (u)),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT count(*) FROM r WHERE able) * 5 // 100 THEN place END AS rank FROM o
"""
