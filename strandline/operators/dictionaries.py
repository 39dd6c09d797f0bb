"""Dictionaries learned from a corpus: spelling by symmetric deletes, and terms that stand together."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import tokens
from strandline.functions.token_batches import batch_tokens, lowered, numbered, runs, slices
from strandline.session import spread, stored

#: Longer terms aren't words, and have no spelling: deletes grow with the square of a term's length.
LONGEST_WORD = 32
#: Text whose pairs a task counts at once, and ends of pairs a bucket (before they are counted): both bound a worker's memory.
CHUNK_BYTES, BUCKET_ENDS = 16 << 20, 16_000_000
PACKED = pa.schema([("bucket", pa.int32()), ("words", pa.string()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])


def _one_less(word: Column) -> Column:
    """All strings with one character less."""
    places = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def deletes(word: Column, distance: int = 2) -> Column:
    """The word and all strings with up to so many characters less, once each."""
    found = ring = F.array(word)
    for _ in range(distance):
        ring = F.array_distinct(F.flatten(F.transform(ring, _one_less)))
        found = F.array_union(found, ring)
    return found


def delete_index(terms: DataFrame, distance: int = 2) -> DataFrame:
    """key, term, df: each word under every string that deleting up to so many characters leaves. terms: term, df."""
    words = terms.where(F.length("term") <= LONGEST_WORD)
    return words.select("term", "df", F.explode(deletes(F.col("term"), distance)).alias("key")).select("key", "term", "df")


def corrections(words: DataFrame, index: DataFrame, distance: int = 2, limit: int = 3, terms: DataFrame | None = None) -> DataFrame:
    """word, term, distance, df, place: the nearest terms of each word (word), then the most frequent, then by spelling.

    Two words within so many edits have a string in common that both reach by so many deletes (symmetric deletes), so
    words meet terms by equal keys, and only those that meet are compared. A word that is a term itself has no corrections. terms: the index' terms, where they are at hand
    without their deletes.
    """
    asked = words.select("word").distinct().where(F.length("word") <= LONGEST_WORD)
    asked = asked.join((index if terms is None else terms).select(F.col("term").alias("word")).distinct(), "word", "left_anti")
    met = asked.select("word", F.explode(deletes(F.col("word"), distance)).alias("key")).join(index, "key").select("word", "term", "df").distinct()
    near = met.withColumn("distance", F.levenshtein("word", "term")).where(F.col("distance") <= distance)
    place = F.row_number().over(Window.partitionBy("word").orderBy("distance", F.col("df").desc(), "term"))
    return near.withColumn("place", place).where(F.col("place") <= limit).select("word", "term", "distance", "df", "place")


def corrections_of(words: DataFrame, terms: DataFrame, distance: int = 2, limit: int = 3) -> DataFrame:
    """corrections() without a stored index: deletes are made of the terms only whose length is within reach of a word's, as they are met."""
    asked = stored(words.select("word").distinct().where(F.length("word") <= LONGEST_WORD), "asked-words")
    lengths = [r[0] for r in asked.select(F.length("word")).distinct().collect()]  # LONGEST_WORD + 1 at most
    reach = sorted({n + d for n in lengths for d in range(-distance, distance + 1)})
    near = stored(terms.select("term", "df").where(F.length("term").isin(reach)), "near-terms")
    return corrections(asked, delete_index(spread(near), distance), distance, limit, near)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Tokens' numbers, their texts' numbers and the terms in order, for about CHUNK_BYTES of texts at once."""

    def coded(held: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        words, n = batch_tokens(pa.concat_arrays(held))
        codes, names = numbered(words)
        return codes, np.repeat(np.arange(len(n)), n), names

    held: list[pa.Array] = []
    for batch in batches:
        for rows in slices(batch, "body"):
            held.append(rows["body"])
            if sum(h.nbytes for h in held) >= CHUNK_BYTES:
                yield coded(held)
                held = []
    if held:
        yield coded(held)


def _met(codes: np.ndarray, text: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both ends of each pair of different tokens that stand so many places apart in a text, distance by distance."""
    for d in range(1, reach + 1):
        ok = (text[d:] == text[:-d]) & (codes[d:] != codes[:-d])
        yield codes[:-d][ok], codes[d:][ok]


def _ends(texts: DataFrame, reach: int) -> DataFrame:
    """a, n_a: how many pairs hold a term. A task sends a row a term and chunk."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, text, names in _chunks(batches):
            n = np.zeros(len(names), np.int64)
            for ends in _met(codes, text, reach):
                for end in ends:
                    n += np.bincount(end, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(n)], ["a", "n"])

    return texts.mapInArrow(counted, "a string, n long").groupBy("a").agg(F.sum("n").alias("n_a")).where("n_a > 0")


def _pair_counts(texts: DataFrame, reach: int, support: int, buckets: int) -> DataFrame:
    """x, y, n: pairs (x < y) that stand together at least support times.

    What is shuffled is a row a chunk and bucket of pairs: the terms there as one string, and numbers in it for both ends, and counts.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, text, names in _chunks(batches):
            size = max(1, len(names))
            pairs, n = runs(np.concatenate([np.minimum(a, b) * size + np.maximum(a, b) for a, b in _met(codes, text, reach)]))
            x, y = np.divmod(pairs, size)
            crc = np.array([zlib.crc32(t) for t in names.cast(pa.binary()).to_pylist()], np.int64)
            bucket = (crc[x] * 31 + crc[y]) % buckets
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(ends)):
                mine = order[ends[i] : ends[i + 1]]
                seen = np.zeros(size, bool)
                seen[x[mine]] = seen[y[mine]] = True
                local = np.cumsum(seen, dtype=np.int32) - 1
                words = " ".join(names.filter(pa.array(seen)).to_pylist())
                row = {"bucket": [int(i)], "words": [words]} | {k: pa.array([v.astype(np.int32)]) for k, v in (("x", local[x[mine]]), ("y", local[y[mine]]), ("n", n[mine]))}
                yield pa.RecordBatch.from_pydict(row, schema=PACKED)

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        words = pc.split_pattern(rows.column("words").chunk(0), " ")
        codes, names = numbered(words.flatten())
        x, y, n = (rows.column(c).chunk(0) for c in ("x", "y", "n"))
        first = np.repeat(words.offsets.to_numpy()[:-1], pc.list_value_length(n).to_numpy())
        keys = codes[first + x.flatten().to_numpy()] * len(names) + codes[first + y.flatten().to_numpy()]
        order = np.argsort(keys)
        keys = keys[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(n.flatten().to_numpy().astype(np.int64)[order], begins)
        kept = total >= support
        x, y = np.divmod(keys[begins][kept], len(names))
        return pa.table({"x": names.take(pa.array(x)), "y": names.take(pa.array(y)), "n": pa.array(total[kept])})

    rows = texts.mapInArrow(packed, "bucket int, words string, x array<int>, y array<int>, n array<int>")
    return rows.groupBy("bucket").applyInArrow(summed, "x string, y string, n long")


def associations(docs: DataFrame, text: str = "content", reach: int = 4, support: int = 5) -> DataFrame:
    """a, b, n, pmi in both directions: pairs of terms within so many tokens of each other at least support times.

    pmi is ln(n * N / (n_a * n_b)), where n_a counts the pairs that hold a and N all pairs, each pair with both its ends. A token
    makes reach pairs at most, so the work stays linear in tokens; pairs are counted before they are shuffled. Texts are read twice: for
    the terms' own counts, which also say how many buckets the pairs ask for, and for the pairs.
    """
    spark = docs.sparkSession
    texts = spread(docs.select(lowered(F.col(text)).alias("body")))
    alone = stored(_ends(texts, reach), "ends")
    total = alone.agg(F.coalesce(F.sum("n_a"), F.lit(0))).first()[0]  # one number
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ENDS))
    kept = _pair_counts(texts, reach, support, buckets)
    of = lambda end, n: alone.select(F.col("a").alias(end), F.col("n_a").alias(n))
    pmi = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_x").cast("double") * F.col("n_y")))
    rows = kept.join(of("x", "n_x"), "x").join(of("y", "n_y"), "y").select("x", "y", "n", pmi.alias("pmi"))
    both = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    return rows.select(both.alias("p"), "n", "pmi").select("p.a", "p.b", "n", "pmi")


def related_terms(pairs: DataFrame, least: float = 1.0, limit: int = 3) -> DataFrame:
    """term, related (an array, best first): the dictionary of a corpus, from associations()."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("pmi").desc(), F.col("n").desc(), "b"))
    best = pairs.where(F.col("pmi") >= least).withColumn("place", place).where(F.col("place") <= limit)
    ordered = F.array_sort(F.collect_list(F.struct("place", "b")))  # limit entries
    return best.groupBy(F.col("a").alias("term")).agg(F.transform(ordered, lambda x: x["b"]).alias("related"))


def expanded_by(queries: DataFrame, dictionary: DataFrame, keys: list[str], text: str = "text", most: int = 10) -> DataFrame:
    """keys, expansion: terms related to a query's terms that it doesn't hold, in order, up to most of them."""
    asked = queries.select(*keys, F.array_distinct(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))).alias("own"))
    met = asked.select(*keys, F.explode("own").alias("term")).join(dictionary, "term").groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("related")))).alias("more"))
    new = F.slice(F.array_except(F.coalesce("more", F.array().cast("array<string>")), "own"), 1, most)
    return asked.join(met, keys, "left").select(*keys, F.array_join(new, " ").alias("expansion"))
