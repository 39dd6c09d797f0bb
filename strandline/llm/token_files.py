"""Operator 2: token ids in ORC files.

Documents are range-partitioned by doc_id, encoded, and written as one ORC file a partition.
ORC run-length encodes the integers of its stripes (version 2: bit-packed to the widest id),
keeps a row index every ``row_index_stride`` rows and a Bloom filter of doc_id with each of
its entries. A scan reads stripes in parallel; a look-up of documents by id skips the files,
stripes and row groups whose statistics or Bloom filters exclude them.

Defined results: a null text is empty and gets only the end id; a null doc_id sorts first;
repeated doc_ids stay apart, ordered by a hash of the text and then by the text, and identical
rows are each written; an empty table gives an empty folder of files and no rows. Further columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import arrow_map, bounded_batches, doc_bytes, joined, scratch_path
from strandline.llm.word_cache import ColumnarWordCache

FILE_SCHEMA = "seq long, doc_id long, n_tokens long, ids array<int>"
_encoders: dict[str, ColumnarWordCache] = {}

#: Cuts lower-case words of Latin-1 characters, with spaces between, where the vocabulary's own pattern cuts them.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]| |[^ a-z0-9²³¹¼½¾ªµºß-öø-ÿ]+")
#: Words with other characters, or with control characters and odd spaces, or that hold a token of the
#: vocabulary's added ones, go to the library whole.
PLAIN = "^[!-~¡-ÿ]+$"
WORD_END = "</w>"
BLOCK = 8192
JOINED_BYTES = 6 << 20


class _Encoder:
    """Encodes distinct words with the tokenizers library.

    The vocabulary's rules never look across white space: it is dropped, and no match of the
    splitting pattern holds any. So a text's ids are its words' ids in order. Thousands of plain words go
    to the library as one text; each of their pieces ends with a token that carries the end-of-word
    mark, so counting pieces tells where a word's ids end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(size)])

    def encode_whole(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode_block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, and how many each has."""
        pieces = PIECES.findall(" ".join(words).lower())
        (e,) = self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)
        ids = np.array(e.ids, dtype=np.int32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        gaps = np.flatnonzero(np.fromiter(map(" ".__eq__, pieces), dtype=bool, count=len(pieces)))
        last = np.append(gaps - np.arange(len(gaps)), len(pieces) - len(gaps)) - 1  # each word's last piece
        if len(ends) == len(pieces) - len(gaps) and len(last) == len(words):
            return ids, np.diff(ends[last], prepend=0)
        whole = self.encode_whole(words)
        return np.concatenate(whole), np.array([len(w) for w in whole])

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(words, PLAIN)
        if self.added:
            plain = pc.and_not(plain, pc.match_substring_regex(words, self.added))
        easy, odd = words.filter(plain).to_pylist(), self.encode_whole(words.filter(pc.invert(plain)).to_pylist())
        blocks = [self.encode_block(easy[i : i + BLOCK]) for i in range(0, len(easy), BLOCK)]
        none = np.zeros(0, dtype=np.int32)
        flat = np.concatenate([none, *(b[0] for b in blocks), *odd])
        mask = plain.to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(words), dtype=np.int64)
        lengths[mask] = np.concatenate([none, *(b[1] for b in blocks)])
        lengths[~mask] = [len(x) for x in odd]
        starts = np.zeros(len(words), dtype=np.int64)
        order = np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)])
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return flat, starts, lengths


def _encoder(path: str) -> ColumnarWordCache:
    """One tokenizer and cache a worker process."""
    if path not in _encoders:
        _encoders[path] = ColumnarWordCache(_Encoder(path).encode_words)
    return _encoders[path]


def _with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> pa.ListArray:
    """Lists of ids with the end id behind each."""
    ends = np.cumsum(counts + 1)
    ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, dtype=np.int32)
    ids[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (end_id appended) in ascending doc_id order, partition by partition.

    seq is the row's place in its partition. The range partitioning samples keys only once, before
    any text is encoded; it deals out texts, which are smaller than their ids.
    """
    ordered = (
        doc_bytes(docs, F.xxhash64("text").alias("tie"))
        .withColumn("origin", F.spark_partition_id())  # deals out identical rows, which may stand in any order
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie", "origin")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "body")
    )
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in joined(batches, JOINED_BYTES):  # the more words at once, the fewer calls of the library
            flat, counts = _encoder(tokenizer_path).encode(batch.column("body"))
            seq = np.arange(count, count + len(counts), dtype=np.int64)
            count += len(counts)
            yield pa.RecordBatch.from_arrays([pa.array(seq), batch.column("doc_id"), pa.array(counts + 1), _with_end(flat, counts, end_id)], names=["seq", "doc_id", "n_tokens", "ids"])

    return ordered.select("doc_id", "body").mapInArrow(run, FILE_SCHEMA)


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, row_index_stride: int = 1000, stripe_mb: int = 16, bloom_fpp: float = 0.01, compression: str = "none"
) -> None:
    """Writes the ORC files; their numbers (part-00000, ...) ascend with doc_id."""
    (
        encode_documents(docs, tokenizer_path, end_id)
        .write.option("orc.compress", compression)
        .option("compression", compression)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; a filter on doc_id is pushed to row indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents, reading only row groups that may hold them."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 as read from the files.

    start is a two-level prefix sum: within each file over its own rows, then over the files,
    whose number is bounded by the write's partitions.
    """
    rows = lengths = read_token_files(spark, path).withColumn("file_no", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids")
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4")
        at = ids.offsets.to_numpy()
        view = memoryview(flat.tobytes())
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("file_no"), batch.column("seq"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, type=pa.int64())],
            names=["file_no", "seq", "doc_id", "n_tokens", "ids_crc32"],
        )

    rows = arrow_map(rows.select("file_no", "seq", "doc_id", "ids"), digest, "file_no long, seq long, doc_id long, n_tokens long, ids_crc32 long")
    files = lengths.groupBy("file_no").agg(F.sum("n_tokens").alias("in_file"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("file_start"))
    earlier = Window.partitionBy("file_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return rows.join(files, "file_no").select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes docs to a new folder of token files and digests what it holds."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return file_digest(spark, path)
