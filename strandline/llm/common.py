"""What the operators of this package share: reading tables, words, batches, columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.session import discard, scratch_path, scratch_root, stored

__all__ = ["WORD", "arrow_map", "bounded_batches", "discard", "doc_bytes", "fresh", "joined", "read_table", "scratch_path", "scratch_root", "stored", "text_bytes", "word_count"]

#: A word is a run of anything but the six ASCII white-space characters. bytes.split()
#: without arguments cuts UTF-8 at exactly these, and no other UTF-8 byte takes their values.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch: bounds a Python worker's memory whatever the text lengths.
BATCH_ROWS = 2000
BATCH_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def word_count(column: str = "text") -> Column:
    """Number of words of a text (null: 0), in the JVM."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores in front as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def doc_bytes(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id and the text's bytes; whatever else docs holds is pruned from the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"), *extra)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, by two settings of the session: to the same values always, and never above what it has."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, of about so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow over bounded batches; fn turns one batch into another (None: nothing)."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
