"""Operator 7: a quality classifier of histogram gradient-boosted trees over document statistics.

Statistics of a text's bytes, words and lines are computed on the executors. The trees are fitted on
the driver over at most ``sample_rows`` labelled documents (a documented bound; labels are chosen by a
hash of their doc_id), flattened into arrays and sent to the executors, where numpy steps whole
batches down all trees at once. Labels, language, source and doc_id are no inputs of a score.

Defined results: a null text is empty and gets a score like any other; labels that are null,
repeated or in conflict are left out, repeated or averaged by the loss; without usable labels
every score is 0.5; repeated rows get equal scores; an empty table gives no rows; further
columns are not read, and with_scores() carries them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.llm.common import arrow_map, doc_bytes, fresh, text_bytes
from strandline.llm.gbdt import Trees, train

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7

STATISTICS = (
    "log_words", "word_length", "distinct_words", "common_word", "short_words", "long_words", "bare_words", "ended_words",
    "small", "capitals", "digits", "high_bytes", "symbols", "bangs", "stops", "pipes", "at_slash", "spaces", "entropy",
    "log_lines", "line_words", "repeated_lines", "repeated_pairs", "deflated",
)
_CLASSES = {
    "small": bytes(range(97, 123)), "capitals": bytes(range(65, 91)), "digits": b"0123456789", "high_bytes": bytes(range(128, 256)),
    "symbols": b"#*$%&<>", "bangs": b"!", "stops": b".,;:?", "pipes": b"|", "at_slash": b"@/", "spaces": b" \t\n\x0b\x0c\r",
}
_MASK = np.array([[b in v for b in range(256)] for v in _CLASSES.values()], dtype=np.float64)
_BARE = b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Deflation looks at texts in pieces of this size, so that a statistic of a long text is a mean.
PIECE = 1 << 15


def statistics(body: bytes) -> list[float]:
    """The inputs of a score, in the order of STATISTICS; whole texts, whatever their length."""
    words = body.split()
    n, size = len(words), max(len(body), 1)
    counts = np.bincount(np.frombuffer(body, dtype=np.uint8), minlength=256).astype(np.float64)
    shares = _MASK @ counts / size
    p = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in body.split(b"\n") if x.strip()]
    packed = sum(len(zlib.compress(body[i : i + PIECE], 1)) for i in range(0, len(body), PIECE))
    per = max(n, 1)
    return [
        float(np.log1p(n)),
        lengths.sum() / per,
        len(seen) / per**0.8,
        max(seen.values(), default=0) / per,
        float((lengths <= 2).sum()) / per,
        float((lengths > 14).sum()) / per,
        sum(c for w, c in seen.items() if not w.strip(_BARE)) / per,
        sum(c for w, c in seen.items() if w[-1] in _BARE) / per,
        *shares.tolist(),
        float(-(p * np.log2(p)).sum()),
        float(np.log1p(len(lines))),
        n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        1 - pairs / max(n - 1, 1),
        packed / size,
    ]


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id's digits is 2 modulo 4."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """doc_id and y of at most sample_rows usable labels that aren't held out."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("double").alias("y"))
    share = min(1.0, sample_rows / max(1, usable.count()))
    chosen = usable.where((F.xxhash64("label_id") / 2.0**64 + 0.5) <= share)
    return chosen.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(sample_rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees for a label from a bounded sample of labelled documents."""
    chosen = labelled_sample(labels, label, sample_rows)
    rows = doc_bytes(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # at most sample_rows rows

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = [statistics(b) for b in batch.column("body").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(stats, type=pa.list_(pa.float64()))], names=["doc_id", "y", "stats"])

    measured = arrow_map(rows.select("doc_id", "y", "body"), measure, "doc_id long, y double, stats array<double>")
    # a doc_id may stand for many rows, so the bound holds again
    got = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "stats").limit(sample_rows).collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["stats"]))
    x = np.array([r["stats"] for r in got], dtype=np.float64).reshape(-1, len(STATISTICS))
    return train(x, np.array([r["y"] for r in got], dtype=np.float64))


def scores(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(b) for b in batch.column("body").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(x))], names=["doc_id", "score"])

    return arrow_map(doc_bytes(docs), run, "doc_id long, score double")


def with_scores(docs: DataFrame, model: Trees, name: str) -> DataFrame:
    """docs with all their columns and a score under a name that they don't have, without a join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    body = fresh(docs, "body")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(b) for b in batch.column(body).to_pylist()])
        kept = [i for i, c in enumerate(batch.schema.names) if c != body]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sent.value.score(x))], names=[*(batch.schema.names[i] for i in kept), name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return arrow_map(docs.withColumn(body, text_bytes()), run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    got = scores(docs, fit(docs, labels, "quality", sample_rows))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
