"""Tokens of whole Arrow batches: what functions.text.tokens finds in each text, found byte by byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once, whatever a batch holds.
SLICE_BYTES = 8 << 20
_INSIDE = np.array([chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" for b in range(256)])


def lowered(text: Column) -> Column:
    """The text in lower case as bytes, null as none: Spark's own lower case, as tokens() takes it."""
    return F.coalesce(F.lower(text).cast("binary"), F.lit(b""))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of about SLICE_BYTES of a column; a longer text is one by itself."""
    ends = np.cumsum(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(batch):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


def batch_tokens(bodies: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts (lower case, UTF-8, no nulls), one behind the other, and how many each text has.

    A byte of a character beyond ASCII is never below 128, so tokens are cut byte by byte.
    """
    _, offsets, data = bodies.buffers()
    ends = np.frombuffer(offsets, np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = _INSIDE[body]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = ends[:-1][ends[:-1] < len(body)], ends[1:][ends[1:] > 0] - 1
    opens[first], closes[last] = inside[first], inside[last]  # a text's ends are ends of tokens, whatever stands beside them
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = stops - starts > 1
    inside[starts[~long]] = False
    starts, lengths = starts[long], (stops - starts)[long]
    cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(body[inside])), np.diff(np.searchsorted(starts, ends))


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each token's place among the distinct tokens, in order, and those."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(order)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each stands there; keys are sorted in place."""
    keys.sort()
    begins = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[begins], np.diff(np.append(begins, len(keys)))
