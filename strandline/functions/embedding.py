"""Embeddings without a model: signed feature hashing of tokens, normalised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from strandline.functions.text import query_tokens

WIDTH = 64


def hashed(text: str | None, width: int = WIDTH) -> np.ndarray:
    """A vector of length one, or zeros for a text without tokens."""
    v = np.zeros(width)
    for token in query_tokens(text or ""):
        h = xxhash.xxh64_intdigest(token)
        v[h % width] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


@F.pandas_udf(ArrayType(FloatType()))
def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A caller with a real model replaces hashed() by it, loaded once before the loop."""
    for batch in texts:
        yield batch.map(lambda t: hashed(t).astype(np.float32))
