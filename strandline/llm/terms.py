"""Terms of texts: runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = 32
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else _SPACE for b in range(256)], dtype=np.uint8)


def _term_starts(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all texts, which of them stand in terms, where terms start, and where texts end."""
    _, offsets, data = bodies.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    folded = _FOLD[np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    inside = folded != _SPACE
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(folded)]
    opens[first] = inside[first]  # a text's first byte opens a term even if the text before it ends with one
    return folded, inside, np.flatnonzero(opens), ends


def batch_terms(bodies: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts (binary, UTF-8, no nulls), one behind the other, and how many each text has.

    A byte of a UTF-8 character beyond ASCII is never below 128, so terms are cut byte by byte.
    """
    folded, inside, starts, ends = _term_starts(bodies)
    kept = folded[inside]
    cuts = np.append(np.cumsum(inside)[starts] - 1, len(kept)).astype(np.int32)
    terms = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(kept)])
    return terms, np.diff(np.searchsorted(starts, ends))


def term_counts(bodies: pa.Array) -> np.ndarray:
    """How many terms each text has."""
    _, _, starts, ends = _term_starts(bodies)
    return np.diff(np.searchsorted(starts, ends))


def numbered(terms: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Each term's number among the distinct terms, and those."""
    coded = terms.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
