"""Operator 8: media columns. Bytes as greyscale PNG files in a binary column, with image hashes.

A payload becomes an image 64 samples wide with 8 bits a sample. The writer filters each row by
the sum of absolute differences (None, Sub or Up), compresses with zlib and adds a checksum to each
chunk. The reader verifies signature, chunk checksums, header and length, and undoes all five
filter types; None, Sub and Up without a loop over rows. The feature is a perceptual hash: the image is
averaged down to 32 x 32, and the signs of its 8 x 8 lowest cosine-transform coefficients
against their median make 64 bits.

Defined results: a null text is empty; an empty payload is padded to 64 zero bytes; repeated and
equal texts give equal values; an empty table gives no rows; further columns are not read. A file that
fails a checksum or is cut short raises ValueError. Memory is bounded by an Arrow batch and a few
times one text: filters are tried on ROWS rows at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.common import arrow_map, doc_bytes, stored

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of compressed data in one IDAT chunk.
CHUNK_BYTES = 1 << 20
#: Rows that are filtered at a time.
ROWS = 4096
GRID, LOW = 32, 8


def pad(body: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the width."""
    return body + bytes(-len(body) % WIDTH if body else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray) -> Iterator[bytes]:
    """Rows with their filter byte in front, each by the filter of the smallest residual; some rows at a time."""
    for y in range(0, len(rows), ROWS):
        now = rows[y : y + ROWS]
        above = np.zeros_like(now)
        above[1:] = now[:-1]
        if y:
            above[0] = rows[y - 1]
        tries = np.stack([now, now, now - above])
        tries[1][:, 1:] -= now[:, :-1]
        weight = np.abs(tries.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
        kind = weight.argmin(axis=0)
        out = np.empty((now.shape[0], now.shape[1] + 1), dtype=np.uint8)
        out[:, 0] = kind
        out[:, 1:] = tries[kind, np.arange(now.shape[0])]
        yield out.tobytes()


def png_encode(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A greyscale PNG whose samples are the payload, which fills whole rows."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    packer = zlib.compressobj(level)
    data = b"".join([*map(packer.compress, _filtered(rows)), packer.flush()])
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    chunks = [_chunk(b"IDAT", data[i : i + CHUNK_BYTES]) for i in range(0, len(data), CHUNK_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *chunks, _chunk(b"IEND", b"")])


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples from filtered rows (one byte a sample)."""
    if (kinds > 4).any():
        raise ValueError("unknown filter type")
    if (kinds > 2).any():
        return _unfiltered_slowly(kinds, rows)
    out = rows.copy()
    sub = kinds == 1
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    up = kinds == 2
    up[0] = False  # above the first row stand zeros
    if up.any():
        # down a run of Up rows a sample is its base row's plus all residuals so far, modulo 256
        base = np.maximum.accumulate(np.where(up, 0, np.arange(len(kinds))))
        total = np.cumsum(out, axis=0, dtype=np.uint8)
        before = np.zeros_like(out)
        before[1:] = total[:-1]
        out[up] = total[up] - before[base[up]]
    return out


def _unfiltered_slowly(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row after row; Average and Paeth also need sample after sample."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], dtype=np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        if kind == 0:
            out[y] = rows[y]
        elif kind == 1:
            out[y] = np.cumsum(rows[y], dtype=np.uint8)
        elif kind == 2:
            out[y] = rows[y] + above
        else:
            left = corner = 0
            line = []
            for x, b in zip(rows[y].tolist(), above.tolist(), strict=True):
                if kind == 3:
                    guess = (left + b) >> 1
                else:
                    p = left + b - corner
                    near = [(abs(p - v), i, v) for i, v in enumerate((left, b, corner))]
                    guess = min(near)[2]
                left = (x + guess) & 255
                corner = b
                line.append(left)
            out[y] = line
        above = out[y]
    return out


def png_decode(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG, as rows; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + n > len(data):
            raise ValueError("cut short")
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if not ended or header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale image")
    flat = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8)
    if len(flat) != header[1] * (header[0] + 1):
        raise ValueError("wrong length")
    rows = flat.reshape(header[1], header[0] + 1)
    return _unfiltered(rows[:, 0], rows[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    """The first k rows of the type-2 cosine transform of n samples."""
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None])


_LOW_COSINES = _cosines(GRID, LOW)


def _pooled(x: np.ndarray, size: int) -> np.ndarray:
    """Means of x along axis 0 in size bands; where rows are fewer, bands repeat rows."""
    edges = np.arange(size + 1) * len(x) // size
    lo, hi = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    sums = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
    return (sums[hi] - sums[lo]) / (hi - lo)[:, None]


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: low-frequency coefficients above their median."""
    columns = samples.reshape(len(samples), GRID, -1).mean(axis=2)
    grid = _pooled(columns, GRID)
    low = _LOW_COSINES @ grid @ _LOW_COSINES.T
    flat = np.round(low.ravel(), 6)
    bits = flat > np.median(flat[1:])
    return np.packbits(bits).tobytes().hex()


def media_column(docs: DataFrame, level: int = 6) -> DataFrame:
    """doc_id, n_bytes and media: each text as a PNG file in a binary column."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = batch.column("body").to_pylist()
        files = [png_encode(pad(b), level=level) for b in bodies]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(b) for b in bodies], type=pa.int64()), pa.array(files, type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    return arrow_map(doc_bytes(docs), encode, "doc_id long, n_bytes long, media binary")


def stored_media(docs: DataFrame, level: int = 6) -> DataFrame:
    """The media column as a table in the shared scratch folder, so that what reads it reads stored bytes."""
    return stored(media_column(docs, level), "media")


def media_digest(media: DataFrame) -> DataFrame:
    """Reads each stored file back: its payload's digests, its own, and the image hash."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data in batch.column("media").to_pylist():
            samples = png_decode(data)
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
        columns = list(zip(*out, strict=True))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(media, digest, schema)
