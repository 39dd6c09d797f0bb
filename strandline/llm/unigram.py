"""Operator 3: SentencePiece encoding and decoding with a unigram model.

Pieces with log scores stand in a double-array trie (two integer arrays: a node's base, and the
node that owns each cell). A text's ids are the best-scoring path over its pieces, found by the
Viterbi algorithm. White space becomes a marker at the front of words; a character without a
piece costs a penalty and falls back to the pieces of its bytes. Decoding joins pieces and bytes
and turns markers back into spaces.

No piece has the marker behind another character and none holds a line feed, so the best path
of a text is that of its units (spaces with the word that follows, line feeds) in order. Units recur, so each worker keeps a
bounded cache, and the units of a batch that it lacks run through the trie together in numpy.

The public model file holds merge ranks in place of log probabilities; a piece of rank r scores
-ln(r + 10), Zipf's law of its rank, rounded to single precision. Ties go to the path whose last piece starts first.

Defined results: a null or empty text has no ids and decodes to an empty text; every other text
decodes to itself, but for the marker character U+2581, which reads as a space; repeated rows
are encoded each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.common import arrow_map, doc_bytes
from strandline.llm.word_cache import WordCache

MARKER = "▁".encode()
UNITS = re.compile(rb" +[^ \n]*|[^ \n]+|\n")
#: Added to the least score for a character without a piece.
UNKNOWN_PENALTY = -10.0
#: Units of up to so many bytes run together in numpy; longer ones one by one.
TOGETHER = 48


class DoubleArray:
    """A trie over bytes. From node s, byte c leads to t = base[s] + c if owner[t] == s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values, strict=True):
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][c]
            value[at] = v
        size = 2 * len(children) + 1024
        self.base = np.zeros(size, dtype=np.int32)
        self.owner = np.full(size, -1, dtype=np.int32)
        self.value = np.full(size, -1, dtype=np.int32)
        free = np.ones(size, dtype=bool)
        free[0] = False
        place = {0: 0}
        queue, first = [0], 1
        for node in queue:
            own = np.array(sorted(children[node]), dtype=np.int64)
            if not len(own):
                continue
            while not free[first]:
                first += 1
            reach = first + 512
            while True:  # the first cells where all children find a free place
                cells = first + np.flatnonzero(free[first : min(reach, size - 256)])
                cells = cells[cells >= own[0]]
                good = np.ones(len(cells), dtype=bool)
                for c in own[1:]:
                    good &= free[cells - own[0] + c]
                if good.any() or reach >= size:
                    break
                reach = first + 8 * (reach - first)
            base = int(cells[good.argmax()] - own[0])
            self.base[place[node]] = base
            for c in own.tolist():
                child = children[node][c]
                cell = base + c
                free[cell] = False
                self.owner[cell], self.value[cell] = place[node], value[child]
                place[child] = cell
                queue.append(child)


@dataclass
class Unigram:
    """A vocabulary: the trie, log scores by id, the ids of byte pieces, and each id's bytes."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    spelling: list[bytes]
    longest: int
    trie: DoubleArray
    unknown: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def best_paths(self, units: list[bytes]) -> list[list[int]]:
        """The ids of each unit, markers already in place of spaces."""
        out: list[list[int]] = [[] for _ in units]
        small = [i for i, u in enumerate(units) if 0 < len(u) <= TOGETHER]
        for i in range(0, len(small), 8192):
            block = sorted(small[i : i + 8192], key=lambda j: len(units[j]))
            for j in range(0, len(block), 2048):
                part = block[j : j + 2048]
                for at, ids in zip(part, self._together([units[x] for x in part]), strict=True):
                    out[at] = ids
        for i, u in enumerate(units):
            if len(u) > TOGETHER:
                out[i] = self._alone(u)
        return out

    def _together(self, units: list[bytes]) -> list[list[int]]:
        n, width = len(units), max(map(len, units))
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), dtype=np.uint8).reshape(n, width)
        length = np.array([len(u) for u in units])
        starts = (text & 0xC0) != 0x80
        span = np.select([text < 0x80, text < 0xE0, text < 0xF0], [1, 2, 3], 4)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, width + 1), dtype=np.int32)
        piece = np.full((n, width + 1), -1, dtype=np.int32)
        base, owner, value = self.trie.base, self.trie.owner, self.trie.value
        for s in range(width):
            rows = np.flatnonzero((s < length) & starts[:, s])
            if not len(rows):
                continue
            single = np.zeros(n, dtype=bool)
            alive, node = rows, np.zeros(len(rows), dtype=np.int64)
            for d in range(s, min(s + self.longest, width)):
                inside = d < length[alive]
                alive, node = alive[inside], node[inside]
                cell = base[node].astype(np.int64) + text[alive, d]
                good = owner[cell] == node
                alive, node = alive[good], cell[good]
                if not len(alive):
                    break
                v = value[node]
                ends = v >= 0
                at, v = alive[ends], v[ends]
                if len(at):
                    single[at[d + 1 - s == span[at, s]]] = True
                    score = best[at, s] + self.scores[v]
                    better = score > best[at, d + 1]
                    at = at[better]
                    best[at, d + 1], back[at, d + 1], piece[at, d + 1] = score[better], s, v[better]
            rows = rows[~single[rows]]
            end = s + span[rows, s]
            score = best[rows, s] + self.unknown
            better = score > best[rows, end]
            rows, end = rows[better], end[better]
            best[rows, end], back[rows, end], piece[rows, end] = score[better], s, -1
        back_rows, piece_rows = back.tolist(), piece.tolist()
        return [self._walk(u, back_rows[i], piece_rows[i]) for i, u in enumerate(units)]

    def _walk(self, unit: bytes, back: list[int], piece: list[int]) -> list[int]:
        ids: list[int] = []
        end = len(unit)
        while end:
            start = back[end]
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids += self.byte_ids[np.frombuffer(unit[start:end], dtype=np.uint8)].tolist()[::-1]
            end = start
        return ids[::-1]

    def _alone(self, unit: bytes) -> list[int]:
        """The same search for one unit of any length, in time and memory linear in it."""
        base, owner, value, scores = self.lists()
        n = len(unit)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            first = unit[s]
            if first & 0xC0 == 0x80:
                continue
            span = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            node, single, here = 0, False, best[s]
            for d in range(s, min(s + self.longest, n)):
                cell = base[node] + unit[d]
                if owner[cell] != node:
                    break
                node = cell
                if (v := value[node]) >= 0:
                    single |= d + 1 - s == span
                    if here + scores[v] > best[d + 1]:
                        best[d + 1], back[d + 1], piece[d + 1] = here + scores[v], s, v
            if not single and here + self.unknown > best[s + span]:
                best[s + span], back[s + span], piece[s + span] = here + self.unknown, s, -1
        return self._walk(unit, back, piece)

    def lists(self):
        if not hasattr(self, "_lists"):
            self._lists = (self.trie.base.tolist(), self.trie.owner.tolist(), self.trie.value.tolist(), self.scores.tolist())
        return self._lists

    def split(self, text: bytes) -> list[bytes]:
        """Units of a text, with the space that stands before every text."""
        return UNITS.findall(b" " + text.replace(MARKER, b" ")) if text else []

    def encode_units(self, units: list[bytes]) -> list[bytes]:
        return [np.array(ids, dtype="<i4").tobytes() for ids in self.best_paths([u.replace(b" ", MARKER) for u in units])]

    def decode(self, ids: list[int]) -> bytes:
        text = b"".join(map(self.spelling.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


def load_unigram(path: str, offset: float = 10.0) -> Unigram:
    """A unigram vocabulary from a public SentencePiece model file with merge ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids, scores, spelling, keys, values = np.zeros(256, dtype=np.int64), np.zeros(n), [], [], []
    pieces = [model.id_to_piece(i).encode() for i in range(n)]
    for i, p in enumerate(pieces):
        if model.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            spelling.append(bytes([int(p[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelling.append(b"")
        else:
            spelling.append(p.replace(MARKER, b" "))
            # pieces that the file marks as never wanted keep a score below all others
            rank = min(-model.get_score(i), 1e9)
            scores[i] = np.float32(-np.log(rank + offset))
            keys.append(p)
            values.append(i)
    if any(MARKER in k.lstrip(MARKER) or b"\n" in k or b" " in k for k in keys):
        raise ValueError("pieces cross the units that texts are cut into")
    unknown = float(scores[values].min() + UNKNOWN_PENALTY)
    return Unigram(pieces, scores, byte_ids, spelling, max(map(len, keys)), DoubleArray(keys, values), unknown)


_caches: dict[str, WordCache] = {}


def _cache(model: Unigram) -> WordCache:
    """One cache a worker process."""
    if model.key not in _caches:
        _caches.clear()
        _caches[model.key] = WordCache(model.encode_units, 120_000)
    return _caches[model.key]


def encode_texts(model: Unigram, texts: list[bytes]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers."""
    return _cache(model).encode([model.split(t) for t in texts])


def encode_documents(docs: DataFrame, model: Unigram) -> DataFrame:
    """doc_id and ids for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs = encode_texts(sent.value, batch.column("body").to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return arrow_map(doc_bytes(docs), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: Unigram) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [sent.value.decode(ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encoding_digest(docs: DataFrame, model: Unigram) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32, log_score and round_trip for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        is_byte = np.zeros(len(m.pieces), dtype=bool)
        is_byte[m.byte_ids] = True
        bodies, out = batch.column("body").to_pylist(), []
        for body, blob in zip(bodies, encode_texts(m, bodies), strict=True):
            ids = np.frombuffer(blob, dtype="<i4")
            back = m.decode(ids.tolist())
            out.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(blob), round(float(m.scores[ids].sum()), 3), back == body.replace(MARKER, b" ")))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        columns = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "log_score", "round_trip"])

    return arrow_map(doc_bytes(docs), run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, log_score double, round_trip boolean")
