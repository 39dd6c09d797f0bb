"""Word seeds that several documents hold, and their first holders, found in blocks of documents.

Documents are dealt out in ascending order of doc_id and packed into blocks of about BLOCK_WORDS words, each
word as a 32-bit code. A seed is the hash of k consecutive words. Each block names every seed it
holds once, with its first place in the block, so a passage that a third of all documents hold weighs a
block's share at most. These entries are exchanged by hash in compact arrays; where a seed meets
entries of other blocks, each of its blocks is told its first place of all. Inside a block the rest is
arithmetic on arrays.

The seeds of all places are exchanged. Their hashes are dealt into slots, whose number is in proportion to the words of the
corpus: a task gets as many slots as its share asks for, sorted, and holds one of them at a time. There are TURNS passes over
the corpus, each with its part of the slots, at every size: they halve the disk that the exchange takes. Longer seeds are tried only
where all short seeds inside them are shared, by several first holders; these keep all 64 bits of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, doc_bytes

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLOCK_WORDS, BLOCK_DOCS = 1 << 18, 1 << 16
SEEDS_A_SLOT = 1 << 21
TURNS = 2
#: Stands for the length of long seeds; their lengths are part of their hashes.
LONG = 0
BLOCK_SCHEMA = "block long, words long, doc_ids array<long>, versions array<long>, lengths array<int>, codes binary"
ENTRY_SCHEMA, ENTRY_ARROW = "slot int, block long, data binary", pa.schema([("slot", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
REPLY_SCHEMA, REPLY_ARROW = "block long, k int, slot long, data binary", pa.schema([("block", pa.int64()), ("k", pa.int32()), ("slot", pa.int64()), ("data", pa.binary())])
#: Marks an entry of a seed that several documents of the block hold.
SEVERAL = np.uint32(1 << 31)


def word_codes(body: bytes) -> np.ndarray:
    """32-bit codes of a text's words, without regard to ASCII case."""
    return np.fromiter(map(xxhash.xxh64_intdigest, body.translate(LOWER).split()), dtype=np.uint64).astype("<u4")


def seed_hashes(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k words from each place on."""
    h = np.full(len(at), k, dtype=np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[at + j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def stable_order(key: np.ndarray, bits: int) -> np.ndarray:
    """The order that sorts keys of so many bits; equal ones stay in place. Sorting numbers is faster than sorting their places."""
    place = max(1, len(key).bit_length())
    if bits + place > 64:
        return np.argsort(key, kind="stable")
    both = (key.astype(np.uint64) << np.uint64(place)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << place) - 1)).astype(np.int64)


class Block:
    """The documents of a block, their words one behind the other."""

    def __init__(self, row: dict):
        self.number: int = row["block"]
        self.doc_ids, self.versions = row["doc_ids"], row["versions"]
        self.codes = np.frombuffer(row["codes"], dtype="<u4")
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)

    @property
    def first_row(self) -> int:
        """The number of the first document; the others count on."""
        return self.number * BLOCK_DOCS

    def places(self, k: int) -> np.ndarray:
        """Places where k words of one document start."""
        at = np.arange(max(0, len(self.codes) - k + 1))
        return at[at + k <= (self.starts + self.lengths)[self.doc[at]]]


def slot_count(words: int, parts: int) -> int:
    """Slots for the seeds of so many words: of bounded size each, and some for each task and turn."""
    return TURNS * max(parts, -(-words // (TURNS * SEEDS_A_SLOT)))


def slots_of(h: np.ndarray, slots: int) -> np.ndarray:
    """Slots ascend with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)


def key_type(k: int) -> str:
    """What an entry holds of a hash: all of it, or the low half, beside its slot."""
    return "<u8" if k == LONG else "<u4"


class Seeds:
    """The seeds of some places of a block, grouped. slots: among how many slots hashes are dealt; whole: keys are whole hashes."""

    def __init__(self, block: Block, at: np.ndarray, k: int, slots: int, turn: tuple[int, int] | None = None, whole: bool = False):
        h = seed_hashes(block.codes, at, k)
        slot = slots_of(h, slots)
        key = h if whole else (slot << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        if turn:
            now = (slot >= turn[0]) & (slot < turn[1])
            at, key = at[now], key[now]
        self.block, self.k, self.at, self.slots, self.whole = block, k, at, slots, whole
        self.order = stable_order(key, 64 if whole else 32 + slots.bit_length())
        key = key[self.order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        self.group = np.flatnonzero(new)
        self.key = key[self.group]
        self.size = np.diff(np.append(self.group, len(key)))
        doc = block.doc[at[self.order]] if len(at) else np.zeros(0, dtype=np.int64)
        self.first_doc = doc[self.group]
        # places ascend in a group, so documents do
        self.several = self.first_doc != doc[self.group + self.size - 1]
        self.first_pos = at[self.order[self.group]] - block.starts[self.first_doc]

    def entries(self) -> list[tuple[int, int, bytes]]:
        """slot, block and data: the block's distinct seeds by slot."""
        slot = (slots_of(self.key, self.slots) if self.whole else self.key >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]])) if len(slot) else []
        low = self.key.astype("<u8") if self.whole else (self.key & np.uint64(0xFFFFFFFF)).astype("<u4")
        doc = self.first_doc.astype("<u2")
        pos = self.first_pos.astype("<u4") | np.where(self.several, SEVERAL, np.uint32(0))
        return [(int(slot[a]), self.block.number, low[a:b].tobytes() + doc[a:b].tobytes() + pos[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def resolved(self, key: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the places: the row and place of the seed's first holder, and whether several documents hold it.

        key (ascending), row and pos: the first holders of seeds that other blocks share.
        """
        rows, places, shared = self.block.first_row + self.first_doc, self.first_pos.copy(), self.several.copy()
        if len(key) and len(self.key):
            i = np.minimum(np.searchsorted(key, self.key), len(key) - 1)
            hit = key[i] == self.key
            rows[hit], places[hit] = row[i[hit]], pos[i[hit]]
            shared |= hit
        out = np.empty(len(self.at), dtype=np.int64), np.empty(len(self.at), dtype=np.int64), np.empty(len(self.at), dtype=bool)
        for o, x in zip(out, (rows, places, shared), strict=True):
            o[self.order] = np.repeat(x, self.size)
        return out


def blocks(docs: DataFrame, min_words: int) -> DataFrame:
    """The documents that have min_words words, in blocks; their numbers ascend with (doc_id, hash of the text).

    Neighbouring identical rows are one document. Rows are dealt by doc_id, text hash and origin, so neither
    a frequent id nor a frequent row gathers in one task.
    """
    bounded_batches(docs.sparkSession)
    rows = doc_bytes(docs, F.xxhash64("text").alias("version")).where(F.col("doc_id").isNotNull() & (F.octet_length("body") >= 2 * min_words - 1))
    rows = rows.withColumn("origin", F.spark_partition_id())
    dealt = rows.repartitionByRange("doc_id", "version", "origin").sortWithinPartitions("doc_id", "version").select("doc_id", "version", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, held, words = TaskContext.get().partitionId() << 20, None, [], 0

        def packed() -> pa.RecordBatch:
            ids, versions, codes = zip(*held, strict=True)
            row = {"block": number, "words": words, "doc_ids": list(ids), "versions": list(versions), "lengths": list(map(len, codes)), "codes": b"".join(c.tobytes() for c in codes)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("versions", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary())])
        for batch in batches:
            for doc_id, version, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "body")), strict=True):
                if (doc_id, version) == last:
                    continue
                last, codes = (doc_id, version), word_codes(body)
                if len(codes) < min_words:
                    continue
                if held and (words + len(codes) > BLOCK_WORDS or len(held) == BLOCK_DOCS):
                    yield packed()
                    number, held, words = number + 1, [], 0
                held.append((doc_id, version, codes))
                words += len(codes)
        if held:
            yield packed()

    return dealt.mapInArrow(run, BLOCK_SCHEMA)


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows[i : i + 512], strict=True), schema.types, strict=True)], schema=schema)


def entry_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    return _batches(rows, ENTRY_ARROW)


def short_entries(blocks_: DataFrame, k: int, slots: int, turn: int) -> DataFrame:
    """The entries of one turn: seeds at all places, by slot."""
    first, end = (slots * t // TURNS for t in (turn, turn + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                yield from entry_rows(Seeds(block, block.places(k), k, slots, (first, end)).entries())

    return blocks_.mapInArrow(run, ENTRY_SCHEMA)


def first_holders(entries: DataFrame, k: int, parts: int) -> DataFrame:
    """What each block is told: key, row and place of the first holder of seeds that other blocks have, too.

    A task gets its slots one behind the other and holds one at a time.
    """
    dealt = entries.repartitionById(parts, F.pmod("slot", F.lit(parts))).sortWithinPartitions("slot")
    key, size = key_type(k), np.dtype(key_type(k)).itemsize

    def met(slot: int, rows: list[tuple[int, bytes]]) -> list[tuple]:
        rows.sort()
        n = [len(data) // (size + 6) for _, data in rows]
        low = np.concatenate([np.frombuffer(data, key, m) for (_, data), m in zip(rows, n, strict=True)])
        doc = np.concatenate([np.frombuffer(data, "<u2", m, size * m) for (_, data), m in zip(rows, n, strict=True)])
        pos = np.concatenate([np.frombuffer(data, "<u4", m, (size + 2) * m) for (_, data), m in zip(rows, n, strict=True)])
        of = np.repeat(np.arange(len(rows)), n)
        order = stable_order(low, 8 * size)
        low_in_order = low[order]
        new = np.ones(len(low), dtype=bool)
        new[1:] = low_in_order[1:] != low_in_order[:-1]
        group = np.flatnonzero(new)
        sizes = np.diff(np.append(group, len(low)))
        first = np.repeat(order[group], sizes)
        told = np.repeat(sizes > 1, sizes)
        at, first = order[told], first[told]
        numbers = np.array([b for b, _ in rows], dtype=np.int64)
        row, place = numbers[of[first]] * BLOCK_DOCS + doc[first], pos[first] & ~SEVERAL
        to = np.lexsort((place, row, of[at]))  # equal rows side by side: files and shuffles compress them
        at, row, place = at[to], row[to], place[to]
        edges = np.flatnonzero(np.concatenate([[True], of[at][1:] != of[at][:-1], [True]])) if len(at) else []
        return [(int(numbers[of[at[a]]]), k, slot, low[at[a:b]].tobytes() + row[a:b].astype("<i8").tobytes() + place[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for slot, block, data in zip(*(batch.column(c).to_pylist() for c in ("slot", "block", "data")), strict=True):
                if slot != now and held:
                    yield from _batches(met(now, held), REPLY_ARROW)
                    held = []
                now = slot
                held.append((block, data))
        if held:
            yield from _batches(met(now, held), REPLY_ARROW)

    return dealt.mapInArrow(run, REPLY_SCHEMA)


def told(replies: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key (ascending), row and place of the first holders that a block was told of."""
    rows = [(slot, data) for kk, slot, data in zip(*(replies.column(c).to_pylist() for c in ("k", "slot", "data")), strict=True) if kk == k]
    if not rows:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind, size = key_type(k), np.dtype(key_type(k)).itemsize
    n = [len(data) // (size + 12) for _, data in rows]
    key = np.concatenate([np.frombuffer(d, kind, m).astype(np.uint64) | np.uint64(0 if k == LONG else s << 32) for (s, d), m in zip(rows, n, strict=True)])
    row = np.concatenate([np.frombuffer(d, "<i8", m, size * m) for (_, d), m in zip(rows, n, strict=True)])
    pos = np.concatenate([np.frombuffer(d, "<u4", m, (size + 8) * m) for (_, d), m in zip(rows, n, strict=True)]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], row[order], pos[order]


def scattered(block: Block, at: np.ndarray, row: np.ndarray, pos: np.ndarray, shared: np.ndarray, short: int, k: int) -> np.ndarray:
    """Places where k words of one document start, all of whose short seeds are shared but by no one first holder.

    Left out are words that short seeds of one first holder, on one diagonal, cover from end to end: that holder
    has them all. Whether it does depends on these words alone, so all documents that hold them agree.
    """
    at, row, pos = at[shared], row[shared], pos[shared]
    order = np.lexsort((at, pos - at + block.starts[block.doc[at]], block.doc[at], row))
    a, r, p = at[order], row[order], pos[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (a[1:] - a[:-1] > short) | (p[1:] - p[:-1] != a[1:] - a[:-1])
    line = np.full(len(block.codes), -1)
    line[a] = np.cumsum(new)
    total = np.concatenate([[0], np.cumsum(line >= 0)])
    places, width = block.places(k), k - short + 1
    whole = total[places + width] - total[places] == width
    places = places[whole]
    return places[line[places] != line[places + width - 1]]
