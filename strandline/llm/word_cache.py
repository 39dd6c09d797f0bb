"""Encodes texts word by word through a bounded cache in each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of one generation of a cache, and the longest word in bytes that is kept.
GENERATION = 200_000
LONGEST_CACHED = 64


class WordCache:
    """Maps words to their encoding as bytes; encode_words fills what is missing.

    The cache only saves work. It holds two generations: words go to the young one, which becomes
    the old one when it is full, and what is used again moves back to the young one. Words longer than
    LONGEST_CACHED are encoded each time. So memory is bounded and results never change.
    """

    def __init__(self, encode_words: Callable[[list], Iterable[bytes]], generation: int = GENERATION):
        self.encode_words = encode_words
        self.generation = generation
        self.young: dict = {}
        self.old: dict = {}

    def _learn(self, words: set) -> dict:
        """Makes young know all words; what isn't to stay there is returned."""
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing, passing = [], {}
        for w in words:
            if w in young:
                continue
            if (known := old.get(w)) is not None:
                young[w] = known
            else:
                missing.append(w)
        if missing:
            for w, code in zip(missing, self.encode_words(missing), strict=True):
                young[w] = code
                if len(w) > LONGEST_CACHED:
                    passing[w] = code
        return passing

    def encode(self, texts: list[list]) -> list[bytes]:
        """The joined encodings of each list of words."""
        young = self.young
        wanted: set = set()
        for words in texts:
            wanted.update(words)
        passing = self._learn(wanted)
        young = self.young
        out = [b"".join(map(young.__getitem__, words)) for words in texts]
        for w in passing:
            del young[w]
        return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at starts, one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class ColumnarWordCache:
    """The same for integer codes, with words and codes in columns instead of Python objects.

    A batch's words are numbered by a dictionary encoding, looked up together, and only the missing
    ones go to encode_words, which returns their codes in one array, and where each word's codes
    start and how many they are. Beyond ``limit`` words or ``limit_bytes`` bytes the half used last stays.
    """

    def __init__(self, encode_words: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int = 1_000_000, limit_bytes: int = 48 << 20):
        self.encode_words = encode_words
        self.limit, self.limit_bytes = limit, limit_bytes
        self.known = pa.array([], type=pa.string())
        self.starts = self.lengths = self.used = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)
        self.turn = 0

    def _shrink(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
        if self.known.nbytes > self.limit_bytes:
            size = pc.binary_length(self.known.take(pa.array(keep))).to_numpy()
            keep = keep[size <= LONGEST_CACHED]
        self.known = self.known.take(pa.array(keep))
        self.flat = gather(self.flat, self.starts[keep], self.lengths[keep])
        self.lengths, self.used = self.lengths[keep], self.used[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _slots(self, words: pa.Array) -> np.ndarray:
        """The place of each distinct word among the known ones; missing words are learnt."""
        found = pc.index_in(words, value_set=self.known)
        missing = words.filter(pc.is_null(found))
        slots = np.array(pc.fill_null(found, -1).to_numpy(), dtype=np.int64)
        if len(missing):
            flat, starts, lengths = self.encode_words(missing)
            slots[slots < 0] = len(self.known) + np.arange(len(missing))
            self.known = pa.concat_arrays([self.known, missing])
            self.starts = np.concatenate([self.starts, len(self.flat) + starts])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used = np.concatenate([self.used, np.zeros(len(missing), dtype=np.int64)])
            self.flat = np.concatenate([self.flat, flat])
        self.turn += 1
        self.used[slots] = self.turn
        return slots

    def encode(self, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts one after the other, and how many each text has."""
        if len(self.known) > self.limit or self.known.nbytes > self.limit_bytes:
            self._shrink()
        split = pc.ascii_split_whitespace(bodies.cast(pa.string()))
        ends = split.offsets.to_numpy().astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        slots = self._slots(numbered.dictionary)[numbered.indices.to_numpy()]
        lengths = self.lengths[slots]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return gather(self.flat, self.starts[slots], lengths), np.diff(total[ends - ends[0]])
