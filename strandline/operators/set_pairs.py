"""Pairs of similar sets: sets of like sizes stand in blocks, and each pair of blocks meets in a task of bounded memory.

Items are ordered, rare ones first. Two sets that are similar enough have m items in common at least, m following from their sizes, so l of these
stand among the first n - m + l of each, whatever l is. Only such beginnings are sent to the tasks, as 32 bits an item, and what meets there is
counted where it meets: no pair leaves a task before it has l items in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import stored

#: The most frequent items, whose order is known to every task; all others count as rare.
KNOWN_ITEMS = 1 << 18
#: A block holds sets of so many items in all at most; the sizes of its sets differ by this factor at most.
BLOCK_ITEMS, BLOCK_SPAN = 1 << 25, 1.15
#: Meetings that a task sorts at once, and pairs that a task compares; a large group of near copies has many times as many.
MEETINGS, PAIRS = 1 << 22, 1 << 19


class Blocks:
    """Sizes of sets cut into bands, a band of many items into several blocks. sizes: (size, how many sets)."""

    def __init__(self, sizes: list[tuple[int, int]], threshold: float):
        self.threshold, self.share = threshold, threshold / (1 + threshold)
        low, high, items = [], [], []
        for n, count in sorted(sizes):
            if not low or n > max(low[-1] + 1, low[-1] * BLOCK_SPAN):
                low.append(n), high.append(n), items.append(0)
            high[-1], items[-1] = n, items[-1] + n * count
        self.starts, self.parts = np.array(low, np.int64), np.array([-(-x // BLOCK_ITEMS) for x in items], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.parts)]).astype(np.int64)
        self.low, self.high = np.repeat(self.starts, self.parts), np.repeat(np.array(high, np.int64), self.parts)

    def of(self, n: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        band = np.searchsorted(self.starts, n, side="right") - 1
        return self.first[band] + hashes % self.parts[band]

    def common(self, n: np.ndarray, other: int) -> np.ndarray:
        """The least number of items in common with a set of the other size or more."""
        return np.maximum(1, np.ceil(self.share * (n + other) - 1e-9)).astype(np.int64)

    def needed(self, n: np.ndarray, q: int) -> np.ndarray:
        """l of the sets in the first block of a pair: one, and one more for each 40 items."""
        return np.minimum(1 + n // 40, self.common(n, int(self.low[q])))

    def beginning(self, n: np.ndarray, own: np.ndarray, other: int) -> np.ndarray:
        """How many first items sets of own blocks send to meet another block, 0 where none of its sets can be similar."""
        earlier = np.where(own < other, 1 + n // 40, 1 + self.high[np.minimum(own, other)] // 40)
        most = np.minimum(n, n - self.common(n, int(self.low[other])) + earlier)
        fits = np.where(own < other, n >= self.threshold * self.low[other] - 1e-9, self.high[other] >= self.threshold * n - 1e-9)
        return np.where(fits, most, 0)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, one behind the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _beginnings(sets: DataFrame, blocks: Blocks, names: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """p, q (the blocks that meet), block (the set's own), id, n, x (its first items' hashes). sets: id, s."""

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch["h"].flatten().to_numpy(zero_copy_only=False)
            n = batch["h"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(names, h), max(0, len(names) - 1))
            rank = np.where(names[at] == h, ranks[at], 0) if len(names) else np.zeros(len(h), np.int64)
            x = h[np.lexsort((h, rank, np.repeat(np.arange(len(n)), n)))].astype(np.int32)  # the lower 32 bits
            begins, id_ = np.cumsum(n) - n, batch["id"].to_numpy(zero_copy_only=False)
            own = blocks.of(n, batch["place"].to_numpy(zero_copy_only=False))
            for other in range(len(blocks.low)):
                most = blocks.beginning(n, own, other)
                mine = np.flatnonzero(most)
                if len(mine):
                    ends = np.concatenate([[0], np.cumsum(most[mine])]).astype(np.int32)
                    first = pa.ListArray.from_arrays(pa.array(ends), pa.array(x[_ranges(begins[mine], most[mine])]))
                    cols = [np.minimum(own[mine], other), np.maximum(own[mine], other), own[mine], id_[mine], n[mine]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int32, np.int32, np.int64, np.int32), strict=True)], first], ["p", "q", "block", "id", "n", "x"])

    hashed = sets.select("id", F.transform("s", lambda x: F.xxhash64(x)).alias("h"), (F.xxhash64("id").bitwiseAND(0x7FFFFFFF)).alias("place"))
    return hashed.mapInArrow(beginnings, "p int, q int, block int, id long, n int, x array<int>")


def _met(beginnings: DataFrame, blocks: Blocks) -> DataFrame:
    """p, q, part, a, b: pairs of sets that have enough items in common in their beginnings, in parts of bounded length."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        block, id_, n = (rows.column(c).to_numpy() for c in ("block", "id", "n"))
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("x").chunks])
        length = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in rows.column("x").chunks]).astype(np.int64)
        del rows
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        if not len(left) or not len(right):
            return
        begins = np.cumsum(length) - length
        right_x = x[_ranges(begins[right], length[right])]
        order = np.argsort(right_x, kind="stable")
        right_x, owner = right_x[order], np.repeat(np.arange(len(right)), length[right])[order]
        if p == q:
            own = np.empty(len(order), np.int64)
            own[order] = np.arange(len(order))
            stop = np.searchsorted(right_x, right_x, side="right")[own]
            start = own + 1  # a set meets the later ones
        else:
            left_x = x[_ranges(begins[left], length[left])]
            order = np.argsort(left_x, kind="stable")
            start, stop = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            start[order], stop[order] = (np.searchsorted(right_x, left_x[order], side=s) for s in ("left", "right"))
        often = stop - start
        least, n_left, n_right = blocks.needed(n[left].astype(np.int64), q), n[left].astype(np.int64), n[right].astype(np.int64)
        sent_left, sent_right = length[left], length[right]
        ends = np.cumsum(sent_left)
        total = np.concatenate([[0], np.cumsum(often)])[np.concatenate([[0], ends])]  # meetings before each set
        first, found = 0, 0
        while first < len(left):
            last = max(first + 1, int(np.searchsorted(total, total[first] + MEETINGS, side="right")) - 1)
            of = slice(int(ends[first - 1]) if first else 0, int(ends[last - 1]))
            mine = np.repeat(np.arange(last - first), np.diff(total[first : last + 1]))
            keys = mine * len(right) + owner[_ranges(start[of], often[of])]
            keys.sort()
            same = int(least[first:last].min()) - 1  # keys that stand less often belong to no pair
            often_met = keys[same:][keys[same:] == keys[: max(0, len(keys) - same)]] if same else keys
            pair = often_met[np.concatenate([[True], often_met[1:] != often_met[:-1]])] if len(often_met) else often_met
            i, j = np.divmod(pair, len(right))
            both = np.searchsorted(keys, pair, side="right") - np.searchsorted(keys, pair, side="left")
            i += first
            small, large = np.minimum(n_left[i], n_right[j]), np.maximum(n_left[i], n_right[j])
            common = np.maximum(1, np.ceil(blocks.share * (small + large) - 1e-9)).astype(np.int64)
            surely = common + np.minimum(sent_left[i] - n_left[i], sent_right[j] - n_right[j])  # of these, what both beginnings must hold
            keep = (both >= np.maximum(least[i], surely)) & (small >= blocks.threshold * large - 1e-9)
            a, b = id_[left[i[keep]]], id_[right[j[keep]]]
            for k in range(0, len(a), PAIRS):
                u, v = a[k : k + PAIRS], b[k : k + PAIRS]
                part = np.full(len(u), found // PAIRS)
                found += len(u)
                cols = [np.full(len(u), p, np.int32), np.full(len(u), q, np.int32), part.astype(np.int32), np.minimum(u, v), np.maximum(u, v)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["p", "q", "part", "a", "b"])
            first = last

    return beginnings.groupBy("p", "q").applyInArrow(met, "p int, q int, part int, a long, b long")


def _compared(pairs: pa.Table, sets: pa.Table, threshold: float) -> pa.Table:
    """a, b, jaccard of the pairs that are similar: whole sets, item by item. pairs: a, b; sets: id, s."""
    codes = np.concatenate([c.indices.to_numpy() for c in pa.chunked_array([c.flatten() for c in sets.column("s").chunks]).dictionary_encode().unify_dictionaries().chunks])
    n = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in sets.column("s").chunks]).astype(np.int64)
    begins, ids = np.cumsum(n) - n, sets.column("id").to_numpy()
    order = np.argsort(ids)
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    i, j = (order[np.searchsorted(ids, c, sorter=order)] for c in (a, b))
    both = np.zeros(len(a), np.int64)
    here = np.zeros(int(codes.max(initial=0)) + 1, bool)
    cuts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        mine = codes[begins[i[first]] : begins[i[first]] + n[i[first]]]
        here[mine] = True
        for at in range(first, last, 1024):
            of = j[at : min(last, at + 1024)]
            shared = here[codes[_ranges(begins[of], n[of])]]
            both[at : at + len(of)] = np.add.reduceat(shared.view(np.uint8), np.cumsum(n[of]) - n[of], dtype=np.int64)
        here[mine] = False
    jaccard = both / (n[i] + n[j] - both)
    keep = jaccard >= threshold - 1e-12
    return pa.table({"a": a[keep], "b": b[keep], "jaccard": jaccard[keep]})


def similar_pairs_of_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard of all pairs of different ids whose sets are similar to threshold (above 0): exact. sets: id (long), s (not empty, no item twice)."""
    often = sets.select(F.explode(F.transform("s", lambda x: F.xxhash64(x))).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = often.orderBy(F.col("n").desc(), "x").limit(KNOWN_ITEMS).orderBy("x").toPandas()  # 4 MB at most
    sizes = [tuple(r) for r in sets.groupBy(F.size("s")).agg(F.count(F.lit(1))).collect()]  # a row a size
    if not sizes:
        return sets.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")).where("false")
    blocks = Blocks(sizes, threshold)
    met = stored(_met(_beginnings(sets, blocks, known["x"].to_numpy(np.int64), known["n"].to_numpy(np.int64)), blocks), "met-sets")
    needed = met.select(F.col("p").alias("first"), F.col("q").alias("second"), F.col("part").alias("piece"), F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id")
    compare = lambda pairs, whole: _compared(pairs, whole, threshold) if len(whole) and len(pairs) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "jaccard": pa.array([], pa.float64())})
    return met.groupBy("p", "q", "part").cogroup(needed.groupBy("first", "second", "piece")).applyInArrow(compare, "a long, b long, jaccard double")
