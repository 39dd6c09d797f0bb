"""Operator 5: fuzzy passages that repeat across documents, by collinear chaining.

Seeds are hashes of four consecutive words, at every place. An edit spoils four of them at most, so 50 words with
ten edits keep seven (the q-gram lemma): a link is left out only where no words around it, as many as
a passage may have, hold enough that its partner or an earlier document holds too. Each seed links its occurrences to the
first one, the one in the smallest doc_id, instead of to each other: a passage that a third of all documents
hold makes as many links as documents. Where the short seeds of ten words, or of min_words, are all shared but have no
first holder in common, these longer runs are seeds, too, with first holders of their own: any min_words words that an
earlier document holds as they are get links to a document that holds them all, whoever holds their parts (see shared_seeds).

The links of two documents are sorted, joined to anchors where they stand on one diagonal, and, but for a single short
seed with no other link to that document around, chained: a Fenwick tree over the second document's positions gives each anchor its best predecessor
under a linear gap cost. Chains, cut into pieces of bounded length, then fetch the words they span in
the other document (in tiles, each once per document) and are aligned word by word: along anchors, by longest
common subsequence in gaps, and outward from the ends. Runs of aligned words without a larger hole
are passages; those of at least ``min_words`` words of which ``min_identity`` agree are returned.

Words compare without regard to ASCII case. The first occurrence itself is not a passage of its
document; it stands in the rep columns of the others.

Defined results: null, empty and short texts have no passages; a row without a doc_id isn't compared;
identical rows are one document; rows that share a doc_id but not a text are documents of their own, told apart by
version, the hash of the text; equal texts under several ids are told from the smallest of them; repeats inside one document aren't passages; a very
long text is one block, held whole by a task with some 100 bytes a word; an empty table gives no rows; further
columns are not read, and remove_passages() carries them.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandline.llm.common import WORD, arrow_map, bounded_batches, discard, fresh, stored, text_bytes
from strandline.llm.shared_seeds import BLOCK_DOCS, ENTRY_ARROW, ENTRY_SCHEMA, LONG, TURNS, Block, Seeds, blocks, entry_rows, first_holders, scattered, short_entries, slot_count, told

#: Words of a short seed, and of a longer one besides min_words.
K, LONGER = 4, 10
#: Words between neighbouring anchors of one chain, and of a hole inside one passage, at most.
MAX_GAP, MAX_HOLE = 48, 10
#: Places from one seed of an anchor to the next, at most: further ones could step over an insertion and a deletion.
MERGE = 2 * K
#: What a word of gap costs, where a word of an anchor earns 1.
GAP_COST = 0.05
PIECE, TILE, REACH, STEP = 1024, 64, 48, 8
#: Words between two groups of anchors that can't continue each other.
APART = 2 * REACH + MAX_HOLE

def least_shared(min_words: int, min_identity: float, steps: int = 4) -> list[tuple[int, int]]:
    """(seeds, places): a passage shares so many seeds with its first form within so many places, for one of the list.

    A passage of twice min_words or more has a half as good as itself, so lengths below that are enough.
    """
    need = [(max(1, n - K + 1 - K * int((1 - min_identity) * n + 1e-9)), n - K + 1) for n in range(min_words, 2 * min_words)]
    parts = [need[i : i + -(-len(need) // steps)] for i in range(0, len(need), -(-len(need) // steps))]
    return [(min(x for x, _ in part), part[-1][1]) for part in parts]


class Fenwick:
    """Greatest value so far over a prefix of places, with the number that has it."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)

    def put(self, place: int, value: float, number: int) -> None:
        i, new = place + 1, (value, number)
        while i < len(self.best):
            if new > self.best[i]:
                self.best[i] = new
            i += i & -i

    def below(self, place: int) -> tuple[float, int]:
        i, found = place, (-np.inf, -1)
        while i:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def chain(p0: list[int], r0: list[int], size: list[int]) -> list[list[int]]:
    """Chains of anchors (numbers in order), best first. Anchors come by p0; each is in one chain."""
    if len(p0) == 1:
        return [[0]]
    rank = {r: i for i, r in enumerate(sorted(set(r0)))}
    tree, score, before = Fenwick(len(rank)), [0.0] * len(p0), [-1] * len(p0)
    for i in range(len(p0)):
        value, j = tree.below(rank[r0[i]])
        value -= GAP_COST * (p0[i] + r0[i])
        score[i] = size[i] + max(0.0, value)
        if value > 0:
            before[i] = j
        tree.put(rank[r0[i]], score[i] + GAP_COST * (p0[i] + r0[i] + 2 * size[i]), i)
    used, out = [False] * len(p0), []
    for i in sorted(range(len(p0)), key=lambda i: (-score[i], i)):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            out.append(path[::-1])
    return out


STARTS, ENDS, ALONE = 1, 2, 4


def _alone(groups: list[list[list[int]]]) -> list[bool]:
    """Which groups no other one of their pair, each followed outward on both sides, could continue. Groups come by place."""
    box = [(g[0][0], max(a[0] + a[2] for a in g) + APART, g[0][1], max(a[1] + a[2] for a in g) + APART) for g in groups]
    out = [True] * len(groups)
    for i, (_, p, r, s) in enumerate(box):
        for j in range(i + 1, len(box)):
            if box[j][0] > p:
                break
            if box[j][2] <= s and r <= box[j][3]:
                out[i] = out[j] = False
    return out


def _pieces(own: np.ndarray, rep: int, p0: list[int], r0: list[int], size: list[int]) -> list[tuple]:
    """Chains of one pair of documents as groups of bounded length; groups that need the same words share a piece.

    A piece: rep, number, anchors (five 32-bit integers each), place and codes of its own words, and the other's places.
    An anchor is its two places, its words, its group's number and what the group is: the start or the end of
    a chain, or with no other group around.
    """
    done: list[list[list[int]]] = []
    for path in chain(p0, r0, size):
        parts: list[list[int]] = []
        for i in path:
            j = parts[-1][-1] if parts else -1
            if parts and p0[i] - p0[j] - size[j] <= MAX_GAP and r0[i] - r0[j] - size[j] <= MAX_GAP:
                parts[-1].append(i)
            else:
                parts.append([i])
        for part in parts:
            groups: list[list[list[int]]] = [[]]
            for i in part:
                for at in range(0, size[i], PIECE):
                    a = [p0[i] + at, r0[i] + at, min(PIECE, size[i] - at), 0, 0]
                    if groups[-1] and a[0] + a[2] - groups[-1][0][0] > PIECE:
                        groups.append([])
                    groups[-1].append(a)
            for g, is_ in ((groups[0], STARTS), (groups[-1], ENDS)):
                for a in g:
                    a[4] += is_
            done += groups
    done.sort(key=lambda g: g[0][:2])
    near: dict[tuple[int, int], list[list[int]]] = {}
    for number, (g, alone) in enumerate(zip(done, _alone(done), strict=True)):
        for a in g:
            a[3:] = number, a[4] + ALONE * alone
        near.setdefault((g[0][0] // PIECE, g[0][1] // PIECE), []).extend(g)
    out = []
    for x in near.values():
        lo = max(0, min(a[0] for a in x) - REACH)
        own_words = own[lo : max(a[0] + a[2] for a in x) + REACH].tobytes()
        out.append((rep, x[0][3], np.array(x, dtype="<i4").tobytes(), lo, own_words, max(0, min(a[1] for a in x) - REACH), max(a[1] + a[2] for a in x) + REACH))
    return out


PIECE_SCHEMA = "doc long, doc_id long, version long, rep long, number int, anchors binary, p_lo int, codes binary, r_lo int, r_hi int"
_PIECE_ARROW = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("rep", pa.int64()), ("number", pa.int32()), ("anchors", pa.binary()), ("p_lo", pa.int32()), ("codes", pa.binary()), ("r_lo", pa.int32()), ("r_hi", pa.int32())])


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables whose groups of equal neighbouring values in a column are whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        change = np.flatnonzero(values != values[-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and held[-1].column(column)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def crowded(pos: np.ndarray, rep: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Which links lie among so many links to the same or earlier documents, themselves included, within so many places.

    A seed that a document shares with rep has its first place in rep or before, so a passage shared with rep
    keeps its links. pos: each place once, ascending.
    """
    n, w = least[0]
    keep = np.zeros(len(pos), dtype=bool)
    if len(pos) < n:
        return keep
    # most links of a passage stand among as many to one document
    order = np.lexsort((pos, rep))
    p, r = pos[order], rep[order]
    close = np.flatnonzero((r[n - 1 :] == r[: len(r) - n + 1]) & (p[n - 1 :] - p[: len(p) - n + 1] < w))
    keep[order[np.unique(close[:, None] + np.arange(n))]] = True
    # and some have too few of any around
    rest = np.flatnonzero(~keep)
    held = np.zeros(len(rest), dtype=bool)
    for m, v in least:
        first = np.searchsorted(pos, pos[rest] - v, side="right")
        held |= np.searchsorted(pos, pos[rest] + v) - first >= m
    rest = rest[held]
    if not len(rest):
        return keep
    low, none, width = int(pos.min()), np.iinfo(np.int64).max, max(w for _, w in least)
    firsts = np.full(int(pos.max()) - low + 2 * width - 1, none)
    firsts[pos - low + width - 1] = rep
    around = np.lib.stride_tricks.sliding_window_view(firsts, 2 * width - 1)
    for a in range(0, len(rest), 16_384):
        some = rest[a : a + 16_384]
        upto = np.zeros((len(some), 2 * width), dtype=np.int16)
        np.cumsum(around[pos[some] - low] <= rep[some, None], axis=1, out=upto[:, 1:])
        for n, w in least:  # windows of w places that hold the middle one
            keep[some] |= (upto[:, width : width + w] - upto[:, width - w : width]).max(axis=1) >= n
    return keep


def thinned(pos: np.ndarray, rep: np.ndarray, rpos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which links to keep where a text repeats itself, so that neighbouring links of one size have one end in common.

    Of these, one in STEP places and the last are kept: a passage is followed REACH words on from each, over the next.
    """
    order = np.lexsort((pos, rpos, rep, size))
    p, r, q, n = pos[order], rep[order], rpos[order], size[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (n[1:] != n[:-1]) | (r[1:] != r[:-1]) | (q[1:] != q[:-1]) | (p[1:] - p[:-1] > STEP)
    start = p[np.flatnonzero(new)][np.cumsum(new) - 1]
    step = (p - start) // STEP
    keep = np.ones(len(p), dtype=bool)
    keep[1:-1] = new[1:-1] | (step[1:-1] != step[:-2]) | new[2:]
    out = np.empty(len(p), dtype=bool)
    out[order] = keep
    return out


def long_lengths(min_words: int) -> list[int]:
    return sorted({k for k in (LONGER, min_words) if K < k <= min_words})


def _short_links(block: Block, replies: pa.Table, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of short seeds, the rows and places of their first holders, and whether they are shared."""
    seeds = Seeds(block, block.places(K), K, slots)
    return seeds.at, *seeds.resolved(*told(replies, K))


def long_entries(blocks_: DataFrame, replies: DataFrame, slots: int, lengths: list[int]) -> DataFrame:
    """The entries of longer seeds, at places all of whose short seeds are shared, by several first holders."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row in left.to_pylist():
            block = Block(row)
            short = _short_links(block, right, slots)
            for k in lengths:
                rows += Seeds(block, scattered(block, *short, K, k), k, slots, whole=True).entries()
        return pa.Table.from_batches(entry_rows(rows), schema=ENTRY_ARROW)

    return blocks_.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, ENTRY_SCHEMA)


def chains(blocks_: DataFrame, replies: DataFrame, slots: int, lengths: list[int], least: list[tuple[int, int]]) -> DataFrame:
    """Pieces of chains, with the words they span in their own document. A group is one block and what it was told."""

    def linked(block: Block, right: pa.Table) -> tuple[np.ndarray, ...]:
        at, row, pos, shared = short = _short_links(block, right, slots)
        found = [(at, row, pos, np.full(len(at), K), shared)]
        for k in lengths:
            seeds = Seeds(block, scattered(block, *short, K, k), k, slots, whole=True)
            found.append((seeds.at, *seeds.resolved(*told(right, LONG))[:2], np.full(len(seeds.at), k), np.ones(len(seeds.at), dtype=bool)))
        at, row, pos, size, shared = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = shared & (row != block.first_row + block.doc[at])
        at, row, pos, size = at[keep], row[keep], pos[keep], size[keep]
        by_doc = np.argsort(block.doc[at], kind="stable")
        return at[by_doc], row[by_doc], pos[by_doc], size[by_doc]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for x in left.to_pylist():
            block = Block(x)
            rows += _block_pieces(block, *linked(block, right), least)
        columns = list(zip(*rows, strict=True)) or [()] * len(_PIECE_ARROW)
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _PIECE_ARROW.types, strict=True)], schema=_PIECE_ARROW)

    return blocks_.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, PIECE_SCHEMA)


def _block_pieces(block: Block, at: np.ndarray, rep: np.ndarray, rpos: np.ndarray, size: np.ndarray, least: list[tuple[int, int]]) -> list[tuple]:
    """Pieces of the chains of all documents of a block, from their links. at: places in the block."""
    # places of different documents stand too far apart to meet in a window
    pos = at + 4 * max(w for _, w in least) * block.doc[at]
    short = size == K
    keep = ~short
    keep[short] = crowded(pos[short], rep[short], least)
    keep[keep] = thinned(pos[keep], rep[keep], rpos[keep], size[keep])
    at, pos, rep, rpos, size = at[keep], pos[keep], rep[keep], rpos[keep], size[keep]
    if not len(at):
        return []
    order = np.lexsort((pos, pos - rpos, rep))
    at, pos, rep, rpos, size = at[order], pos[order], rep[order], rpos[order], size[order]
    diagonal, end = pos - rpos, pos + size
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (rep[1:] != rep[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] - pos[:-1] > MERGE)
    first = np.flatnonzero(new)
    doc, rep, r0, n = block.doc[at[first]], rep[first], rpos[first], np.maximum.reduceat(end, first) - pos[first]
    p0 = at[first] - block.starts[doc]
    order = np.lexsort((r0, p0, rep, doc))
    doc, rep, p0, r0, n = doc[order], rep[order], p0[order], r0[order], n[order]
    same = (doc[1:] == doc[:-1]) & (rep[1:] == rep[:-1])
    second = np.zeros(len(rep), dtype=bool)
    second[1:] = same & (p0[1:] - p0[:-1] - n[:-1] <= APART)
    second[:-1] |= second[1:]
    followed = second | (n > K)
    doc, rep, p0, r0, n = doc[followed], rep[followed], p0[followed], r0[followed], n[followed]
    edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rep[1:] != rep[:-1]), [True]])).tolist() if len(doc) else []
    docs, reps, p0, r0, n = doc.tolist(), rep.tolist(), p0.tolist(), r0.tolist(), n.tolist()
    out: list[tuple] = []
    for a, b in itertools.pairwise(edges):
        i = docs[a]
        start = int(block.starts[i])
        ids = (block.first_row + i, block.doc_ids[i], block.versions[i])
        out += [(*ids, *x) for x in _pieces(block.codes[start : start + int(block.lengths[i])], reps[a], p0[a:b], r0[a:b], n[a:b])]
    return out


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two short arrays.

    Row i's bit j is 0 where the first j + 1 words of b have one word more in common with the first i of a than
    the first j have; a row follows from the one before by one addition.
    """
    if not len(a) or not len(b):
        return []
    if len(a) == len(b):
        same = np.flatnonzero(a == b)
        if len(same) >= len(a) - 1:  # no subsequence of two different arrays is longer
            return [(i, i) for i in same.tolist()]
    at: dict[int, int] = {}
    for j, word in enumerate(b.tolist()):
        at[word] = at.get(word, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for word in a.tolist():
        if held := row & at.get(word, 0):
            row = (row + held | row - held) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif rows[i - 1] >> j - 1 & 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            i -= 1
    return out[::-1]


Aligned = tuple[int, int, int]


Pairs = list[tuple[int, int]]


def _outward(a: np.ndarray, b: np.ndarray, far: bool, seen: dict[str, tuple[Pairs, Pairs]], side: str) -> Pairs:
    """Pairs of equal words from the front of both: up to the best score, a word that differs costing 1, or as far as holes allow.

    seen keeps what was found on a side, for a second look at other ends.
    """
    a, b = a[:REACH], b[:REACH]

    def best(pairs: Pairs) -> tuple[int, int]:
        score = top = keep = at = 0
        for k, (i, j) in enumerate(pairs):
            gap = max(i, j) - at
            score -= gap
            if gap > MAX_HOLE or not far and score < top - MAX_HOLE:
                break
            score, at = score + 1, max(i, j) + 1
            if far or score >= top:
                top, keep = max(top, score), k + 1
        return top, keep

    n = min(len(a), len(b))
    if side not in seen:
        same = np.flatnonzero(a[:n] == b[:n]).tolist()
        seen[side] = [(i, i) for i in same], []
    straight, bent = seen[side]
    top, keep = best(straight)
    if 5 * top >= 4 * n:
        return straight[:keep]
    if not bent:
        bent += _common(a, b)
    other, kept = best(bent)
    return bent[:kept] if other > top else straight[:keep]


def aligned_blocks(a: np.ndarray, b: np.ndarray, anchors: list[list[int]], starts: bool, ends: bool, far: bool = False, seen: dict[str, tuple[Pairs, Pairs]] | None = None) -> list[Aligned]:
    """Aligned equal words as blocks (place in a, place in b, words), in order.

    a and b are word codes, anchors (place in a, place in b, words) in order.
    """
    seen = {} if seen is None else seen
    pairs: Pairs = []
    p_end, r_end = anchors[0][0], anchors[0][1]
    if starts:
        pairs += [(p_end - 1 - i, r_end - 1 - j) for i, j in _outward(a[max(0, p_end - REACH) : p_end][::-1], b[max(0, r_end - REACH) : r_end][::-1], far, seen, "front")][::-1]
    if "inside" not in seen:
        inside: Pairs = []
        for p, r, n in anchors:
            skip = max(0, p_end - p, r_end - r)
            if skip >= n:
                continue
            p, r, n = p + skip, r + skip, n - skip
            inside += [(p_end + i, r_end + j) for i, j in _common(a[p_end:p], b[r_end:r])]
            n = max(0, min(n, len(a) - p, len(b) - r))
            same = np.flatnonzero(a[p : p + n] == b[r : r + n])
            inside += zip((same + p).tolist(), (same + r).tolist(), strict=True)
            p_end, r_end = p + n, r + n
        seen["inside"] = inside, [(p_end, r_end)]
    pairs += seen["inside"][0]
    ((p_end, r_end),) = seen["inside"][1]
    if ends:
        pairs += [(p_end + i, r_end + j) for i, j in _outward(a[p_end:], b[r_end:], far, seen, "back")]
    blocks: list[list[int]] = []
    for p, r in pairs:
        if blocks and p == blocks[-1][0] + blocks[-1][2] and r == blocks[-1][1] + blocks[-1][2]:
            blocks[-1][2] += 1
        else:
            blocks.append([p, r, 1])
    return [tuple(x) for x in blocks]


def enough_in_common(a: np.ndarray, b: np.ndarray, anchors: list[list[int]], least: float) -> bool:
    """Whether the two sides of some anchors have so many words in common within reach, in any order."""
    if sum(n for _, _, n in anchors) >= least:
        return True
    (u, v, _), (w, z, n) = anchors[0], anchors[-1]
    left, right = Counter(a[max(0, u - REACH) : w + n + REACH].tolist()), Counter(b[max(0, v - REACH) : z + n + REACH].tolist())
    return (left & right).total() >= least - 1e-9


Run = tuple[int, int, int, int, int]


def runs_of(blocks: list[Aligned], min_words: int, min_identity: float) -> list[Run]:
    """Runs of blocks: (start, end, other start, other end, words that agree).

    Blocks are cut where a hole is larger than MAX_HOLE. Of a stretch whose identity is too low the longest
    part that has it is a run, and so on with what is left on both sides.
    """
    todo, first = [], 0
    for k in range(1, len(blocks) + 1):
        p, r, n = blocks[k - 1]
        if k == len(blocks) or blocks[k][0] - p - n > MAX_HOLE or blocks[k][1] - r - n > MAX_HOLE:
            todo.append((first, k))
            first = k
    x = np.array(blocks, dtype=np.int64).reshape(-1, 3)
    start, end, same = x[:, :2], x[:, :2] + x[:, 2:], np.concatenate([[0], np.cumsum(x[:, 2])])
    out: list[Run] = []
    while todo:
        lo, hi = todo.pop()
        if lo >= hi or end[hi - 1, 0] - start[lo, 0] < min_words:
            continue
        best = (0, lo, hi)
        if same[hi] - same[lo] >= min_identity * (end[hi - 1] - start[lo]).max() - 1e-9:
            best = (1, lo, hi)
        else:
            for i in range(lo, hi):
                if end[hi - 1, 0] - start[i, 0] < max(min_words, best[0] + 1):
                    break
                long = end[i:hi] - start[i]
                fit = np.flatnonzero((long[:, 0] >= min_words) & (same[i + 1 : hi + 1] - same[i] >= min_identity * long.max(axis=1) - 1e-9))
                if len(fit) and long[fit[-1], 0] > best[0]:
                    best = (int(long[fit[-1], 0]), i, i + int(fit[-1]) + 1)
        n, i, j = best
        if n:
            out.append((int(start[i, 0]), int(end[j - 1, 0]), int(start[i, 1]), int(end[j - 1, 1]), int(same[j] - same[i])))
            todo += [(lo, i), (j, hi)]
    return sorted(out)


def align(a: np.ndarray, b: np.ndarray, anchors: list[list[int]], starts: bool, ends: bool) -> list[Run]:
    """Runs of aligned words, whatever their length and identity."""
    return runs_of(aligned_blocks(a, b, anchors, starts, ends), 1, 0.0)


def tiles(blocks_: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, tile, rep_id, rep_version, codes: the wanted tiles of TILE words. wanted: rep, tile, no repeats."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for x in left.to_pylist() if right.num_rows else []:
            block = Block(x)
            for rep, tile in zip(right.column("rep").to_pylist(), right.column("tile").to_pylist(), strict=True):
                i = rep - block.first_row
                a, n = int(block.starts[i]) + tile * TILE, int(block.lengths[i]) - tile * TILE
                if n > 0:
                    out.append((rep, tile, block.doc_ids[i], block.versions[i], block.codes[a : a + min(n, TILE)].tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table({n: pa.array(c, type=t) for n, c, t in zip(("rep", "tile", "rep_id", "rep_version", "codes"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)})

    of = wanted.select(F.floor(F.col("rep") / BLOCK_DOCS).cast("long").alias("block"), "rep", "tile")
    return blocks_.groupBy("block").cogroup(of.groupBy("block")).applyInArrow(run, "rep long, tile int, rep_id long, rep_version long, codes binary")


BLOCKS_SCHEMA = "doc long, rep long, number int, doc_id long, version long, rep_id long, rep_version long, blocks array<int>"
_IDS = ["doc_id", "version", "rep_id", "rep_version"]
RUN_SCHEMA = "doc_id long, version long, rep_id long, rep_version long, start int, end int, rep_start int, rep_end int, same int"
_RUN_TYPES = (*[pa.int64()] * 4, *[pa.int32()] * 5)
_RUN_NAMES = [*_IDS, "start", "end", "rep_start", "rep_end", "same"]


def aligned_pieces(blocks_: DataFrame, pieces: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """Aligned blocks of each piece, in word places of the two documents: place, other place, words of each.

    A group with no other around needs min_identity * min_words words within reach that both sides hold,
    in any order; another one three quarters of that. One that makes no passage is followed outward beyond its best score.
    """
    spans = pieces.select("doc", "rep", "number", F.explode(F.sequence(F.floor(F.col("r_lo") / TILE).cast("int"), F.floor(F.col("r_hi") / TILE).cast("int"))).alias("tile"))
    words = tiles(blocks_, spans.select("rep", "tile").distinct())
    got = spans.join(words, ["rep", "tile"]).groupBy("doc", "rep", "number").agg(F.first("rep_id").alias("rep_id"), F.first("rep_version").alias("rep_version"), F.collect_list(F.struct("tile", F.col("codes").alias("words"))).alias("tiles"))
    whole = pieces.join(got, ["doc", "rep", "number"]).select("doc", "rep", "number", *_IDS, "anchors", "p_lo", "codes", "tiles")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for x in batch.to_pylist():
            p, a = x["p_lo"], np.frombuffer(x["codes"], dtype="<u4")
            held = sorted((t["tile"], t["words"]) for t in x["tiles"])
            r, b = held[0][0] * TILE, np.frombuffer(b"".join(w for _, w in held), dtype="<u4")
            found = np.frombuffer(x["anchors"], dtype="<i4").reshape(-1, 5).tolist()
            for number, group in itertools.groupby(found, key=lambda y: y[3]):
                group = list(group)
                anchors, is_ = [[u - p, v - r, n] for u, v, n, _, _ in group], group[0][4]
                # min_words words around an anchor lie within reach; what continues a neighbour may have fewer of its own
                if not enough_in_common(a, b, anchors, min_identity * min_words * (1 if is_ & ALONE else 0.75)):
                    continue
                seen: dict = {}
                blocks = aligned_blocks(a, b, anchors, bool(is_ & STARTS), bool(is_ & ENDS), False, seen)
                if not runs_of(blocks, min_words, min_identity):
                    blocks = aligned_blocks(a, b, anchors, bool(is_ & STARTS), bool(is_ & ENDS), True, seen)
                out.append((x["doc"], x["rep"], number, *(x[c] for c in _IDS), [c for u, w, n in blocks for c in (u + p, w + r, n)]))
        if not out:
            return None
        types = (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc", "rep", "number", *_IDS, "blocks"])

    return arrow_map(whole, run, BLOCKS_SCHEMA)


def joined_blocks(pieces: list[list[Aligned]]) -> list[list[Aligned]]:
    """Pieces of one pair of documents that continue each other, or overlap on a diagonal, become one."""
    out: list[list[Aligned]] = []
    for piece in sorted(x for x in pieces if x):
        if out:
            p, r, n = out[-1][-1]
            rest = [b for b in piece if b[0] + b[2] > p + n]
            if not rest and len(piece) == 1 and piece[0][0] - piece[0][1] == p - r and piece[0][0] >= p:
                continue
            if rest:
                u, v, m = rest[0]
                skip = max(0, p + n - u) if u - v == p - r else 0
                if (skip or len(rest) == len(piece)) and u + skip >= p + n and v + skip >= r + n and max(u - p, v - r) + skip - n <= MAX_HOLE:
                    out[-1] += [(u + skip, v + skip, m - skip), *rest[1:]]
                    continue
        out.append(list(piece))
    return out


def fewest(runs: list[Run]) -> list[Run]:
    """As few of one pair's runs as cover the words that all cover."""
    out: list[Run] = []
    for x in sorted(runs, key=lambda x: (x[0], -x[1])):
        if out and x[1] <= out[-1][1]:
            continue
        if len(out) > 1 and x[0] <= out[-2][1]:
            out.pop()
        out.append(x)
    return out


def joined_runs(pieces: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """Runs of the joined pieces of each pair of documents."""
    dealt = pieces.repartition("doc").sortWithinPartitions("doc", "rep", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "doc"):
            out: list[tuple] = []
            rows = zip(*(table.column(c).to_pylist() for c in ("doc", "rep", *_IDS, "blocks")), strict=True)
            for pair, own in itertools.groupby(rows, key=lambda x: x[:6]):
                pieces_ = [list(zip(x[6][::3], x[6][1::3], x[6][2::3], strict=True)) for x in own]
                found = [x for blocks in joined_blocks(pieces_) for x in runs_of(blocks, min_words, min_identity)]
                out.extend((*pair[2:], *x) for x in fewest(found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), _RUN_TYPES, strict=True)], names=_RUN_NAMES)

    return dealt.mapInArrow(run, RUN_SCHEMA)


def repeated_passages(docs: DataFrame, min_words: int = 50, min_identity: float = 0.8) -> DataFrame:
    """doc_id, version, start_word, end_word, n_words, rep_doc_id, rep_version, rep_start_word, rep_end_word, n_same, identity."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = stored(blocks(docs.select("doc_id", "text"), min_words), "blocks")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = slot_count(int(held.agg(F.sum("words")).first()[0] or 0), parts)
    replies = [stored(first_holders(short_entries(held, K, slots, turn), K, parts), "replies") for turn in range(TURNS)]
    short = replies[0]
    for more in replies[1:]:
        short = short.union(more)
    lengths = long_lengths(min_words)
    replies.append(stored(first_holders(long_entries(held, short, slots, lengths), LONG, parts), "replies"))
    pieces = stored(chains(held, short.union(replies[-1]), slots, lengths, least_shared(min_words, min_identity)), "chains")
    for x in replies:
        discard(x)
    runs = joined_runs(aligned_pieces(held, pieces, min_words, min_identity), min_words, min_identity)
    runs = runs.where("doc_id <> rep_id OR version <> rep_version").distinct()
    n, longest = F.col("end") - F.col("start"), F.greatest(F.col("end") - F.col("start"), F.col("rep_end") - F.col("rep_start"))
    found = runs.select(
        "doc_id", "version", F.col("start").alias("start_word"), F.col("end").alias("end_word"), n.alias("n_words"),
        F.col("rep_id").alias("rep_doc_id"), "rep_version", F.col("rep_start").alias("rep_start_word"), F.col("rep_end").alias("rep_end_word"),
        F.col("same").alias("n_same"), F.round(F.col("same") / longest, 4).alias("identity"),
    )
    out = stored(found, "passages")
    discard(held)
    discard(pieces)
    return out


_WORD_BYTES = re.compile(WORD.encode())


def without_words(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without some spans of words; the white space before a removed word goes with it."""
    drop = sorted(spans)
    keep, at, i = [], 0, 0
    for n, word in enumerate(_WORD_BYTES.finditer(body)):
        while i < len(drop) and drop[i][1] <= n:
            i += 1
        if i < len(drop) and drop[i][0] <= n:
            at = word.end()
        else:
            keep.append(body[at : word.end()])
            at = word.end()
    return b"".join([*keep, body[at:]])


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs without their repeated passages; documents left without a word go.

    A passage is cut from the rows that have its doc_id and its text.
    """
    names = docs.columns
    key, text, cut, body = (fresh(docs, n) for n in ("cut_id", "cut_version", "cut_spans", "cut_body"))
    spans = passages.groupBy(F.col("doc_id").alias(key), F.col("version").alias(text)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(cut))
    rows = docs.join(spans.hint("shuffle_hash"), (F.col("doc_id") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text)), "left")
    whole = rows.where(F.col(cut).isNull()).select(*[F.col(f"`{c}`") for c in names])
    hit = rows.where(F.col(cut).isNotNull()).withColumn(body, text_bytes())
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = {c: i for i, c in enumerate(batch.schema.names)}
        spans_ = [[(s["start_word"], s["end_word"]) for s in x] for x in batch.column(at[cut]).to_pylist()]
        texts = [without_words(b, s).decode("utf-8", "replace") for b, s in zip(batch.column(at[body]).to_pylist(), spans_, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(at[f.name]) for f in others), pa.array(texts, type=pa.string())], names=[*(f.name for f in others), "text"])

    schema = StructType([*others, StructField("text", StringType())])
    done = arrow_map(hit.select(*[F.col(f"`{f.name}`") for f in others], cut, body), run, schema)
    done = done.where(F.col("text").rlike(WORD))
    return whole.unionByName(done.select(*[F.col(f"`{c}`") for c in names]))
