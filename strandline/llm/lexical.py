"""Operator 11: ranked lexical search by Block-Max WAND over a stored, document-partitioned index.

Each task packs the documents it reads into shards of bounded size and inverts them: a term's postings ascend by
document and are cut into blocks of a fixed number. A block stores its first and last document, the gaps between documents
and the frequencies in as few bytes as they need, and the largest impact (the part of the score without the term's
weight) of its postings. No text is shuffled, and a term that all documents hold is a list in every shard.

A search reads the blocks of its items' terms, grouped by shard. In a shard, an item's lists cut the documents into stretches in
which no list changes its block. What a stretch can score at most is the sum of the weighted maxima of the blocks that
reach into it: shallow moves of all lists over their blocks' heads, without looking into a block. Stretches are
visited from the highest such bound down; those below the threshold, the score of the item's last place so far, are skipped, and
a block is decompressed only if a visited stretch needs it. A threshold is a lower bound of the final one
whatever documents it comes from, so a part of the shards is searched first, and the others start from its thresholds.

Items go in groups of bounded numbers of terms, whose weights are sent to all tasks.

Defined results: a null or empty text, or one without terms, is no document of the ranking and isn't counted; an item without
terms has no rows; of repeated item_ids all terms together are one item (null is one, too); repeated documents each have their
rank; a null doc_id is a document that comes last among equal scores; empty tables give no rows; further columns are not read.
A text goes to a task whole, with some 50 bytes a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import arrow_map, bounded_batches, discard, doc_bytes, stored
from strandline.llm.terms import batch_terms, term_counts

#: Postings of one block; documents and terms (with repeats) of one shard.
BLOCK = 64
SHARD_DOCS, SHARD_TERMS = 1 << 16, 3_000_000
#: Rows (item, term) of one group of items.
GROUP_TERMS = 200_000
#: One shard in so many is searched first.
PROBE = 16
INDEX_SCHEMA = "shard long, term binary, first int, last int, n int, top long, docs binary, tfs binary"
INDEX_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("n", pa.int32()), ("top", pa.int64()), ("docs", pa.binary()), ("tfs", pa.binary())])
#: The row of a shard that lists its documents: their ids, null ones last and counted in top, and lengths. No term is empty.
DOCS_ROW = b""


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, without its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_norm(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    return 50 + (50 * n * docs) // max(1, terms)


def packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of numbers (each starts where starts says) as bytes: 1, 2 or 4 for each number of a run."""
    sizes = np.diff(np.append(starts, len(values)))
    most = np.maximum.reduceat(values, starts) if len(starts) else np.zeros(0, dtype=np.int64)
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    each = np.repeat(width, sizes)
    at = np.cumsum(each) - each
    data = np.zeros(int(each.sum()), dtype=np.uint8)
    for byte in range(4):
        has = each > byte
        data[at[has] + byte] = (values[has] >> (8 * byte)) & 255
    offsets = np.concatenate([[0], np.cumsum(width * sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // n}").astype(np.int64)


class Shard:
    """Documents that are inverted together."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.terms: list[pa.Array] = []
        self.docs = self.size = 0

    def add(self, ids: pa.Array, counts: np.ndarray, terms: pa.Array) -> None:
        self.ids.append(ids)
        self.counts.append(counts)
        self.terms.append(terms.dictionary_encode())
        self.docs += len(ids)
        self.size += len(terms)

    def rows(self, number: int, corpus: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        """The shard's rows of the index, terms in order. corpus: documents and terms of all."""
        coded = pa.chunked_array(self.terms).unify_dictionaries()
        distinct = coded.chunk(0).dictionary
        codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
        counts = np.concatenate(self.counts).astype(np.int64)
        ids = pa.concat_arrays(self.ids)
        has = counts > 0
        ids, counts = ids.filter(pa.array(has)), counts[has]
        if not len(counts):
            return
        by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy().astype(np.int64)
        place = np.empty(len(by_id), dtype=np.int64)
        place[by_id] = np.arange(len(by_id))
        by_term = pc.sort_indices(distinct).to_numpy().astype(np.int64)
        rank = np.empty(len(by_term), dtype=np.int64)
        rank[by_term] = np.arange(len(by_term))
        pairs, tf = np.unique(rank[codes] * len(counts) + np.repeat(place, counts), return_counts=True)
        term, doc = np.divmod(pairs, len(counts))
        new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        within = np.arange(len(term)) - np.repeat(new, np.diff(np.append(new, len(term))))
        starts = np.flatnonzero(within % BLOCK == 0)
        sizes = np.diff(np.append(starts, len(term)))
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = 0
        lengths = counts[by_id]
        top = np.maximum.reduceat(impact(tf, length_norm(lengths, *corpus)[doc]), starts)
        docs, tfs = packed(gaps, starts), packed(tf, starts)
        names = distinct.take(pa.array(by_term[term[starts]]))
        sorted_ids = pc.fill_null(ids, 0).to_numpy()[by_id]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(([number], [DOCS_ROW], [0], [len(counts) - 1], [len(counts)], [ids.null_count], [sorted_ids.astype("<i8").tobytes()], [lengths.astype("<i8").tobytes()]), INDEX_ARROW, strict=True)], schema=INDEX_ARROW)
        columns = [pa.array(np.full(len(starts), number)), names, pa.array(doc[starts].astype(np.int32)), pa.array(doc[starts + sizes - 1].astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(top), docs, tfs]
        table = pa.Table.from_arrays(columns, schema=INDEX_ARROW)
        yield from table.to_batches(max_chunksize=1 << 14)


def corpus_figures(docs: DataFrame) -> tuple[int, int]:
    """How many documents hold a term, and how many terms with repeats all hold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = term_counts(batch.column("body"))
        return pa.RecordBatch.from_arrays([pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())])], names=["docs", "terms"])

    row = arrow_map(doc_bytes(docs).select("body"), run, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def lexical_index(docs: DataFrame, corpus: tuple[int, int] | None = None) -> DataFrame:
    """The index of docs, as a stored table of blocks and of one row of documents a shard."""
    corpus = corpus or corpus_figures(docs)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, counts = batch_terms(batch.column("body"))
            if shard.docs and (shard.docs + len(counts) > SHARD_DOCS or shard.size + len(terms) > SHARD_TERMS):
                yield from shard.rows(number, corpus)
                number, shard = number + 1, Shard()
            shard.add(batch.column("doc_id"), counts, terms)
        if shard.docs:
            yield from shard.rows(number, corpus)

    return stored(doc_bytes(docs).mapInArrow(run, INDEX_SCHEMA), "lexical-index")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each. items: item_id, text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, counts = batch_terms(batch.column("body"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(counts)), counts))), terms], names=["item_id", "term"])

    return arrow_map(doc_bytes(items.select(F.col("item_id").alias("doc_id"), "text")), run, "item_id long, term binary").distinct()


class Lists:
    """The blocks of a shard that a group of items asks for."""

    def __init__(self, table: pa.Table, corpus: tuple[int, int]):
        table = table.combine_chunks()
        term = table.column("term")
        whole = table.filter(pc.equal(term, DOCS_ROW))
        self.nulls = whole.column("top")[0].as_py()
        self.ids = np.frombuffer(whole.column("docs")[0].as_py(), dtype="<i8")
        self.norm = length_norm(np.frombuffer(whole.column("tfs")[0].as_py(), dtype="<i8"), *corpus)
        rest = table.filter(pc.not_equal(term, DOCS_ROW)).sort_by([("term", "ascending"), ("first", "ascending")])
        self.first, self.end, self.n, self.top = (rest.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "n", "top"))
        self.end = self.end + 1
        self.docs, self.tfs = rest.column("docs"), rest.column("tfs")
        coded = rest.column("term").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.unify_dictionaries().combine_chunks()
        edges = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1, append=-2)) if len(coded) else np.zeros(0, dtype=np.int64)
        self.of = {t: (a, b) for t, a, b in zip(coded.dictionary.to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)}
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block, decompressed once."""
        if (known := self.open.get(i)) is None:
            n = int(self.n[i])
            docs = np.cumsum(unpacked(self.docs[i].as_py(), n)) + self.first[i]
            known = self.open[i] = docs, impact(unpacked(self.tfs[i].as_py(), n), self.norm[docs])
        return known

    def best(self, terms: list[tuple[bytes, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the k best documents that score at least so much, highest first, equal ones by place."""
        held = [(*self.of[t], w) for t, w in terms if w > 0 and t in self.of]
        none = np.zeros(0, dtype=np.int64)
        if not held:
            return none, none
        rows = np.concatenate([np.arange(a, b) for a, b, _ in held])
        weight = np.concatenate([np.full(b - a, w) for a, b, w in held])
        cuts = np.unique(np.concatenate([self.first[rows], self.end[rows]]))
        begin, end = np.searchsorted(cuts, self.first[rows]), np.searchsorted(cuts, self.end[rows])
        change = np.zeros(len(cuts), dtype=np.int64)
        np.add.at(change, begin, weight * self.top[rows])
        np.subtract.at(change, end, weight * self.top[rows])
        bound = np.cumsum(change)[:-1]
        order = np.argsort(-bound, kind="stable")
        scores, places, at, step = none, none, 0, 16
        least = max(1, least)
        while at < len(order) and bound[order[at]] >= least:
            now = order[at : at + step]
            now = now[bound[now] >= least]
            at, step = at + step, 2 * step
            visited = np.zeros(len(cuts), dtype=bool)
            visited[now] = True
            before = np.concatenate([[0], np.cumsum(visited)])
            needed = np.flatnonzero(before[end] > before[begin])
            blocks = [self.block(i) for i in rows[needed].tolist()]
            docs = np.concatenate([d for d, _ in blocks])
            gain = np.concatenate([x for _, x in blocks]) * np.repeat(weight[needed], [len(d) for d, _ in blocks])
            here = visited[np.searchsorted(cuts, docs, side="right") - 1]
            found, which = np.unique(docs[here], return_inverse=True)
            total = np.zeros(len(found), dtype=np.int64)
            np.add.at(total, which, gain[here])
            good = total >= least
            scores, places = np.concatenate([scores, total[good]]), np.concatenate([places, found[good]])
            first = np.lexsort((places, -scores))[:k]
            scores, places = scores[first], places[first]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
        return scores, places


def _searched(index: DataFrame, wanted: dict, least: dict, k: int, corpus: tuple[int, int]) -> DataFrame:
    """item_id, doc_id, score: each shard's best for each item. wanted: terms and weights by item; index: the blocks of these terms."""
    sent = index.sparkSession.sparkContext.broadcast((wanted, least))

    def run(table: pa.Table) -> pa.Table:
        lists = Lists(table, corpus)
        items: list[int | None] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for item, terms in sent.value[0].items():
            got = lists.best(terms, k, sent.value[1].get(item, 0))
            found.append(got)
            items += [item] * len(got[0])
        scores, places = (np.concatenate([np.zeros(0, dtype=np.int64), *c]) for c in (zip(*found, strict=True) if found else ((), ())))
        ids = pa.array(lists.ids[places], mask=places >= len(lists.ids) - lists.nulls)
        return pa.table([pa.array(items, type=pa.int64()), ids, pa.array(scores)], names=["item_id", "doc_id", "score"])

    return index.groupBy("shard").applyInArrow(run, "item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, corpus: tuple[int, int], k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents. index: of lexical_index(); items: item_id, text."""
    wanted = stored(item_terms(items), "item-terms")
    groups = max(1, -(-wanted.count() // GROUP_TERMS))
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    results = []
    for group in range(groups):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group)
        terms = F.broadcast(own.select("term").distinct())  # GROUP_TERMS on average
        df = index.join(terms, "term").groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * F.lit(corpus[0]) + 2) / (2.0 * F.col("df") + 1))).cast("long")
        by_item: dict = {}
        for item, term, w in own.join(df, "term").select("item_id", "term", weight).collect():
            by_item.setdefault(item, []).append((bytes(term), w))
        blocks = index.join(terms.union(index.sparkSession.createDataFrame([(DOCS_ROW,)], "term binary")).hint("broadcast"), "term", "left_semi")
        early = F.pmod(F.xxhash64("shard"), F.lit(PROBE)) == 0
        probe = stored(_searched(blocks.where(early), by_item, {}, k, corpus), "probe")
        placed = probe.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        least = {r[0]: r[1] for r in placed.where(F.col("rank") == k).select("item_id", "score").collect()}  # a number an item
        rest = _searched(blocks.where(~early), by_item, least, k, corpus)
        every = placed.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        results.append(stored(every.select("item_id", "rank", "doc_id", "score"), "ranked"))
        discard(probe)
    discard(wanted)
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score: indexes docs, searches every item, and discards the index."""
    corpus = corpus_figures(docs)
    index = lexical_index(docs, corpus)
    out = search(index, items, corpus, k)
    discard(index)
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
m AS (SELECT u, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0),
p AS (SELECT u, term, count(*) AS tf FROM (SELECT u, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY u, term),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT item_id, u, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN m USING (u) GROUP BY item_id, u),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s JOIN m USING (u) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
