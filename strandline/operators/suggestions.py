"""Proactive suggestions: what a session's last questions ask for, found in the keyword index, scored and filtered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.functions import scores as X
from strandline.functions.text import tokens
from strandline.operators.keyword_index import Version
from strandline.operators.sessions import last_of_each
from strandline.session import stored

#: Rows by id that the first round looks at, how many times as many each later one ends at, and rows of one range at most, about.
FIRST_ROWS, ROUND_FACTOR, RANGE_ROWS = 2_000, 8, 32_768
#: Sessions that meet a range in one task, and entries of lists that they look at in one step.
BLOCK_SESSIONS, BROUGHT = 1 << 18, 1 << 21
#: Similarities have nine digits.
DIGITS = 1e9


def session_interest(log: DataFrame, frequencies: DataFrame, session: str = "session_id", at: str = "at", text: str = "text", recent: int = 5, keywords: int = 3, least_length: int = 4) -> tuple[DataFrame, DataFrame]:
    """(session, intent, confidence) and (session, term, df, idf): from a session's last questions, its rarest terms that the index holds.

    frequencies: term, df, idf. A session is never held whole: recent questions of each.
    """
    last = last_of_each(log.select(session, at, text), session, at, recent, text)
    asked = last.groupBy(session).agg(F.collect_list(text).alias("t")).select(session, X.intent(F.col("t")).alias("i"))  # recent texts
    terms = last.select(session, F.explode(tokens(F.col(text))).alias("term")).where(F.length("term") >= least_length).distinct()
    place = F.row_number().over(Window.partitionBy(session).orderBy("df", "term"))
    rare = terms.join(frequencies, "term").withColumn("place", place).where(F.col("place") <= keywords)
    return asked.select(session, "i.intent", F.col("i.confidence").alias("intent_confidence")), rare.select(session, "term", "df", "idf")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, one behind the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _rounds(n_docs: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Where ranges of rows end, by their place in the order of ids (the last end left out), and the first and last range of each round."""
    ends, rounds, before, upto = [], [], 0, FIRST_ROWS
    while before < n_docs or not rounds:
        upto = min(upto, n_docs)
        n = max(1, -(-(upto - before) // RANGE_ROWS))
        rounds.append((len(ends), len(ends) + n - 1))
        ends += [before + (upto - before) * (i + 1) // n for i in range(n)]
        before, upto = upto, upto * ROUND_FACTOR
    return ends[:-1], rounds


def _lists(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """r (range of ids), block, term, ids: each batch's lists, cut at the ranges' ends. rows: block, term, ids."""
    ends = np.array(cuts, np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["ids"].value_lengths().to_numpy(zero_copy_only=False)
            ids = batch["ids"].flatten().to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            coded = batch["term"].dictionary_encode()
            block, term = np.repeat(batch["block"].to_numpy(zero_copy_only=False), n), np.repeat(coded.indices.to_numpy(zero_copy_only=False), n)
            r = np.searchsorted(ends, ids, side="right")
            order = np.lexsort((ids, term, block, r))
            ids, term, block, r = ids[order], term[order], block[order], r[order]
            first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (block[1:] != block[:-1]) | (term[1:] != term[:-1])]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(r[first].astype(np.int32)), pa.array(block[first].astype(np.int32)), coded.dictionary.take(pa.array(term[first])), lists], ["r", "block", "term", "ids"])

    return rows.select("block", "term", F.col("ids").cast("array<long>").alias("ids")).mapInArrow(cut, "r int, block int, term string, ids array<long>")


def _best_here(lists: pa.Table, sessions: pa.Table, most: int) -> pa.Table:
    """session, id, similarity: the best rows of each session in a range of ids, better than what it has. lists: term, ids; sessions: session, terms, idfs, least.

    A session's most frequent terms that don't reach its least similarity by themselves bring no row; they are only looked up for rows of the others.
    """
    terms = pa.chunked_array([*lists.column("term").chunks, *[c.flatten() for c in sessions.column("terms").chunks]]).dictionary_encode().unify_dictionaries()
    codes = np.concatenate([c.indices.to_numpy() for c in terms.chunks]).astype(np.int64)
    length = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in lists.column("ids").chunks])
    id_, place = np.unique(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.column("ids").chunks]), return_inverse=True)
    held = np.sort(np.repeat(codes[: len(lists)], length) * len(id_) + place)  # a number for each term and row
    codes = codes[len(lists) :]
    n = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in sessions.column("terms").chunks]).astype(np.int64)
    idf = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in sessions.column("idfs").chunks])
    begins, session = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    whole = np.add.reduceat(idf, begins)
    least = np.rint(sessions.column("least").fill_null(-1.0).to_numpy() * DIGITS)
    order = np.lexsort((idf, session))
    upto = np.cumsum(idf[order])
    upto -= np.repeat(upto[begins] - idf[order][begins], n)
    brings = np.empty(len(idf), bool)
    brings[order] = np.floor(upto / whole[session] * DIGITS + 0.501) > least[session]
    start = np.searchsorted(held, codes * len(id_))
    often = np.where(brings, np.searchsorted(held, (codes + 1) * len(id_)) - start, 0)
    total = np.concatenate([[0], np.cumsum(often)])[np.append(begins, len(idf))]  # what the sessions before bring
    out: list[tuple[np.ndarray, ...]] = []
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, total[first] + BROUGHT, side="right")) - 1)
        of = slice(int(begins[first]), int(begins[last - 1] + n[last - 1]))
        at = np.unique(np.repeat(session[of], often[of]) * len(id_) + held[_ranges(start[of], often[of])] % len(id_))
        s, row = np.divmod(at, len(id_))
        similarity = np.zeros(len(at))
        for j in range(int(n[first:last].max())) if len(at) else []:
            has = j < n[s]
            entry = begins[s] + np.where(has, j, 0)
            key = codes[entry] * len(id_) + row
            similarity += np.where(has & (held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key), idf[entry], 0.0)
        scaled = np.floor(similarity / whole[s] * DIGITS + 0.5)
        better = np.flatnonzero(scaled > least[s])
        better = better[np.lexsort((row[better], -scaled[better], s[better]))]
        mine = s[better]
        better = better[np.arange(len(mine)) - np.searchsorted(mine, mine) < most]
        out.append((s[better], id_[row[better]], scaled[better] / DIGITS))
        first = last
    s, ids, similarity = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"session": sessions.column("session").take(pa.array(s)), "id": ids, "similarity": similarity})


def _all_candidates(now: Version, interest: DataFrame, session: str, most: int) -> DataFrame:
    lists = now.postings.join(interest.select("term").distinct(), "term", "left_semi")
    rows = now.live(lists.select("segment", "term", F.explode("ids").alias("id"))).select("term", "id")
    whole = interest.groupBy(session).agg(F.sum("idf").alias("whole"))
    held = rows.join(interest, "term").groupBy(session, "id").agg(F.sum("idf").alias("held")).join(whole, session)
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.col("similarity").desc(), "id"))
    return held.select(session, "id", X.rounded(F.col("held") / F.col("whole"), 9).alias("similarity")).withColumn("place", place).where(F.col("place") <= most).drop("place")


def candidates(spark: SparkSession, path: str, interest: DataFrame, session: str = "session_id", most: int = 20) -> DataFrame:
    """session, id, similarity: the share of its terms' idf that a row holds; the best rows of each session, ties to the smaller id.

    Lists of the asked terms alone are read, and cut into ranges of ids. Rows go by id in rounds, each over many times the rows of those before: a
    later row must be better than all that a session has, so of frequent terms hardly more than the first round's rows are looked at. Ids that
    aren't whole numbers can't be cut so: then all lists are joined with all sessions.
    """
    now = Version(spark, path)
    if now.kind not in ("bigint", "int", "smallint", "tinyint", "long"):
        return _all_candidates(now, interest, session, most)
    kind = interest.schema[session].dataType.simpleString()
    asking = interest.where(F.col(session).isNotNull()).groupBy(F.col(session).alias("session")).agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t"))  # a session's few terms
    asking = stored(asking.select("session", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs")), "asking")
    blocks = max(1, -(-asking.count() // BLOCK_SESSIONS))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("session"), F.lit(blocks)).cast("int"))
    ends, rounds = _rounds(now.row["n_docs"])
    cuts = now.forward.agg(F.percentile_approx("id", [x / now.row["n_docs"] for x in ends], 10_000)).first()[0] if ends else []
    rows = now.postings.join(asking.select("block", F.explode("terms").alias("term")).distinct(), "term")
    if now.row["dead_segments"]:
        rows = now.live(rows.select("segment", "block", "term", F.explode("ids").alias("id"))).select("block", "term", F.array("id").alias("ids"))
    lists = stored(_lists(rows, cuts or []), "asked-lists")
    empty = pa.table({"session": pa.array([], to_arrow_type(asking.schema["session"].dataType)), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
    here = lambda found, sessions: _best_here(found, sessions, most) if len(found) and len(sessions) else empty
    best = None
    for first, last in rounds:
        open_ = asking.withColumn("least", F.lit(None).cast("double"))
        if best is not None:
            least = best.groupBy("session").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == most).drop("n")
            open_ = asking.join(least, "session", "left").where("least IS NULL OR least < 1")
        asked = open_.withColumn("r", F.explode(F.sequence(F.lit(first), F.lit(last))))
        found = lists.where(F.col("r").between(first, last)).groupBy("r", "block").cogroup(asked.groupBy("r", "block")).applyInArrow(here, f"session {kind}, id long, similarity double")
        place = F.row_number().over(Window.partitionBy("session").orderBy(F.col("similarity").desc(), "id"))
        every = found if best is None else best.union(found)
        best = stored(every.withColumn("place", place).where(F.col("place") <= most).drop("place"), "best-rows")
    return best.select(F.col("session").alias(session), F.col("id").cast(now.kind).alias("id"), "similarity")


def suggested(found: DataFrame, rows: DataFrame, shown: DataFrame, age_days: Column, threshold: float = 0.5, most: int = 5, session: str = "session_id") -> DataFrame:
    """session, id, confidence, place: candidates that weren't shown, of enough confidence, best first.

    rows: id, importance, verified and what age_days needs; shown: session, id.
    """
    scored = found.join(rows, "id").join(shown.select(session, "id"), [session, "id"], "left_anti")
    confidence = X.suggestion_confidence(F.col("similarity"), X.stepped_recency(age_days), F.col("importance"), F.col("verified").cast("int"))
    scored = scored.withColumn("confidence", X.rounded(confidence, 9)).where(F.col("confidence") >= threshold)
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.col("confidence").desc(), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= most).select(session, "id", "confidence", "place")
