"""Keyword and vector search, rank fusion and re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import ascii_bounds, query_tokens, tokens
from strandline.functions.vector import cosine, vector
from strandline.session import spread, stored

#: Parameters of BM25, its lower-bounded variant, and reciprocal rank fusion.
K1, B, DELTA, RRF_K = 1.5, 0.75, 1.0, 60


def _equals(term: str):
    return lambda x: x == term


def bm25_scores(docs: DataFrame, query: str, k1: float = K1, b: float = B, delta: float | None = None, text: str = "content", id_: str = "id") -> DataFrame:
    """id and `bm25` of every row, 0 for rows without a query term.

    One pass over the texts counts the query's terms and the length of each row, a few numbers a row that
    are written; figures of the corpus and scores come from these. The figures are a single row that is
    broadcast. A term that the query repeats counts as often. With delta every query term that the
    corpus holds adds idf * delta to every row, also where it doesn't occur.
    """
    terms = query_tokens(query)
    distinct = list(dict.fromkeys(terms))
    counted = spread(docs.select(id_, text)).select(id_, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("_tokens"))
    counted = counted.select(id_, F.size("_tokens").alias("_dl"), *[F.size(F.filter("_tokens", _equals(t))).alias(f"_tf{i}") for i, t in enumerate(distinct)])
    counted = stored(counted, "bm25-counts")
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avgdl"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(distinct))])
    joined = counted.crossJoin(F.broadcast(stats))  # one row of corpus figures
    score: Column = F.lit(0.0)
    for term in terms:
        i = distinct.index(term)
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1)
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_dl") / F.col("_avgdl")))
        part = F.when(tf > 0, part).otherwise(0.0)
        if delta is not None:
            part = part + F.when(df > 0, idf * delta).otherwise(0.0)
        score = score + part
    return joined.select(id_, score.alias("bm25"))


def top(df: DataFrame, score: str, k: int, id_: str = "id") -> DataFrame:
    """The k best rows; ties go to the smaller id. Each partition keeps k rows before they meet."""
    return df.orderBy(F.col(score).desc(), F.col(id_)).limit(k)


def vector_scores(rows: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """rows with `similarity`, the cosine with a query vector, computed in one scan."""
    return rows.withColumn("similarity", cosine(F.col(column), vector(query)))


def nearest(rows: DataFrame, k: int, block_rows: int = 4000, id_: str = "id", embedding: str = "embedding") -> DataFrame:
    """query, id, similarity: for each row the k others of greatest cosine, ties to the smaller id. Exact.

    Many searches in one job. Rows are dealt into blocks; a task multiplies one block of queries with one
    of targets and keeps k of each query, so memory is bounded and k rows a query and block are shuffled.
    """
    blocks = max(1, int(np.ceil(rows.count() / block_rows)))
    v = rows.select(F.col(id_).cast("long").alias("id"), F.col(embedding).alias("v"), F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = v.select("id", "v", F.lit(True).alias("asks"), F.col("block").alias("p"), every.alias("q")).union(v.select("id", "v", F.lit(False), every, F.col("block")))

    def search(table: pa.Table) -> pa.Table:
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        m = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
        order = np.argsort(ids[~asks], kind="stable")
        targets, t = m[~asks][order], ids[~asks][order]
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(0, int(asks.sum()) if len(t) else 0, 256):
            q = ids[asks][i : i + 256]
            s = m[asks][i : i + 256] @ targets.T
            s[q[:, None] == t[None, :]] = -np.inf
            # a row's k-th value bounds what is sorted; targets stand by id, so ties go to the smaller one
            least = np.partition(s, max(0, len(t) - k), axis=1)[:, max(0, len(t) - k)] if len(t) > k else np.full(len(q), -np.inf)
            row, at = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            found = s[row, at]
            order = np.lexsort((at, -found, row))
            row, at, found = row[order], at[order], found[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((q[row[keep]], t[at[keep]], found[keep]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query": cols[0], "id": cols[1], "similarity": cols[2]})

    found = dealt.groupBy("p", "q").applyInArrow(search, "query long, id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query", "id", "similarity")


def scaled(df: DataFrame, score: str, to: str, rows: int | None = None) -> DataFrame:
    """Min-max of a whole table by a broadcast row of its bounds: no single-task window.

    rows: how many rows the table has with those that df leaves out because they score 0.
    """
    lowest = F.min(score) if rows is None else F.when(F.count(F.lit(1)) < rows, F.least(F.min(score), F.lit(0.0))).otherwise(F.min(score))
    bounds = df.agg(lowest.alias("_lo"), F.max(score).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    value = F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).when(hi != 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(bounds)).withColumn(to, value).drop("_lo", "_hi")


def ranked(df: DataFrame, score: str, rank: str, k: int, id_: str = "id") -> DataFrame:
    """The k best rows with 0-based ranks; the window runs over k rows only."""
    w = Window.orderBy(F.col(score).desc(), F.col(id_))
    return top(df, score, k, id_).withColumn(rank, F.row_number().over(w) - 1)


def weighted_fusion(vectors: DataFrame, keywords: DataFrame, alpha: float, k: int, rows: int | None = None) -> DataFrame:
    """id, score: alpha * scaled similarity + (1 - alpha) * scaled BM25 over the union of ids.

    keywords are scaled over all rows, of which it may leave out those that score 0 (rows: how many there are), vectors over their list.
    """
    v = scaled(vectors.select("id", "similarity"), "similarity", "v")
    w = scaled(keywords.select("id", "bm25"), "bm25", "w", rows).where("bm25 > 0")
    both = v.join(w, "id", "full_outer")
    score = alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0))
    return top(both.select("id", score.alias("score"), F.coalesce("similarity", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25", F.lit(0.0)).alias("bm25_score")), "score", k)


def rrf_fusion(vectors: DataFrame, keywords: DataFrame, k: int, depth: int, rrf_k: int = RRF_K) -> DataFrame:
    """id, score and both ranks: the sum of 1 / (rrf_k + rank + 1) over the lists that hold an id."""
    v = ranked(vectors, "similarity", "rank_vector", depth).select("id", "rank_vector")
    w = ranked(keywords.where("bm25 > 0"), "bm25", "rank_bm25", depth).select("id", "rank_bm25")
    both = v.join(w, "id", "full_outer")
    part = lambda c: F.coalesce(1 / (rrf_k + F.col(c) + 1), F.lit(0.0))
    return top(both.withColumn("score", part("rank_vector") + part("rank_bm25")), "score", k)


def cascade_fusion(vectors: DataFrame, keywords: DataFrame, k: int) -> DataFrame:
    """id, tier, rank: the best keyword rows first, then vector rows that aren't among them."""
    w = ranked(keywords.where("bm25 > 0"), "bm25", "rank", k).select("id", F.lit(0).alias("tier"), "rank")
    v = ranked(vectors, "similarity", "rank", 2 * k).select("id", F.lit(1).alias("tier"), "rank")
    return w.unionByName(v.join(w.select("id"), "id", "left_anti")).orderBy("tier", "rank").limit(k)


# re-ranking signals


def age_seconds(since: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", since, now)


def recency(since: Column, now: Column, half_life_days: float = 7.0) -> Column:
    """Halves every half-life; at most 1."""
    return F.least(F.lit(1.0), F.pow(F.lit(0.5), age_seconds(since, now) / (86400.0 * half_life_days)))


def usage(count: Column, most: Column) -> Column:
    return F.when(most > 0, F.least(F.lit(1.0), F.log(count + 1) / F.log(most + 1))).otherwise(F.lit(0.0))


def length_penalty(text: Column, short: int = 100, long: int = 500, scale: int = 2000) -> Column:
    """0 between short and long, down to -0.5 outside."""
    n = F.length(text)
    return F.when(n < short, -F.least(F.lit(0.5), (short - n) / short)).when(n > long, -F.least(F.lit(0.5), (n - long) / scale)).otherwise(F.lit(0.0))


def keyword_boost(text: Column, query: str) -> Column:
    """The share of the query's words that stand in a text as whole words."""
    words = query_tokens(query)
    if not words:
        return F.lit(0.0)
    low = F.lower(text)
    hits = [F.when(low.rlike(ascii_bounds(rf"\b{w}\b")), 1).otherwise(0) for w in words]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total / len(words)


def multi_signal(similarity: Column, recent: Column, used: Column, penalty: Column | None = None, boost: Column | None = None) -> Column:
    """0.6 similarity, 0.2 recency, 0.2 usage, with a length penalty and a keyword boost of a tenth each."""
    score = 0.6 * similarity + 0.2 * recent + 0.2 * used
    if penalty is not None:
        score = score + 0.1 * penalty
    if boost is not None:
        score = score + 0.1 * boost
    return score


def composite_score(similarity: Column, since: Column, now: Column, count: Column, half_life_days: float = 7.0, most: int = 1000) -> Column:
    recent = F.pow(F.lit(2.0), -(age_seconds(since, now) / 3600.0) / (24 * half_life_days))
    used = F.least(F.lit(1.0), F.log(count + 1) / F.log(F.lit(most + 1)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * similarity + 0.2 * recent + 0.2 * used))


def _words(text: str) -> set[str]:
    return set(text.lower().split())


def _overlap(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def mmr(results: DataFrame, k: int, relevance: float = 0.7, group: str = "query") -> DataFrame:
    """Maximal marginal relevance within each query's results, which are a top-k list and thus few.

    Greedy: the next pick maximises relevance * score - (1 - relevance) * the largest word overlap with
    what is picked; ties go to the better score and then the smaller id.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        words = [_words(c or "") for c in rows["content"]]
        left, chosen, nearest = list(range(len(rows))), [], [0.0] * len(rows)
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (relevance * rows["score"][i] - (1 - relevance) * nearest[i], -i))
            chosen.append(best)
            left.remove(best)
            for i in left:
                nearest[i] = max(nearest[i], _overlap(words[i], words[best]))
        out = rows.loc[chosen, [group, "id", "score"]].copy()
        out["position"] = range(1, len(out) + 1)
        return out

    return results.select(group, "id", "score", "content").groupBy(group).applyInPandas(pick, f"{group} string, id long, score double, position long")


def diversified(results: DataFrame, penalty: float = 0.1, threshold: float = 0.8, head: int = 100, group: str = "query") -> DataFrame:
    """Lowers a result's score for each better one whose first characters share over threshold of the words."""

    def lower(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        kept: list[set[str]] = []
        scores = []
        for c, s in zip(rows["content"], rows["score"], strict=True):
            w = _words((c or "")[:head])
            scores.append(s - penalty * any(_overlap(w, x) > threshold for x in kept))
            kept.append(w)
        return rows[[group, "id"]].assign(score=scores)

    return results.select(group, "id", "score", "content").groupBy(group).applyInPandas(lower, f"{group} string, id long, score double")


def rescored(results: DataFrame, scorer, columns: list[str]) -> DataFrame:
    """A caller's function over pandas Series gives new scores, a batch at a time."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            yield scorer(*parts)

    return results.withColumn("score", run(*[F.col(c) for c in columns]))
