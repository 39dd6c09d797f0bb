"""Queries over keyword search, vector search, fusion and re-ranking."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.functions.vector import l2_normalized
from strandline.operators import search as S
from strandline.operators import dictionaries as Y
from strandline.operators import keyword_index as N
from strandline.operators.vector_index import index_lists, nearest_in_index, write_vector_index
from strandline.plans.registry import query
from strandline.session import scratch_path, scratch_root, stored
from strandline.sources.tables import AS_OF, LOG_SQL, MEM_SQL, as_of, memories, query_log, table

QUERY = "the error of token handling"
TERMS = ["the", "error", "of", "token", "handling"]

TOK_SQL = """tok AS (SELECT id, list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda x: length(x) >= 2) AS t FROM mem),
q AS (SELECT unnest(['the','error','of','token','handling']) AS term),
post AS (SELECT id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, (SELECT DISTINCT term FROM q)),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM post GROUP BY term),
idf AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, st),
kw AS (SELECT p.id, sum(CASE WHEN tf > 0 THEN idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) ELSE 0 END)::DOUBLE AS bm25,
 sum(CASE WHEN df > 0 THEN idf ELSE 0 END)::DOUBLE AS plus FROM q JOIN post p USING (term) JOIN idf USING (term), st GROUP BY p.id)"""
VEC_SQL = """qv AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
vec AS (SELECT vec_id AS id, label, coalesce(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / nullif(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])), 0), 0) AS similarity FROM embeddings, qv)"""
WITH_KW = f"WITH {MEM_SQL}, {TOK_SQL}"
WITH_BOTH = f"WITH {MEM_SQL}, {TOK_SQL}, {VEC_SQL}, vtop AS (SELECT * FROM vec ORDER BY similarity DESC, id LIMIT 50)"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id as id, embedding and label; the query vector is that of id 0."""
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector of id 0: one row, found by a filter that reaches the scan."""
    return _vectors(spark, sf).where("id = 0").select("embedding").first()[0]


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    return S.vector_scores(_vectors(spark, sf), query_vector(spark, sf)).select("id", "label", "similarity")


def keyword_index(spark: SparkSession, sf: str) -> str:
    """Where the index of the rows' contents stands: written when it is first asked for, and again when the table's files change.

    It stands in the shared folder under a name of its table, with the state of the files, so later sessions find it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stamp = " ".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(path)))
    at = f"{scratch_root(spark)}/strandline/keyword-index-{N.FORMAT}/{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    known = N.versions(spark, at)
    if not known or N.figures(spark, at, known[-1]).first()["stamp"] != stamp:
        N.write_index(_contents(spark, sf), at, stamp=stamp)
        N.drop_versions(spark, at)
    return at


def _contents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    """id and bm25 of the rows that hold a term of the query: its postings are read, and no row of the table."""
    return N.index_scores(spark, keyword_index(spark, sf), QUERY)


def _bm25_top(spark: SparkSession, sf: str, delta: float | None = None) -> DataFrame:
    return N.index_top(spark, keyword_index(spark, sf), QUERY, 10, delta=delta, ids=_contents(spark, sf).select("id"))


@query("J1 J2 J3 J4 J7 F1", f"{WITH_KW} SELECT id, round(bm25, 6) AS score FROM kw ORDER BY bm25 DESC, id LIMIT 10")
def bm25_topk(spark, sf):
    return _bm25_top(spark, sf).select("id", F.round("bm25", 6).alias("score"))


@query("J2 J10 J7", f"{WITH_KW} SELECT id, round(bm25, 6) AS score FROM kw WHERE bm25 > 0 ORDER BY bm25 DESC, id LIMIT 10")
def keyword_index_topk(spark, sf):
    """An index of an older state of the corpus, to which later segments add, replace and delete documents."""
    path, rows = scratch_path(spark, "keyword-index"), _contents(spark, sf)
    old = rows.where("id % 10 > 0").select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("an older error of token handling "), "content")).otherwise(F.col("content")).alias("content"))
    N.write_index(old.union(rows.select(F.col("id") + 1_000_000_000, "content").where("id % 7 = 0")), path)
    N.change_index(spark, path, rows.where("id % 3 = 0 OR id % 10 = 0"))
    N.change_index(spark, path, deleted=rows.select((F.col("id") + 1_000_000_000).alias("id")))
    return N.index_top(spark, path, QUERY, 10).select("id", F.round("bm25", 6).alias("score"))


@query("J10 J8", f"{WITH_KW} SELECT id, round(bm25, 6) AS score FROM kw WHERE bm25 > 0")
def keyword_index_merged(spark, sf):
    """Segments and dead rows, merged: the same scores as those of an index written at once."""
    path, rows = scratch_path(spark, "keyword-index"), _contents(spark, sf)
    N.write_index(rows.where("id % 2 = 0").select("id", F.concat("content", F.lit(" the end")).alias("content")), path)
    N.change_index(spark, path, rows)
    N.merge(spark, path)
    return N.index_scores(spark, path, QUERY).select("id", F.round("bm25", 6).alias("score"))


@query("J5", f"{WITH_KW} SELECT id, round(bm25, 6) AS score FROM kw")
def bm25_all_scores(spark, sf):
    every = N.index_scores(spark, keyword_index(spark, sf), QUERY, ids=_contents(spark, sf).select("id"))
    return every.select("id", F.round("bm25", 6).alias("score"))


@query("J4 J5", f"{WITH_KW} SELECT id, round(bm25 + plus, 6) AS score FROM kw")
def bm25_scan(spark, sf):
    """The same figures by one pass over the texts of rows that no index holds."""
    return S.bm25_scores(_contents(spark, sf), QUERY, delta=1.0).select("id", F.round("bm25", 6).alias("score"))


@query("J6", f"{WITH_KW} SELECT id, round(bm25 + plus, 6) AS score FROM kw ORDER BY bm25 + plus DESC, id LIMIT 10")
def bm25_plus_topk(spark, sf):
    return _bm25_top(spark, sf, delta=1.0).select("id", F.round("bm25", 6).alias("score"))


@query("J8", f"WITH {MEM_SQL}, t AS (SELECT list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda x: length(x) >= 2) AS t FROM mem) SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_tokens, round(avg(len(t)), 6) AS avg_doc_len, (SELECT count(DISTINCT u) FROM (SELECT unnest(t) AS u FROM t)) AS n_terms FROM t")
def term_stats(spark, sf):
    return N.figures(spark, keyword_index(spark, sf)).select("n_docs", "n_tokens", F.round("avg_doc_len", 6).alias("avg_doc_len"), "n_terms")


@query("J2 J3", f"WITH {MEM_SQL}, t AS (SELECT DISTINCT id, unnest(list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda x: length(x) >= 2)) AS term FROM mem), n AS (SELECT count(*) AS n FROM mem) SELECT term, count(*) AS df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM t, n GROUP BY term, n")
def document_frequency(spark, sf):
    return N.document_frequencies(spark, keyword_index(spark, sf)).withColumn("idf", F.round("idf", 6))


@query("G3 K1 K2 P2", f"WITH {VEC_SQL} SELECT id, round(similarity, 6) AS similarity FROM vec ORDER BY vec.similarity DESC, id LIMIT 10")
def cosine_topk(spark, sf):
    return S.top(_similar(spark, sf), "similarity", 10).select("id", F.round("similarity", 6).alias("similarity"))


@query("G4 J24", f"WITH {VEC_SQL} SELECT id, round(similarity, 6) AS similarity FROM vec WHERE label = 3 ORDER BY vec.similarity DESC, id LIMIT 10")
def cosine_topk_filtered(spark, sf):
    return S.top(_similar(spark, sf).where("label = 3"), "similarity", 10).select("id", F.round("similarity", 6).alias("similarity"))


@query("G3 G5 J23", "SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 10")
def nearest_of_all(spark, sf):
    return S.nearest(_vectors(spark, sf), 10).withColumn("similarity", F.round("similarity", 6))


def _asked(spark, sf):
    """The vectors that search in the index: every twentieth id's."""
    return _vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("v"))


def vector_index(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "vector-index")
    write_vector_index(_vectors(spark, sf), path, copies=3)
    return path


@query("G3 N9 J23")
def vector_index_topk(spark, sf):
    """Ten nearest of each asking vector, from a quarter of the lists: these vectors stand in no clusters. Recall is tested."""
    path = vector_index(spark, sf)
    probes = -(-index_lists(spark, path).count() // 4)
    return nearest_in_index(_asked(spark, sf), path, 10, probes).withColumn("similarity", F.round("similarity", 6))


@query("G3 N9", "SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 10")
def vector_index_all_lists(spark, sf):
    """With all lists probed, bytes only leave out what can't be among the best ten; the exact ranking of the rest gives the exact answer."""
    path = vector_index(spark, sf)
    return nearest_in_index(_asked(spark, sf), path, 10, index_lists(spark, path).count()).withColumn("similarity", F.round("similarity", 6))


@query("K3 P1", "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / nullif(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0)) ^ 2)), 6) AS squared, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def l2_normalize(spark, sf):
    unit = _vectors(spark, sf).select("id", l2_normalized(F.col("embedding")).alias("u"))
    return unit.select("id", F.round(F.aggregate(F.transform("u", lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 6).alias("squared"), F.round(F.col("u")[0], 6).alias("first"))


@query("J9 J11 F3 H1", f"{WITH_BOTH}, vb AS (SELECT min(similarity) lo, max(similarity) hi FROM vtop), kb AS (SELECT min(bm25) lo, max(bm25) hi FROM kw), v AS (SELECT id, similarity, CASE WHEN hi > lo THEN (similarity - lo) / (hi - lo) WHEN hi <> 0 THEN 1 ELSE 0 END AS v FROM vtop, vb), w AS (SELECT id, bm25, CASE WHEN hi > lo THEN (bm25 - lo) / (hi - lo) WHEN hi <> 0 THEN 1 ELSE 0 END AS w FROM kw, kb WHERE bm25 > 0) SELECT id, round(0.5 * coalesce(v, 0) + 0.5 * coalesce(w, 0), 6) AS score FROM v FULL JOIN w USING (id) ORDER BY 0.5 * coalesce(v, 0) + 0.5 * coalesce(w, 0) DESC, id LIMIT 10")
def hybrid_weighted(spark, sf):
    rows = N.figures(spark, keyword_index(spark, sf)).first()["n_docs"]
    found = S.weighted_fusion(S.top(_similar(spark, sf), "similarity", 50), _bm25(spark, sf), 0.5, 10, rows)
    return found.select("id", F.round("score", 6).alias("score"))


@query("F2 J9", f"{WITH_BOTH}, v AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) - 1 AS rv FROM vtop), w AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS rw FROM (SELECT * FROM kw WHERE bm25 > 0 ORDER BY bm25 DESC, id LIMIT 50)) SELECT id, round(coalesce(1.0 / (61 + rv), 0) + coalesce(1.0 / (61 + rw), 0), 6) AS score, rv AS rank_vector, rw AS rank_bm25 FROM v FULL JOIN w USING (id) ORDER BY coalesce(1.0 / (61 + rv), 0) + coalesce(1.0 / (61 + rw), 0) DESC, id LIMIT 10")
def hybrid_rrf(spark, sf):
    found = S.rrf_fusion(_similar(spark, sf), _bm25(spark, sf), 10, 50)
    return found.select("id", F.round("score", 6).alias("score"), F.col("rank_vector").cast("long").alias("rank_vector"), F.col("rank_bm25").cast("long").alias("rank_bm25"))


@query("H2 J9", f"{WITH_BOTH}, w AS (SELECT id, 0 AS tier, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS rank FROM kw WHERE bm25 > 0 QUALIFY rank < 10), v AS (SELECT id, 1 AS tier, row_number() OVER (ORDER BY similarity DESC, id) - 1 AS rank FROM vec QUALIFY rank < 20) SELECT * FROM (SELECT * FROM w UNION ALL SELECT * FROM v WHERE id NOT IN (SELECT id FROM w)) ORDER BY tier, rank LIMIT 10")
def hybrid_cascade(spark, sf):
    return S.cascade_fusion(_similar(spark, sf), _bm25(spark, sf), 10).select("id", "tier", F.col("rank").cast("long").alias("rank"))


SIG_SQL = f"""sig AS (SELECT m.id, v.similarity, least(1, 0.5 ^ (date_diff('second', created_at, TIMESTAMP '{AS_OF}') / (86400.0 * 7))) AS rec,
 ln(use_count + 1) / ln((SELECT max(use_count) FROM mem JOIN vec USING (id)) + 1) AS used,
 CASE WHEN length(content) < 100 THEN -least(0.5, (100 - length(content)) / 100) WHEN length(content) > 500 THEN -least(0.5, (length(content) - 500) / 2000) ELSE 0 END AS pen,
 (regexp_matches(lower(content), '\\bthe\\b')::INT + regexp_matches(lower(content), '\\berror\\b')::INT + regexp_matches(lower(content), '\\bof\\b')::INT + regexp_matches(lower(content), '\\btoken\\b')::INT + regexp_matches(lower(content), '\\bhandling\\b')::INT) / 5 AS kw
 FROM mem m JOIN vec v USING (id))"""


def _signals(spark, sf):
    near = _similar(spark, sf)
    # use_count needs no label: the most of those that have a vector comes from two columns
    counts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 7 % 53).alias("use_count"))
    most = counts.join(_vectors(spark, sf).select("id"), "id", "left_semi").agg(F.max("use_count").alias("most"))
    return memories(spark, sf).join(near, "id").crossJoin(F.broadcast(most))  # one row


@query("J12 J13 J14 J15 F4", f"WITH {MEM_SQL}, {VEC_SQL}, {SIG_SQL} SELECT id, round(0.6 * similarity + 0.2 * rec + 0.2 * used + 0.1 * pen + 0.1 * kw, 6) AS score FROM sig")
def rerank_multi_signal(spark, sf):
    m = _signals(spark, sf)
    score = S.multi_signal(F.col("similarity"), S.recency(F.col("created_at"), as_of()), S.usage(F.col("use_count"), F.col("most")), S.length_penalty(F.col("content")), S.keyword_boost(F.col("content"), QUERY))
    return m.select("id", F.round(score, 6).alias("score"))


@query("J19 D2", f"WITH {MEM_SQL}, {VEC_SQL} SELECT id, round(greatest(0, least(1, 0.6 * similarity + 0.2 * 2.0 ^ (-(date_diff('second', last_accessed, TIMESTAMP '{AS_OF}') / 3600.0) / 168) + 0.2 * least(1, ln(use_count + 1) / ln(1001)))), 6) AS score FROM mem JOIN vec USING (id)")
def composite_score(spark, sf):
    m = memories(spark, sf).join(_similar(spark, sf), "id")
    return m.select("id", F.round(S.composite_score(F.col("similarity"), F.col("last_accessed"), as_of(), F.col("use_count")), 6).alias("score"))


@query("F5", f"WITH {MEM_SQL}, {VEC_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS a, row_number() OVER (ORDER BY 0.6 * similarity + 0.2 * least(1, ln(use_count + 1) / ln(1001)) DESC, id) AS b FROM (SELECT vec.*, use_count FROM vec JOIN mem USING (id) ORDER BY similarity DESC, id LIMIT 100)) SELECT round(avg(abs(a - b)), 6) AS mean_move FROM r")
def position_changes(spark, sf):
    best = S.top(_similar(spark, sf).join(memories(spark, sf).select("id", "use_count"), "id"), "similarity", 100)
    new = 0.6 * F.col("similarity") + 0.2 * F.least(F.lit(1.0), F.log(F.col("use_count") + 1) / F.log(F.lit(1001)))
    a = F.row_number().over(Window.orderBy(F.col("similarity").desc(), "id"))
    b = F.row_number().over(Window.orderBy(new.desc(), F.col("id")))
    return best.select(F.abs(a - b).alias("move")).agg(F.round(F.avg("move"), 6).alias("mean_move"))


@query("F6 N4 H7", f"WITH {MEM_SQL}, {VEC_SQL}, r AS (SELECT project_name, id, similarity, row_number() OVER (PARTITION BY project_name ORDER BY similarity DESC, id) AS place FROM vec JOIN mem USING (id)) SELECT project_name, id, round(similarity, 6) AS similarity FROM r WHERE place <= 3 ORDER BY r.similarity DESC, id LIMIT 20")
def per_project_topk(spark, sf):
    rows = _similar(spark, sf).join(memories(spark, sf).select("id", "project_name"), "id")
    place = F.row_number().over(Window.partitionBy("project_name").orderBy(F.col("similarity").desc(), "id"))
    return S.top(rows.withColumn("place", place).where("place <= 3"), "similarity", 20).select("project_name", "id", F.round("similarity", 6).alias("similarity"))


@query("H6 J24", f"WITH {MEM_SQL}, {VEC_SQL} SELECT context_level, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY context_level ORDER BY vec.similarity DESC, id) AS place FROM vec JOIN mem USING (id) WHERE context_level IN ('USER_PREFERENCE', 'SESSION_STATE') QUALIFY place <= 10")
def multi_level_topk(spark, sf):
    rows = _similar(spark, sf).join(memories(spark, sf).select("id", "context_level").where(F.col("context_level").isin("USER_PREFERENCE", "SESSION_STATE")), "id")
    place = F.row_number().over(Window.partitionBy("context_level").orderBy(F.col("similarity").desc(), "id"))
    return rows.withColumn("place", place.cast("long")).where("place <= 10").select("context_level", "id", F.round("similarity", 6).alias("similarity"), "place")


@query("F7", f"WITH {MEM_SQL}, {VEC_SQL} SELECT project_name, category, id, round(similarity, 6) AS similarity FROM vec JOIN mem USING (id) QUALIFY row_number() OVER (PARTITION BY project_name, category ORDER BY vec.similarity DESC, id) = 1")
def best_per_key(spark, sf):
    rows = _similar(spark, sf).join(memories(spark, sf).select("id", "project_name", "category"), "id")
    best = rows.groupBy("project_name", "category").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "id")).alias("b"))
    return best.select("project_name", "category", F.col("b.id").alias("id"), F.round(-F.col("b.s"), 6).alias("similarity"))


@query("J20 C1 D3", f"WITH {MEM_SQL}, {VEC_SQL}, {LOG_SQL} SELECT id, round(0.6 * similarity + 0.2 * 2.0 ^ (-(date_diff('second', last_accessed, TIMESTAMP '{AS_OF}') / 3600.0) / 168) + 0.2 * least(1, ln(use_count + 1) / ln(1001)), 6) AS score FROM mem JOIN vec USING (id) WHERE importance >= 0.5 AND NOT list_contains(tags, 't3') AND id NOT IN (SELECT result_count FROM log WHERE session_id = 5 AND result_count IS NOT NULL) ORDER BY 0.6 * similarity + 0.2 * 2.0 ^ (-(date_diff('second', last_accessed, TIMESTAMP '{AS_OF}') / 3600.0) / 168) + 0.2 * least(1, ln(use_count + 1) / ln(1001)) DESC, id LIMIT 5")
def memory_retrieval(spark, sf):
    from strandline.operators.filters import MemoryFilter

    m = memories(spark, sf).where(MemoryFilter(min_importance=0.5, tags_none=["t3"]).column())
    shown = query_log(spark, sf).where("session_id = 5").select(F.col("result_count").alias("id"))
    m = m.join(_similar(spark, sf), "id").join(shown, "id", "left_anti")
    m = m.withColumn("score", S.composite_score(F.col("similarity"), F.col("last_accessed"), as_of(), F.col("use_count")))
    return S.top(m, "score", 5).select("id", F.round("score", 6).alias("score"))


@query("J21 J22 J23 C4", f"{WITH_BOTH}, f AS (SELECT id, similarity FROM vec JOIN mem USING (id) WHERE project_name LIKE 'src1%' AND category IN ('en', 'de') AND n_chars BETWEEN 200 AND 5000 ORDER BY similarity DESC, id LIMIT 50), w AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS rw FROM kw JOIN f USING (id) WHERE bm25 > 0), v AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) - 1 AS rv FROM f) SELECT id, round(1.0 / (61 + rv) + coalesce(1.0 / (61 + rw), 0), 6) AS score FROM v LEFT JOIN w USING (id) ORDER BY 1.0 / (61 + rv) + coalesce(1.0 / (61 + rw), 0) DESC, id LIMIT 5")
def code_search_hybrid(spark, sf):
    m = memories(spark, sf)
    keep = m.where(F.col("project_name").like("src1%") & F.col("category").isin("en", "de") & F.col("n_chars").between(200, 5000)).select("id")
    near = S.top(_similar(spark, sf).join(keep, "id"), "similarity", 50)
    words = _bm25(spark, sf).join(near.select("id"), "id", "left_semi")
    return S.rrf_fusion(near, words, 5, 50).select("id", F.round("score", 6).alias("score"))


@query("J25", f"WITH {VEC_SQL}, t AS (SELECT * FROM vec WHERE id > 0 ORDER BY similarity DESC, id LIMIT 10) SELECT round(max(similarity), 6) AS best, round(min(similarity), 6) AS worst, CASE WHEN max(similarity) >= 0.85 THEN 'excellent' WHEN max(similarity) >= 0.7 THEN 'good' WHEN max(similarity) >= 0.55 THEN 'moderate' ELSE 'low' END AS quality FROM t")
def search_quality(spark, sf):
    found = S.top(_similar(spark, sf).where("id > 0"), "similarity", 10).agg(F.max("similarity").alias("best"), F.min("similarity").alias("worst"))
    label = F.when(F.col("best") >= 0.85, "excellent").when(F.col("best") >= 0.7, "good").when(F.col("best") >= 0.55, "moderate").otherwise("low")
    return found.select(F.round("best", 6).alias("best"), F.round("worst", 6).alias("worst"), label.alias("quality"))


def _mmr_sql(k: int) -> str:
    """Fifty best rows, scaled and lowered by a better row whose head is alike; then a CTE with the best row left for each of k places."""
    words = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda y: y <> ''))"
    share = lambda a, b: f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"
    ctes = [
        "best AS MATERIALIZED (SELECT id, content, round(bm25, 9) AS bm25 FROM kw JOIN mem USING (id) WHERE bm25 > 0 ORDER BY round(kw.bm25, 9) DESC, id LIMIT 50)",
        f"sc AS MATERIALIZED (SELECT id, (bm25 - lo) / (hi - lo) AS score, {words('content')} AS w, {words('content[1:100]')} AS head FROM best, (SELECT min(bm25) AS lo, max(bm25) AS hi FROM best))",
        f"n0 AS MATERIALIZED (SELECT id, score - 0.1::DOUBLE * EXISTS (SELECT 1 FROM sc b WHERE (b.score > a.score OR b.score = a.score AND b.id < a.id) AND {share('a.head', 'b.head')} > 0.8::DOUBLE)::INT AS score, w, 0::DOUBLE AS near FROM sc a)",
    ]
    for i in range(k):
        ctes.append(f"p{i} AS MATERIALIZED (SELECT id, score, w FROM n{i} ORDER BY 0.7::DOUBLE * score - (1 - 0.7::DOUBLE) * near DESC, score DESC, id LIMIT 1)")
        ctes.append(f"n{i + 1} AS MATERIALIZED (SELECT n{i}.id, n{i}.score, n{i}.w, greatest(near, {share(f'n{i}.w', f'p{i}.w')}) AS near FROM n{i}, p{i} WHERE n{i}.id <> p{i}.id)")
    picks = " UNION ALL ".join(f"SELECT '{QUERY}' AS query, id, round(score, 6) AS score, {i + 1} AS position FROM p{i}" for i in range(k))
    return f"{WITH_KW}, {', '.join(ctes)} {picks}"


@query("J16 J17", _mmr_sql(10))
def mmr_rerank(spark, sf):
    best = S.top(_bm25(spark, sf).withColumn("bm25", F.round("bm25", 9)), "bm25", 50).join(memories(spark, sf).select("id", "content"), "id")
    best = best.select(F.lit(QUERY).alias("query"), "id", F.col("bm25").alias("score"), "content")
    best = S.scaled(best, "score", "scaled").withColumn("score", F.col("scaled"))
    return S.mmr(S.diversified(best).join(best.select("id", "content"), "id"), 10).withColumn("score", F.round("score", 6))


@query("J18 M4", f"{WITH_KW} SELECT id, round(bm25 / ln(length(content) + 2), 6) AS score FROM kw JOIN mem USING (id) WHERE bm25 > 0")
def custom_rerank(spark, sf):
    import numpy as np

    scored = S.rescored(_bm25(spark, sf).where("bm25 > 0").join(memories(spark, sf).select("id", F.length("content").alias("n")), "id"), lambda s, n: s / np.log(n + 2), ["bm25", "n"])
    return scored.select("id", F.round("score", 6).alias("score"))


def _expanded_sql(name: str, source: str, text: str, dictionary: dict[str, list[str]], per_term: int) -> str:
    """CTEs that add a column for T.expanded_column: distinct words in order, related terms that aren't words of the text."""
    table = "MAP {" + ", ".join(f"'{k}': {sorted(v)!r}" for k, v in sorted(dictionary.items())) + "}"
    bare = f"regexp_replace({text}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
    words = lambda x: f"string_split_regex({x}, '[ \\t\\n\\x0B\\f\\r]+')"
    once = lambda x: f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"
    return f"""{name}1 AS MATERIALIZED (SELECT *, {words(bare)} AS w, {words(f"lower({bare})")} AS low FROM {source}),
{name}2 AS MATERIALIZED (SELECT *, list_transform({once("low")}, lambda x: list_filter(coalesce({table}[x], []), lambda t: NOT list_contains(low, t))[1:{per_term}]) AS r FROM {name}1),
{name}3 AS MATERIALIZED (SELECT *, flatten(r) AS f FROM {name}2),
{name} AS MATERIALIZED (SELECT * EXCLUDE (w, low, r, f), array_to_string(list_concat(w, {once("f")}), ' ') AS {name}_text FROM {name}3)"""


#: What a user types before the words of a turn, so that every row has something to expand.
PHRASES = ["fix the auth bug", "Fetch USER config", "db error", "delete test user", "api function", "test  api", "auth auth login", ""]
_TYPED = f"({PHRASES!r})[conv_id % {len(PHRASES)} + 1] || ' ' || text"


@query("J29 J30 J31", f"""WITH c AS (SELECT conv_id, turn, {_TYPED} AS query FROM conversations), {_expanded_sql("syn", "c", "query", T.SYNONYMS, 3)}, {_expanded_sql("ctx", "syn", "query", T.CODE_CONTEXT, 5)},
{_expanded_sql("two", "ctx", "query", T.SYNONYMS, 2)}, {_expanded_sql("whole", "two", "two_text", T.CODE_CONTEXT, 3)} SELECT conv_id, turn, query, syn_text AS synonyms, ctx_text AS context, whole_text AS expanded FROM whole""")
def query_expansion(spark, sf):
    """Every row of the table, by synonyms, by code context, and by both."""
    typed = F.concat(F.element_at(F.array(*[F.lit(x) for x in PHRASES]), F.col("conv_id").cast("int") % len(PHRASES) + 1), F.lit(" "), "text")
    text = F.col("text")
    full = T.expanded_full_column(text)
    return table(spark, sf, "conversations").withColumn("text", typed).select("conv_id", "turn", text.alias("query"), T.expanded_column(text, T.SYNONYMS, 3).alias("synonyms"), T.expanded_column(text, T.CODE_CONTEXT, 5).alias("context"), full.alias("expanded"))


@query("J32 H4", "WITH k AS (SELECT conv_id, turn, list_sort(list_filter(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 3)), lambda x: NOT list_contains(['the','and','for','with','that','this','from','are','was','not','you','have','has','had','but','all','can','will','what','how','where','when'], x))) AS t FROM conversations) SELECT conv_id, turn, array_to_string(t, ' ') AS terms, CAST(len(t) AS INTEGER) AS n FROM k")
def key_terms(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.key_terms(F.col("text")).alias("t"))
    return c.select("conv_id", "turn", F.array_join("t", " ").alias("terms"), F.size("t").alias("n"))


@query("J33 F9", "WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 3)) AS t FROM conversations WHERE role = 'user'), l AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t) SELECT conv_id, turn, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(t, x)))[1:5], ' ') AS added FROM l WHERE p IS NOT NULL")
def conversation_expansion(spark, sf):
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= 3))
    u = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", words.alias("t"))
    u = u.withColumn("p", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p IS NOT NULL")
    return u.select("conv_id", "turn", F.array_join(F.slice(F.array_sort(F.array_except("p", "t")), 1, 5), " ").alias("added"))


@query("G8 J34", "WITH v AS (SELECT unnest(['furniture','error','order','special','customer']) AS w), p AS (SELECT DISTINCT p_brand, lower(split_part(p_name, ' ', 1)) AS t FROM part) SELECT p_brand, t AS term, array_to_string(coalesce((SELECT list(w ORDER BY levenshtein(t, w), w) FROM v WHERE levenshtein(t, w) BETWEEN 1 AND 4), [])[1:3], ' ') AS near FROM p")
def spelling_corrections(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term")).distinct()
    return p.select("p_brand", "term", F.array_join(T.spelling_candidates(F.col("term"), ["furniture", "error", "order", "special", "customer"], 4), " ").alias("near"))


TYPED_SQL = "SELECT DISTINCT w[1:2] || w[4:] AS word FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS w FROM part) UNION SELECT DISTINCT w || w[-1:] || 'q' FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS w FROM part)"


@query("G8 J34", f"WITH {MEM_SQL}, t AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda x: length(x) >= 2)) AS term FROM mem) GROUP BY term), w AS ({TYPED_SQL}), k AS (SELECT word FROM w WHERE word NOT IN (SELECT term FROM t)), n AS (SELECT word, term, df, levenshtein(word, term) AS distance FROM k JOIN t ON length(term) BETWEEN length(word) - 2 AND length(word) + 2 AND length(term) <= 32 WHERE levenshtein(word, term) <= 2) SELECT word, term, CAST(distance AS INTEGER) AS distance, df FROM n QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) <= 3")
def corpus_spelling(spark, sf):
    """Misspelt words of part names, against every term that the keyword index holds."""
    terms = N.document_frequencies(spark, keyword_index(spark, sf)).select("term", "df")
    w = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()
    short, long = F.concat(F.substring("w", 1, 2), F.substring("w", 4, 100)), F.concat("w", F.substring("w", -1, 1), F.lit("q"))
    typed = w.select(F.explode(F.array(short, long)).alias("word"))
    return Y.corrections_of(typed, terms).select("word", "term", "distance", "df")


PAIRS_SQL = """t AS (SELECT list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2) AS t FROM documents),
p AS (SELECT unnest(flatten([[[t[i], t[i + d]] for i in range(1, len(t) - d + 1)] for d in range(1, 5)])) AS p FROM t), o AS (SELECT least(p[1], p[2]) AS x, greatest(p[1], p[2]) AS y, count(*) AS n FROM p WHERE p[1] <> p[2] GROUP BY ALL),
o2 AS (SELECT x AS a, y AS b, n FROM o UNION ALL SELECT y, x, n FROM o), u AS (SELECT a, sum(n) AS n_a FROM o2 GROUP BY a), r AS (SELECT o2.a, o2.b, o2.n, ln(o2.n * (SELECT sum(n_a) FROM u)::DOUBLE / (u.n_a * v.n_a)) AS pmi FROM o2 JOIN u ON u.a = o2.a JOIN u AS v ON v.a = o2.b WHERE o2.n >= 5)"""


@query("J29 J30", f"WITH {PAIRS_SQL} SELECT a, b, n, round(pmi, 6) AS pmi FROM r")
def term_associations(spark, sf):
    """Pairs of terms of all documents that stand within four tokens of each other five times or more."""
    return Y.associations(table(spark, sf, "documents"), "text").withColumn("pmi", F.round("pmi", 6))


@query("J29 J30 J31", f"WITH {PAIRS_SQL}, k AS (SELECT a, b FROM r WHERE pmi >= 1 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(pmi, 9) DESC, n DESC, b) <= 3), c AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2)) AS own FROM conversations), m AS (SELECT conv_id, turn, list_sort(list_distinct(list(b))) AS more FROM (SELECT conv_id, turn, unnest(own) AS a FROM c) JOIN k USING (a) GROUP BY ALL) SELECT conv_id, turn, coalesce(array_to_string(list_filter(coalesce(more, []), lambda x: NOT list_contains(own, x))[1:10], ' '), '') AS expansion FROM c LEFT JOIN m USING (conv_id, turn)")
def corpus_expansion(spark, sf):
    """Every turn, by terms that stand with its own in the documents; the dictionary is written and joined."""
    pairs = Y.associations(table(spark, sf, "documents"), "text").withColumn("pmi", F.round("pmi", 9))
    dictionary = stored(Y.related_terms(pairs), "related-terms")
    return Y.expanded_by(table(spark, sf, "conversations"), dictionary, ["conv_id", "turn"])


@query("J28", """WITH s AS (SELECT conv_id, turn, length(text) AS n, regexp_matches(lower(text), '^(ok|okay|thanks|thank you|cool|got it|hello|hi|yes|no)\\b') AS talk, regexp_matches(lower(text), '\\b(how|what|where|show|find|search|explain|que|wie)\\b') AS want,
 len(list_filter(['error','function','class','api','database','token','config','server'], lambda k: contains(lower(text), k))) AS tech, contains(text, '?') AS ask, regexp_matches(text, '\\(\\)|\\{\\}|\\[\\]|->|=>|::') AS code, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations)
SELECT conv_id, turn, round(CASE WHEN n < 10 AND talk THEN 0.0 WHEN n <= 30 AND talk AND NOT want THEN 0.1 ELSE greatest(0.0, least(1.0, 0.5 + 0.3 * want::INT + 0.2 * (tech > 0)::INT + 0.15 * ask::INT + 0.15 * code::INT + 0.1 * (words >= 4)::INT + 0.1 * (n > 50)::INT + 0.1 * (tech >= 3)::INT - 0.3 * (talk AND NOT want)::INT - 0.2 * (words <= 2 AND NOT code)::INT)) END::DOUBLE, 6) AS utility FROM s""")
def retrieval_utility(spark, sf):
    from strandline.functions.scores import retrieval_utility as utility

    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(utility(F.col("text")), 6).alias("utility"))


@query("J26 J27 G5", """SELECT o_orderkey AS commit_hash, o_custkey AS author, o_orderdate AS author_date FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_custkey BETWEEN 1 AND 100
 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey BETWEEN 1 AND 200) ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def git_history_search(spark, sf):
    from strandline.operators.git import search_commits
    from strandline.sources.tables import commits, file_changes

    touched = file_changes(spark, sf).where("file_path BETWEEN 1 AND 200")
    return search_commits(commits(spark, sf), touched, since="1994-01-01", until="1996-01-01", condition=F.col("author").between(1, 100), limit=20).select("commit_hash", "author", "author_date")


@query("J35", f"WITH {VEC_SQL}, r AS (SELECT count(*) AS n, max(similarity) AS best FROM vec WHERE similarity > 0.2) SELECT array_to_string(list_filter([CASE WHEN n = 0 THEN 'broaden the query' END, CASE WHEN n > 50 THEN 'narrow by project or category' END, CASE WHEN best < 0.55 THEN 'use more specific terms' END], lambda x: x IS NOT NULL)[1:3], '; ') AS hints FROM r")
def refinement_hints(spark, sf):
    r = _similar(spark, sf).where("similarity > 0.2").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("best"))
    hints = F.array_compact(F.array(F.when(F.col("n") == 0, "broaden the query"), F.when(F.col("n") > 50, "narrow by project or category"), F.when(F.col("best") < 0.55, "use more specific terms")))
    return r.select(F.array_join(F.slice(hints, 1, 3), "; ").alias("hints"))


@query("J36 E45", f"WITH {MEM_SQL}, t AS (SELECT project_name, category, count(*) AS n FROM mem GROUP BY ALL) SELECT project_name, 'find ' || category || ' notes in ' || project_name AS suggestion FROM t QUALIFY row_number() OVER (PARTITION BY project_name ORDER BY n DESC, category) <= 2")
def query_suggestions(spark, sf):
    t = memories(spark, sf).groupBy("project_name", "category").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("project_name").orderBy(F.col("n").desc(), "category"))
    return t.withColumn("place", place).where("place <= 2").select("project_name", F.format_string("find %s notes in %s", "category", "project_name").alias("suggestion"))
