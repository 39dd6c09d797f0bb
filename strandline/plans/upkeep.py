"""Queries over jobs, caches, scopes, stale rows, bounded deletes and git sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import scores as X
from strandline.functions.embedding import embed
from strandline.operators import changes as H
from strandline.operators import lifecycle as L
from strandline.operators import search as S
from strandline.operators import upkeep as U
from strandline.plans.registry import query
from strandline.plans.retrieval import VEC_SQL, _similar
from strandline.session import scratch_path, stored
from strandline.sources import code as K
from strandline.sources.tables import AS_OF, COMMIT_SQL, LOG_SQL, MEM_SQL, as_of, commits, file_changes, memories, query_log, table

MEM = f"WITH {MEM_SQL}"
STATUSES = ["running", "paused", "completed", "failed", "cancelled", "queued"]
_MOVES_SQL = "MAP {" + ", ".join(f"'{k}': {v or ['-']!r}" for k, v in U.JOB_MOVES.items()) + "}"


@query("L17", f"WITH u AS (SELECT user_id % 200 AS job, list(({STATUSES!r})[event_id % 6 + 1] ORDER BY event_id) AS l FROM events GROUP BY 1) SELECT job, list_reduce(list_prepend('queued', l), lambda s, e: CASE WHEN list_contains({_MOVES_SQL}[s], e) THEN e ELSE s END) AS status, CAST(len(l) AS BIGINT) AS n FROM u")
def job_state_machine(spark, sf):
    e = table(spark, sf, "events")
    u = e.select((F.col("user_id") % 200).alias("job"), F.col("event_id").alias("at"), F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("event_id") % 6 + 1).cast("int")).alias("status"))
    return U.job_states(u).select("job", "status", (F.col("n_moves") + F.col("n_refused")).cast("long").alias("n"))


@query("L19 M2", f"{MEM} SELECT id, id % 3 = 0 AND TIMESTAMP '2024-01-01 00:00:00' + to_minutes(id % 80000) > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS hit FROM mem")
def embedding_cache(spark, sf):
    """Every row looks its vector up by key; a third is cached, some of it too long ago. Misses are computed and looked up again."""
    m = memories(spark, sf).select("id", F.col("content").alias("text"), "created_at", F.concat(F.lit("k"), "id").alias("key"))
    cache = m.where("id % 3 = 0").select("key", embed(F.col("text")).alias("vector"), "created_at")
    found = U.cache_lookup(m.select("id", "key", "text"), cache, as_of())
    filled = U.cache_filled(found, cache, embed, as_of())
    again = U.cache_lookup(found.select("id", "key", F.col("hit").alias("before")), filled, as_of())
    return again.where("hit").select("id", F.col("before").alias("hit"))


@query("A5", "SELECT 'src/' || p_partkey AS file_path FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 10 = 1")
def stale_files(spark, sf):
    """Indexed files of a folder that are no longer there."""
    p = table(spark, sf, "part").select(F.concat(F.lit("src/"), "p_partkey").alias("file_path"), "p_partkey")
    return H.stale_entries(p.where("p_partkey % 10 = 1").select("file_path"), p.where("p_partkey % 3 <> 0"))


@query("A17", "SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 4 <> 2")
def ignored_paths(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("build/out", "src/a.py", "lib/x.log", "src/build.py")])
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("r/"), F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("path"))
    return p.where(K.not_ignored(F.col("path"), ["build/", "*.log", "# comment", "!keep.log", ""])).select("p_partkey")


@query("L2", "SELECT event_id FROM events WHERE event_id % 2 = 1 AND event_id % 3 = 0")
def changed_files(spark, sf):
    """Files whose modification time and content differ from what is indexed."""
    i = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.lit(1).alias("old"), (i % 2 + 1).alias("new"), F.sha2(F.lit("a"), 256).alias("old_hash"), F.sha2(F.when(i % 3 == 0, "b").otherwise("a"), 256).alias("new_hash"))
    return e.where(H.changed(F.col("old"), F.col("new"), F.col("old_hash"), F.col("new_hash"))).select("event_id")


_REPO_SQL = "repos AS (SELECT s_suppkey AS repository, (['INDEXED','STALE','ERROR','PENDING'])[s_suppkey % 4 + 1] AS status, TIMESTAMP '2024-02-20 00:00:00' + to_days(CAST(s_suppkey % 12 AS INTEGER)) AS last_updated, ['t' || s_nationkey % 3, 'u' || s_suppkey % 5] AS tags, s_nationkey AS workspace FROM supplier)"
_SPACE_SQL = "spaces AS (SELECT workspace, list(repository) AS repositories, list_distinct(flatten(list(tags))) AS tags, workspace % 2 = 0 AS auto_index, workspace % 5 = 0 AS cross_search FROM repos GROUP BY workspace)"


def _repos(spark, sf):
    key = F.col("s_suppkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("INDEXED", "STALE", "ERROR", "PENDING")]), (key % 4 + 1).cast("int"))
    tags = F.array(F.concat(F.lit("t"), F.col("s_nationkey") % 3), F.concat(F.lit("u"), key % 5))
    return table(spark, sf, "supplier").select(key.alias("repository"), status.alias("status"), F.expr("timestamp_ntz'2024-02-20 00:00:00' + make_dt_interval(cast(s_suppkey % 12 as int))").alias("last_updated"), tags.alias("tags"), F.col("s_nationkey").alias("workspace"))


def _spaces(spark, sf):
    w = _repos(spark, sf).groupBy("workspace").agg(F.collect_list("repository").alias("repositories"), F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"))
    return w.withColumns({"auto_index": F.col("workspace") % 2 == 0, "cross_search": F.col("workspace") % 5 == 0})


@query("A16", f"WITH {_REPO_SQL} SELECT repository FROM repos WHERE status IN ('STALE', 'ERROR') OR (status = 'INDEXED' AND last_updated < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)")
def stale_repositories(spark, sf):
    return U.stale_repositories(_repos(spark, sf), as_of()).select("repository")


@query("N2", f"WITH {_REPO_SQL}, {_SPACE_SQL} SELECT workspace FROM spaces WHERE list_contains(tags, 't1') AND list_contains(tags, 'u2') AND list_contains(repositories, (SELECT min(repository) FROM repos WHERE workspace % 3 = 1))")
def workspace_filter(spark, sf):
    first = _repos(spark, sf).where("workspace % 3 = 1").agg(F.min("repository")).first()[0]
    return U.workspaces_with(_spaces(spark, sf), ["t1", "u2"], first).select("workspace")


@query("N3", f"WITH {_REPO_SQL} SELECT repository, 'workspace' AS how FROM repos WHERE workspace = 3 AND status = 'INDEXED' UNION ALL SELECT repository, 'tags' FROM repos WHERE list_has_any(tags, ['t0', 'u4']) AND status IN ('INDEXED', 'STALE')")
def search_scopes(spark, sf):
    r, w = _repos(spark, sf), _spaces(spark, sf)
    return U.search_scope(r, w, workspace=3).withColumn("how", F.lit("workspace")).union(U.search_scope(r, w, tags=["t0", "u4"], include_stale=True).withColumn("how", F.lit("tags")))


@query("E48", f"WITH {_REPO_SQL}, {_SPACE_SQL} SELECT count(*) AS n_workspaces, CAST(sum(auto_index::INT) AS BIGINT) AS n_auto_index, CAST(sum(cross_search::INT) AS BIGINT) AS n_cross_search, round(avg(len(repositories)), 2) AS mean_repositories, (SELECT count(DISTINCT repository) FROM repos) AS n_repositories, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM repos)) AS n_tags FROM spaces")
def workspace_statistics(spark, sf):
    return U.workspace_statistics(_spaces(spark, sf))


@query("B12 B13", f"{MEM}, g AS (SELECT id FROM mem WHERE importance < 0.5 ORDER BY id LIMIT 100) SELECT 'hard' AS how, id, false AS marked FROM mem WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'soft', id, id IN (SELECT id FROM g) FROM mem")
def bulk_delete(spark, sf):
    m, low = memories(spark, sf).select("id", "importance"), F.col("importance") < 0.5
    hard = U.bulk_delete(m, low, 100, None, as_of()).select(F.lit("hard").alias("how"), "id", F.lit(False).alias("marked"))
    return hard.union(U.bulk_delete(m, low, 100, "r1", as_of()).select(F.lit("soft"), "id", F.col("deletion").isNotNull()))


@query("L13 L10", f"{MEM} SELECT id FROM mem WHERE context_level = 'SESSION_STATE' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND last_accessed < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR")
def prune_with_safety(spark, sf):
    return U.pruned_sessions(memories(spark, sf), as_of()).select("id")


@query("B19 B20", f"WITH {COMMIT_SQL}, c AS (SELECT commit_hash, epoch(author_date)::BIGINT AS author_date FROM commits), d AS (SELECT DISTINCT commit_hash, file_path FROM changes) SELECT (SELECT count(*) FROM c) AS n_commits, (SELECT CAST(sum(author_date) AS BIGINT) FROM c) AS seconds, (SELECT count(*) FROM d) AS n_changes, true AS unique_ids")
def git_sinks(spark, sf):
    """Both tables are stored twice; the second time adds nothing."""
    path = scratch_path(spark, "git")
    for _ in range(2):
        c, d = U.store_git(spark, path, commits(spark, sf), file_changes(spark, sf))
    own = F.unhex(F.replace("id", F.lit("-"), F.lit("")))  # 16 bytes for 36 characters
    counts = c.agg(F.count(F.lit(1)).alias("n_commits"), F.sum("author_date").alias("seconds"), F.countDistinct(own).alias("ids"))
    return counts.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct(own).alias("more_ids")))).select("n_commits", "seconds", "n_changes", ((F.col("ids") == F.col("n_commits")) & (F.col("more_ids") == F.col("n_changes"))).alias("unique_ids"))


@query("D2 J19", f"{MEM}, {VEC_SQL}, {LOG_SQL}, u AS (SELECT session_id AS id, count(*) AS n, max(date_trunc('second', timestamp)) AS seen FROM log GROUP BY 1) SELECT m.id, round(greatest(0, least(1, 0.6 * similarity + 0.2 * 2.0 ^ (-(date_diff('second', coalesce(u.seen, m.created_at), TIMESTAMP '{AS_OF}') / 3600.0) / 168) + 0.2 * least(1, ln(coalesce(u.n, 0) + 1) / ln(1001)))), 6) AS score FROM mem m JOIN vec USING (id) LEFT JOIN u ON u.id = m.id")
def usage_lookup_rerank(spark, sf):
    """Results with the usage that was logged for them, where there is any."""
    used = query_log(spark, sf).groupBy(F.col("session_id").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.max(F.date_trunc("second", F.col("timestamp")).cast("timestamp_ntz")).alias("seen"))
    m = memories(spark, sf).select("id", "created_at").join(_similar(spark, sf), "id").join(used, F.col("id") == F.col("item"), "left")
    return m.select("id", F.round(S.composite_score(F.col("similarity"), F.coalesce("seen", "created_at"), as_of(), F.coalesce("n", F.lit(0))), 6).alias("score"))


@query("J27 G5", """WITH t AS (SELECT o_orderkey AS id, o_orderdate, list_filter(regexp_extract_all(lower(o_orderpriority), '[a-z0-9_]+'), lambda x: length(x) >= 2) AS t FROM orders), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t),
d AS (SELECT q, count(*) FILTER (list_contains(t, q)) AS df FROM t, (SELECT unnest(['urgent', 'specified']) AS q) GROUP BY q), x AS (SELECT id, o_orderdate, sum(CASE WHEN list_contains(t, q) THEN ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(t) / a)) ELSE 0 END) AS score FROM t, s, d GROUP BY id, o_orderdate)
SELECT id AS commit_hash, round(score, 6) AS score FROM x WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND score > 0 ORDER BY x.score DESC, id LIMIT 20""")
def commit_message_search(spark, sf):
    """Commits since a date by the words of their messages."""
    c = commits(spark, sf).select(F.col("commit_hash").alias("id"), F.col("message").alias("content"), "author_date")
    found = S.bm25_scores(c, "urgent specified").join(c.where(F.col("author_date") >= F.expr("timestamp_ntz'1995-01-01 00:00:00'")).select("id"), "id").where("bm25 > 0")
    return S.top(found, "bm25", 20).select(F.col("id").alias("commit_hash"), F.round("bm25", 6).alias("score"))


@query("N5 N6", "WITH e AS (SELECT user_id % 40 AS project, event_id, event_type = 'click' AS consented, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id DESC) AS place FROM events) SELECT project, consented, event_id AS at FROM e WHERE place = 1")
def consent_upserts(spark, sf):
    """The last of each project's opt-ins and opt-outs, upserted in two batches."""
    e = table(spark, sf, "events").select((F.col("user_id") % 40).alias("project"), (F.col("event_type") == "click").alias("consented"), F.col("event_id").alias("at"))
    return L.upsert(L.upsert(e.limit(0), e.where("at % 2 = 0"), "project", "at"), e.where("at % 2 = 1"), "project", "at")


@query("N7 E33", "SELECT event_id AS suggestion, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 = 0 END AS accepted FROM events")
def suggestion_feedback(spark, sf):
    """Pending suggestions, four fifths of which get feedback."""
    pending = table(spark, sf, "events").select(F.col("event_id").alias("suggestion"), F.lit(None).cast("boolean").alias("accepted"), F.lit(0).alias("version"))
    given = pending.where("suggestion % 5 <> 0").select("suggestion", (F.col("suggestion") % 3 == 0).alias("accepted"), F.lit(1).alias("version"))
    return L.upsert(pending, given, "suggestion", "version").select("suggestion", "accepted")


@query("E50", "WITH f AS (SELECT lang AS directory, source AS extension, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY ALL) SELECT *, round(bytes / sum(bytes) OVER (), 6) AS share, n_files <= 2 AND round(bytes / sum(bytes) OVER (), 6) > 0.01 AS exclude FROM f")
def directory_optimisation(spark, sf):
    return U.directory_analysis(table(spark, sf, "documents").select(F.col("lang").alias("directory"), F.col("source").alias("extension"), F.col("n_chars").cast("long").alias("bytes")))


@query("E52", f"{MEM}, f AS (SELECT avg(importance) AS imp, avg(verified::INT) AS ver, count(*) AS n FROM mem) SELECT priority, insight FROM (SELECT unnest([CASE WHEN ver < 0.5 THEN {{'priority': 1, 'insight': 'verify more rows'}} END, CASE WHEN n > 100 THEN {{'priority': 2, 'insight': 'prune old rows'}} END, CASE WHEN imp > 2 THEN {{'priority': 0, 'insight': 'importance is off'}} END], recursive := true) FROM f) WHERE insight IS NOT NULL")
def dashboard_insights(spark, sf):
    f = memories(spark, sf).agg(F.avg("importance").alias("imp"), F.avg(F.col("verified").cast("int")).alias("ver"), F.count(F.lit(1)).alias("n"))
    return U.insights(f, [(2, "prune old rows", F.col("n") > 100), (1, "verify more rows", F.col("ver") < 0.5), (0, "importance is off", F.col("imp") > 2)])


_TOP_SQL = "least(0.99, 0.7 + 0.1 * (q - 1))"


#: What stands before a message, by its turn, so that most messages show a pattern.
OPENINGS = ["why does it fail", "what is this?", "hello", "an error and a bug"]


@query("M5 K28", f"""{MEM}, c AS (SELECT conv_id, turn, ({OPENINGS!r})[turn % 4 + 1] || ' ' || text AS text FROM conversations), h AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '\\?')) + len(regexp_extract_all(lower(text), '\\b(how|what|why|where)\\b')) AS q, len(regexp_extract_all(lower(text), '\\b(error|exception|bug|fail)')) + len(regexp_extract_all(lower(text), '\\bnot work')) AS d FROM c),
p AS (SELECT conv_id, turn, CASE WHEN d > 0 AND least(0.99, 0.8 + 0.1 * (d - 1)) >= CASE WHEN q > 0 THEN {_TOP_SQL} ELSE 0 END THEN 'debugging' ELSE 'question' END AS kind FROM h WHERE q > 0 OR d > 0),
b AS (SELECT CASE context_level WHEN 'PROJECT_CONTEXT' THEN 'question' ELSE 'debugging' END AS kind, id FROM mem WHERE context_level IN ('PROJECT_CONTEXT', 'SESSION_STATE') QUALIFY row_number() OVER (PARTITION BY kind ORDER BY importance DESC, id) <= 3)
SELECT conv_id, turn, kind, id FROM p JOIN b USING (kind)""")
def suggestion_engine(spark, sf):
    """Messages, the pattern they show, and the three best rows of the context that it asks for."""
    opening = F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), (F.col("turn") % 4 + 1).cast("int"))
    c = table(spark, sf, "conversations").withColumn("text", F.concat(opening, F.lit(" "), "text"))
    c = c.withColumn("p", F.filter(X.detected_patterns(F.col("text")), lambda s: s["kind"].isin("question", "debugging"))).where(F.size("p") > 0).select("conv_id", "turn", F.col("p")[0]["kind"].alias("kind"))
    m = memories(spark, sf).where(F.col("context_level").isin("PROJECT_CONTEXT", "SESSION_STATE")).select("id", "importance", F.when(F.col("context_level") == "PROJECT_CONTEXT", "question").otherwise("debugging").alias("kind"))
    best = S.top(m.where("kind = 'question'"), "importance", 3).union(S.top(m.where("kind = 'debugging'"), "importance", 3))
    return c.join(F.broadcast(best), "kind").select("conv_id", "turn", "kind", "id")  # six rows


SUGGEST_SQL = f"""q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) <= 5),
tok AS (SELECT DISTINCT id, unnest(list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda x: length(x) >= 2)) AS term FROM mem), df AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM mem) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tok GROUP BY term),
k AS (SELECT conv_id, term, df, idf FROM (SELECT DISTINCT conv_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 4)) AS term FROM q) JOIN df USING (term) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY df, term) <= 3),
c AS (SELECT conv_id, id, round(sum(idf) / any_value(whole), 9) AS similarity FROM k JOIN tok USING (term) JOIN (SELECT conv_id, sum(idf) AS whole FROM k GROUP BY 1) USING (conv_id) GROUP BY conv_id, id QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY similarity DESC, id) <= 20),
s AS (SELECT conv_id, id, round(greatest(0, least(1, 0.5 * similarity + 0.2 * CASE WHEN a <= 7 THEN 1.0 WHEN a <= 30 THEN 0.8 WHEN a <= 90 THEN 0.5 WHEN a <= 180 THEN 0.3 ELSE 0.1 END + 0.2 * importance + 0.1 * verified::INT))::DOUBLE, 9) AS confidence FROM (SELECT c.*, importance, verified, floor(date_diff('second', last_accessed, TIMESTAMP '{AS_OF}') / 86400) AS a FROM c JOIN mem USING (id)) WHERE id % 10 <> conv_id % 10)"""


@query("M6 M5 K29 K31 K32", f"{MEM}, {SUGGEST_SQL} SELECT conv_id, id, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY conv_id ORDER BY s.confidence DESC, id) AS place FROM s WHERE s.confidence >= 0.5 QUALIFY place <= 5")
def proactive_suggestions(spark, sf):
    """Sessions' last questions, their rarest terms, rows that hold them, confidence, what was shown, the five best."""
    from strandline.operators import suggestions as P
    from strandline.operators.keyword_index import document_frequencies
    from strandline.plans.retrieval import keyword_index

    path = keyword_index(spark, sf)
    log = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    _, interest = P.session_interest(log, document_frequencies(spark, path), "conv_id", "turn")
    found = P.candidates(spark, path, stored(interest, "interest"), "conv_id")
    m = memories(spark, sf).select("id", "importance", "verified", "last_accessed")
    shown = found.where("id % 10 = conv_id % 10").select("conv_id", "id")
    out = P.suggested(found, m, shown, X.age_days(F.col("last_accessed"), as_of()), session="conv_id")
    return out.select("conv_id", "id", X.rounded(F.col("confidence"), 6).alias("confidence"), F.col("place").cast("long").alias("place"))


@query("E50", "WITH f AS (SELECT lang AS directory, source AS extension, count(*) AS n_files, sum(n_chars) AS bytes FROM documents GROUP BY ALL), x AS (SELECT *, n_files <= 2 AND round(bytes / sum(bytes) OVER (), 6) > 0.01 AS exclude FROM f) SELECT CAST(sum(n_files) AS BIGINT) AS n_files, CAST(coalesce(sum(n_files) FILTER (exclude), 0) AS BIGINT) AS n_left_out, CAST(coalesce(sum(bytes) FILTER (exclude), 0) AS BIGINT) AS bytes_saved, round(sum(n_files) * 0.1 / greatest(1.0, sum(n_files) * 0.1 - coalesce(sum(n_files) FILTER (exclude), 0) * 0.1)::DOUBLE, 6) AS speedup FROM x")
def optimisation_estimate(spark, sf):
    """What leaving out the suggested directories saves, and how much faster indexing gets."""
    files = table(spark, sf, "documents").select(F.col("lang").alias("directory"), F.col("source").alias("extension"), F.col("n_chars").cast("long").alias("bytes"))
    e = U.optimisation_estimate(U.directory_analysis(files))
    return e.select("n_files", "n_left_out", "bytes_saved", F.round("speedup", 6).alias("speedup"))


@query("A15 E51", "SELECT source AS repository, CASE WHEN bool_or(toxic = 1) THEN 'failed' WHEN bool_or(text IS NULL) THEN 'error' ELSE 'indexed' END AS status, count(*) AS n_files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS n_units, max(doc_id) AS last FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def repository_index(spark, sf):
    """Sources as repositories: each one's files are indexed together, and its entry, status and figures are written and read back."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    files = d.select(F.col("source").alias("repository"), F.col("doc_id").alias("at"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("units"), F.when(F.col("toxic") == 1, "failed").when(F.col("text").isNull(), "error").alias("problem"))
    path = scratch_path(spark, "repositories")
    U.repository_entries(files).write.partitionBy("status").parquet(path)
    return spark.read.parquet(path).select("repository", "status", "n_files", "n_units", "last")
