"""Queries over sessions, usage, writes, retention, changes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import changes as H
from strandline.operators import lifecycle as L
from strandline.operators import sessions as S
from strandline.plans.registry import query
from strandline.session import scratch_path
from strandline.sources.tables import AS_OF, LOG_SQL, MEM_SQL, as_of, memories, query_log, table

MEM, LOG = f"WITH {MEM_SQL}", f"WITH {LOG_SQL}"

SESSION_SQL = f"{LOG}, g AS (SELECT *, CASE WHEN epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp)) < 1800000000 THEN 0 ELSE 1 END AS new FROM log), s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT session_id, min(timestamp) AS started, max(timestamp) AS ended, count(*) AS n FROM s GROUP BY session_id, k"


@query("L3 L4", SESSION_SQL)
def sessions_30m(spark, sf):
    return S.sessions(query_log(spark, sf), "session_id", "timestamp")


@query("F9", f"{LOG} SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS place FROM log QUALIFY place <= 5")
def last_n_queries(spark, sf):
    return S.last_of_each(query_log(spark, sf), "session_id", "timestamp", 5, "id").select("session_id", "id", F.col("place").cast("long").alias("place"))


@query("D3", f"{MEM}, {LOG_SQL} SELECT id FROM mem WHERE id NOT IN (SELECT result_count FROM log WHERE result_count IS NOT NULL AND session_id = 8)")
def shown_anti(spark, sf):
    shown = query_log(spark, sf).where("session_id = 8").select(F.col("result_count").alias("id"))
    return memories(spark, sf).join(shown, "id", "left_anti").select("id")


USAGE_SQL = "SELECT result_count AS item, min(timestamp) AS first_seen, max(timestamp) AS last_used, count(*) AS use_count, arg_max(latency_ms, timestamp) AS last_score FROM log WHERE result_count IS NOT NULL GROUP BY 1"


def _usage(log):
    return S.usage(log.withColumnRenamed("result_count", "item"), "item", "timestamp", "latency_ms")


@query("L5 L8", f"{LOG} {USAGE_SQL}")
def usage_rollup(spark, sf):
    return _usage(query_log(spark, sf))


@query("L6 L7 Q8", f"{LOG} {USAGE_SQL}")
def usage_upsert(spark, sf):
    log, cut = query_log(spark, sf), as_of("2024-01-15 00:00:00")
    before, after = log.where(F.col("timestamp") < cut), log.where(F.col("timestamp") >= cut)
    return S.usage_update(_usage(before), _usage(after), "item")


@query("L2 L1", f"{LOG}, p AS (SELECT *, lag(latency_ms) OVER (PARTITION BY session_id ORDER BY timestamp, id) AS old FROM log) SELECT session_id, count(*) AS n_changes FROM p WHERE old IS NULL OR old <> latency_ms GROUP BY 1")
def changed_values(spark, sf):
    from pyspark.sql import Window

    old = F.lag("latency_ms").over(Window.partitionBy("session_id").orderBy("timestamp", "id"))
    return query_log(spark, sf).withColumn("old", old).where("old IS NULL OR old <> latency_ms").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_changes"))


@query("L10 L11 L13", f"{MEM} SELECT id FROM mem WHERE NOT (context_level = 'SESSION_STATE' AND last_accessed < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR)")
def retention_prune(spark, sf):
    m = memories(spark, sf)
    return L.pruned(m, L.expired_sessions(m, as_of()), "id").select("id")


@query("L12 L14", f"{MEM} SELECT id FROM mem WHERE use_count = 0 AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND context_level <> 'USER_PREFERENCE'")
def unused_rows(spark, sf):
    return L.unused(memories(spark, sf), as_of() - F.make_dt_interval(F.lit(30)), ["USER_PREFERENCE"]).select("id")


@query("L15 L16 N8 A16", f"{MEM} SELECT project_name, max(last_accessed) < TIMESTAMP '{AS_OF}' - INTERVAL 45 DAY AS inactive, bool_or(last_accessed > created_at + INTERVAL 1 DAY) AS stale FROM mem GROUP BY 1")
def inactive_projects(spark, sf):
    old = F.max("last_accessed") < as_of() - F.make_dt_interval(F.lit(45))
    return memories(spark, sf).groupBy("project_name").agg(old.alias("inactive"), F.expr("bool_or(last_accessed > created_at + INTERVAL 1 DAY)").alias("stale"))


@query("L17 L18", "SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def job_listing(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    return table(spark, sf, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100).select(F.col("o_orderkey").alias("job"), status.alias("status"))


# writes


@query("B2 N5 N6", f"{MEM}, n AS (SELECT id, importance, created_at AS version FROM mem UNION ALL SELECT id, importance / 2, created_at + INTERVAL 1 HOUR FROM mem WHERE category = 'en') SELECT id, arg_max(importance, version) AS importance, max(version) AS version FROM n GROUP BY id")
def upsert_latest(spark, sf):
    m = memories(spark, sf)
    new = m.where("category = 'en'").select("id", (F.col("importance") / 2).alias("importance"), (F.col("created_at") + F.make_dt_interval(hours=F.lit(1))).alias("version"))
    return L.upsert(m.select("id", "importance", F.col("created_at").alias("version")), new, "id", "version")


@query("B5 B10 B11", f"{MEM} SELECT id, CASE WHEN category = 'de' AND scope = 'global' THEN 'USER_PREFERENCE' ELSE context_level END AS context_level FROM mem")
def bulk_update(spark, sf):
    return L.update(memories(spark, sf), (F.col("category") == "de") & (F.col("scope") == "global"), {"context_level": F.lit("USER_PREFERENCE")}).select("id", "context_level")


@query("B3 B5", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'new' ELSE 'old' END AS a, event_type AS kind, CAST(CASE WHEN event_type = 'view' THEN 3 ELSE 2 END AS INTEGER) AS n FROM events")
def metadata_merge(spark, sf):
    e = table(spark, sf, "events")
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("kind"), F.col("event_type"))
    new = F.when(F.col("event_type") == "view", F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    m = L.merged_map(old, new)
    return e.select("event_id", m["a"].alias("a"), m["kind"].alias("kind"), F.size(m).alias("n"))


@query("B3 B4", "SELECT event_id, event_type AS kind, CAST(1 AS INTEGER) AS n, true AS kept FROM events")
def payload_rules(spark, sf):
    """Metadata that names core fields can't replace them: these entries are dropped before rows are written."""
    from strandline.sources.exchange import payload

    meta = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("id"), F.lit("forged"), F.lit("content"), F.lit("forged"))
    path = scratch_path(spark, "payload")
    payload(table(spark, sf, "events").select("event_id", F.col("event_id").alias("id"), meta.alias("metadata"))).write.parquet(path)
    return spark.read.parquet(path).select("event_id", F.col("metadata")["kind"].alias("kind"), F.size("metadata").alias("n"), (F.col("id") == F.col("event_id")).alias("kept"))


@query("B6 B8", f"{MEM} SELECT id FROM mem WHERE NOT (category = 'en' AND project_name = 'src1') AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_rows(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    kept = L.delete_where(memories(spark, sf), (F.col("category") == "en") & (F.col("project_name") == "src1"))
    return L.delete(kept, gone, "id").select("id")


@query("B7 B9 B12 B14", f"{MEM} SELECT count(*) AS n, count(*) FILTER (importance > 0.7) AS n_important, CAST(sum(strlen(content) + 3072) AS BIGINT) AS bytes, count(*) > 10 AS needs_confirmation FROM mem WHERE lifecycle_state = 'STALE' AND category = 'fr'")
def breakdown_preview(spark, sf):
    return L.deletion_preview(memories(spark, sf), (F.col("lifecycle_state") == "STALE") & (F.col("category") == "fr"))


@query("B13 B15 B16 Q28", f"{MEM} SELECT id, lifecycle_state = 'STALE' AND category <> 'fr' AS deleted FROM mem")
def soft_delete_rollback(spark, sf):
    m, now = memories(spark, sf), as_of()
    stale, french = F.col("lifecycle_state") == "STALE", F.col("category") == "fr"
    marked = L.soft_deleted(m, stale & ~french, "batch-1", now)
    restored = L.rolled_back(L.soft_deleted(m, stale & french, "batch-2", now), "batch-2").select("id", F.col("deletion").alias("other"))
    both = L.purged(marked, now).join(restored, "id")
    return both.select("id", (F.col("deletion").isNotNull() | F.col("other").isNotNull()).alias("deleted"))


@query("B17", f"{MEM}, d AS (SELECT project_name, category, content, min(id) AS id FROM mem GROUP BY ALL) SELECT project_name || category AS grp, min(id) AS id, md5(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY id)) AS digest, CAST(count(*) AS INTEGER) AS n FROM d GROUP BY 1")
def merge_rows(spark, sf):
    m = memories(spark, sf).withColumn("grp", F.concat("project_name", "category"))
    return L.merged_rows(m, "grp", "id").select("grp", "id", F.md5("content").alias("digest"), "n")


@query("A14", f"{MEM}, a AS (SELECT id, category, importance FROM mem WHERE scope = 'project'), b AS (SELECT id, CASE WHEN category = 'en' THEN NULL ELSE upper(category) END AS category, importance + 1 AS importance FROM mem WHERE verified) SELECT id, coalesce(b.category, a.category) AS category, coalesce(b.importance, a.importance) AS importance FROM a FULL JOIN b USING (id)")
def import_conflict(spark, sf):
    m = memories(spark, sf).select("id", "category", "importance", "scope", "verified")
    a = m.where("scope = 'project'").select("id", "category", "importance")
    b = m.where("verified").select("id", F.when(F.col("category") != "en", F.upper("category")).alias("category"), (F.col("importance") + 1).alias("importance"))
    return L.imported(a, b, "id", "merge")


@query("B18", f"{MEM} SELECT id, md5(format('## {{}}\n\n- category: {{}}\n- project: {{}}\n- importance: {{:.2f}}\n\n{{}}\n', id, category, project_name, importance, content)) AS digest FROM mem")
def export_markdown(spark, sf):
    from strandline.sources.exchange import markdown

    m = memories(spark, sf)
    return markdown(m).select(F.regexp_extract("value", r"^## (\d+)", 1).cast("long").alias("id"), F.md5("value").alias("digest"))


@query("B19 B20", "SELECT o_orderkey AS commit_hash, CAST(epoch(o_orderdate) AS BIGINT) AS author_epoch FROM orders")
def git_commit_rows(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("commit_hash"), F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("o_orderdate")).alias("author_epoch"))


@query("D13 N3 Q24", f"{MEM} SELECT id FROM mem WHERE project_name IN (SELECT project_name FROM mem GROUP BY 1 HAVING avg(importance) > 0.55) OR project_name = 'src2'")
def consented_search(spark, sf):
    m = memories(spark, sf)
    yes = m.groupBy("project_name").agg(F.avg("importance").alias("a")).where("a > 0.55 OR project_name = 'src2'").select("project_name")
    return m.join(yes, "project_name", "left_semi").select("id")


# changes


def _versions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"), "lang")
    old = d.where("lang <> 'de'").select("path", "content")
    new = d.where("lang <> 'es'").select("path", F.when(F.col("lang") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return old, new


@query("D4 A5", "SELECT doc_id AS path, CASE lang WHEN 'de' THEN 'added' WHEN 'es' THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE lang IN ('de', 'es', 'fr')")
def file_diff(spark, sf):
    return H.file_diff(*_versions(spark, sf))


@query("D6", "SELECT doc_id AS name, CASE lang WHEN 'de' THEN 'added' WHEN 'es' THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE lang IN ('de', 'es', 'fr')")
def unit_diff(spark, sf):
    old, new = _versions(spark, sf)
    return H.unit_diff(old.select(F.col("path").alias("name"), F.concat(F.lit("  \n"), F.col("content")).alias("content")), new.select(F.col("path").alias("name"), "content"))


@query("D7", "SELECT count(*) FILTER (lang = 'de') AS to_add, count(*) FILTER (lang = 'fr') AS to_update, count(*) FILTER (lang = 'es') AS to_delete, count(*) FILTER (lang IN ('de', 'es', 'fr')) > 0.7 * count(*) FILTER (lang <> 'es') AS full_reindex FROM documents")
def index_plan(spark, sf):
    old, new = _versions(spark, sf)
    return H.index_plan(H.file_diff(old, new), new)


@query("D5 K35")
def rename_matches(spark, sf):
    b = table(spark, sf, "benchmark")
    old = b.select(F.concat(F.lit("old/"), F.col("item_id")).alias("path"), F.col("text").alias("content"))
    new = b.select(F.concat(F.lit("new/"), F.col("item_id")).alias("path"), F.concat("text", F.lit(" end")).alias("content"))
    return H.renames(old, new).withColumn("similarity", F.round("similarity", 6))


# streams: the same operators over readStream, run to completion into a memory table


@query("L3 L9", SESSION_SQL)
def stream_sessions(spark, sf):
    from strandline.streaming.streams import drained, event_stream, session_stream

    return drained(session_stream(event_stream(spark, sf)), "complete").select("session_id", "started", "ended", "n")


@query("L9 E19", "SELECT CAST(ts AS DATE) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    from strandline.streaming.streams import daily_stream, drained, event_stream

    return drained(daily_stream(event_stream(spark, sf)), "complete").select("day", "kind", "n")


@query("L5 L6 L7", "SELECT user_id AS item, min(ts) AS first_seen, max(ts) AS last_used, count(*) AS use_count, arg_max(value, ts) AS last_score FROM events GROUP BY 1")
def stream_usage_upsert(spark, sf):
    from strandline.streaming.streams import event_stream, upserted_usage

    return upserted_usage(event_stream(spark, sf))


QUIET_MS, LATE_MS, GAP_MS = 2 * 3600 * 1000, 3600 * 1000, 30 * 60 * 1000


@query("L1", f"""WITH e AS (SELECT user_id AS path, event_id, value, epoch_ms(ts) AS at_ms, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS next, max(epoch_ms(ts)) OVER () - {LATE_MS} AS mark FROM events)
SELECT path, at_ms, event_id, value FROM e WHERE next - at_ms >= {QUIET_MS} OR next IS NULL AND at_ms + {QUIET_MS} <= mark""")
def stream_debounced(spark, sf):
    """The last change of each path before it was quiet for two hours; paths that may still change wait in the state."""
    from strandline.streaming.state import last_after_quiet, with_rocksdb
    from strandline.streaming.streams import drained, event_stream

    with_rocksdb(spark)
    e = event_stream(spark, sf, in_ms=True).select("timestamp", F.col("session_id").alias("path"), F.unix_millis("timestamp").alias("at"), F.col("id").alias("place"), F.col("id").alias("event_id"), F.col("latency_ms").alias("value"))
    return drained(last_after_quiet(e, "path", {"event_id": "long", "value": "double"}, quiet_ms=QUIET_MS, key_type="long"), "append").select("path", F.col("at").alias("at_ms"), "event_id", "value")


@query("L3", f"""WITH e AS (SELECT user_id AS session_id, event_id % 10 AS id, epoch_ms(ts) AS at_ms, max(epoch_ms(ts)) OVER () - {LATE_MS} AS mark, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id % 10) AS gap FROM events),
g AS (SELECT *, sum((coalesce(gap, 0) > {GAP_MS})::INT) OVER (PARTITION BY session_id ORDER BY at_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM e),
l AS (SELECT session_id, max(at_ms) AS last, count(DISTINCT id) AS n_shown, any_value(mark) AS mark FROM g WHERE k = (SELECT max(k) FROM g AS h WHERE h.session_id = g.session_id) GROUP BY session_id)
SELECT session_id, last, n_shown FROM l UNION ALL SELECT session_id, last, 0 FROM l WHERE last + {GAP_MS} <= mark""")
def stream_shown_ids(spark, sf):
    """Each session's distinct ids after the data, and 0 once the watermark has passed its end."""
    from strandline.streaming.state import shown_in_session, with_rocksdb
    from strandline.streaming.streams import drained, event_stream

    with_rocksdb(spark)
    e = event_stream(spark, sf, in_ms=True).select("timestamp", "session_id", (F.col("id") % 10).alias("id"), F.unix_millis("timestamp").alias("at"))
    return drained(shown_in_session(e, GAP_MS), "update").select("session_id", "last", "n_shown")
