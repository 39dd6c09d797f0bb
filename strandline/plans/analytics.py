"""Queries over filters, lists, aggregates, git history and metrics."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scores as X
from strandline.functions import text as T
from strandline.operators import git as G
from strandline.operators import lifecycle as L
from strandline.operators import metrics as M
from strandline.operators import sketches as K
from strandline.operators.filters import MemoryFilter, parse_date, parse_query
from strandline.plans.registry import query
from strandline.session import scratch_path
from strandline.sources.tables import AS_OF, COMMIT_SQL, LOG_SQL, MEM_SQL, as_of, commits, file_changes, memories, query_log, table

MEM, GIT, LOG = f"WITH {MEM_SQL}", f"WITH {COMMIT_SQL}", f"WITH {LOG_SQL}"


# filters and lists


@query("C1 C2 C3 C5", f"{MEM} SELECT id, category, importance FROM mem WHERE context_level = 'PROJECT_CONTEXT' AND importance >= 0.4 AND importance <= 0.9 AND list_contains(tags, 'u1') AND list_has_any(tags, ['en', 'de']) AND NOT list_has_any(tags, ['t3', 't5']) AND created_at >= TIMESTAMP '2024-01-01 01:00:00' AND lifecycle_state IN ('ACTIVE', 'RECENT') AND category NOT IN ('fr') AND provenance_source <> ''")
def filter_advanced(spark, sf):
    f = MemoryFilter(context_level="PROJECT_CONTEXT", min_importance=0.4, max_importance=0.9, tags_all=["u1"], tags_any=["en", "de"], tags_none=["t3", "t5"], created_after="2024-01-01 01:00:00", lifecycle_states=["ACTIVE", "RECENT"], exclude_categories=["fr"])
    return memories(spark, sf).where(f.column()).select("id", "category", "importance")


@query("C4 G2 A17 A18", f"{MEM} SELECT id, project_name, n_chars FROM mem WHERE (project_name LIKE 'src1%' OR project_name LIKE 'src_') AND NOT project_name LIKE '%5' AND n_chars BETWEEN 500 AND 3000 ORDER BY created_at DESC, id LIMIT 50")
def list_by_glob(spark, sf):
    f = MemoryFilter(file_patterns=["src1*", "src?"], exclude_patterns=["*5"])
    return memories(spark, sf).where(f.column() & F.col("n_chars").between(500, 3000)).orderBy(F.col("created_at").desc(), "id").limit(50).select("id", "project_name", "n_chars")


@query("G1", f"{MEM} SELECT id, importance, (SELECT count(*) FROM mem WHERE category = 'en') AS total FROM mem WHERE category = 'en' ORDER BY importance DESC, id LIMIT 20 OFFSET 40")
def list_page(spark, sf):
    rows = memories(spark, sf).where("category = 'en'")
    page = rows.select("id", "importance").orderBy(F.col("importance").desc(), "id").offset(40).limit(20)
    return page.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row


@query("C6 C7 C8", f"{MEM} SELECT id FROM mem WHERE category = 'en' AND created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-11' AND NOT project_name LIKE '%src2%' AND scope = 'project'")
def dsl_query(spark, sf):
    return memories(spark, sf).where(parse_query('error handling language:en created:2024-01-01..2024-02-10 -file:src2 scope:project foo:bar').column()).select("id")


@query("C9", f"{MEM} SELECT id FROM mem WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY")
def relative_date_filter(spark, sf):
    since = parse_date("2 months ago", dt.datetime.fromisoformat(AS_OF))
    return memories(spark, sf).where(F.col("created_at") >= F.expr(f"timestamp_ntz'{since}'")).select("id")


@query("C10 C12", "SELECT page_id, len(regexp_extract_all(html, 'https?://[^\\s\"'']+')) AS urls, len(regexp_extract_all(html, '\\b\\d{3,}\\b')) AS numbers FROM pages WHERE regexp_matches(html, '(?ms)^.{120,}$') OR regexp_matches(html, '\\b\\d{3,}\\b')")
def regex_count(spark, sf):
    p = table(spark, sf, "pages").where(T.matches(F.col("html"), "@preset:long_lines") | T.matches(F.col("html"), "@preset:magic_numbers"))
    return p.select("page_id", T.match_count(F.col("html"), "@preset:hardcoded_urls").cast("long").alias("urls"), T.match_count(F.col("html"), "@preset:magic_numbers").cast("long").alias("numbers"))


#: A text for each preset, and one that holds several.
SNIPPETS = ["try: x", "try:\n  f()\nexcept:\n  pass", "catch (Exception e) {}", "// TODO: later", "@Deprecated", "password = 1", "authorize(user)", "await f()", "n = 12345", "y" * 130, "return 1\nreturn 2\n", "config.port", "see https://x.org/a'", "nothing"]
_PRESET_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({n!r}, '(?ms){p.replace(chr(39), chr(39) * 2)}')" for n, p in T.PRESETS.items()) + ") AS p(preset, pattern)"
_SNIPPET_SQL = "SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(i, x.replace("'", "''").replace("\n", "' || chr(10) || '")) for i, x in enumerate(SNIPPETS)) + ") AS s(snippet, body)"


@query("C15", f"WITH p AS ({_PRESET_SQL}), s AS ({_SNIPPET_SQL}) SELECT snippet, preset, len(regexp_extract_all(body, pattern)) AS n FROM p, s WHERE regexp_matches(body, pattern)")
def regex_presets(spark, sf):
    """Every preset over a few literal texts."""
    s = spark.createDataFrame(list(enumerate(SNIPPETS)), "snippet int, body string")
    found = [s.where(T.matches(F.col("body"), f"@preset:{n}")).select("snippet", F.lit(n).alias("preset"), T.match_count(F.col("body"), f"@preset:{n}").cast("long").alias("n")) for n in T.PRESETS]
    return functools.reduce(DataFrame.union, found)


@query("C11", "SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"[^\"]*\"'), ' ') AS links FROM pages")
def regex_find_all(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(T.find_matches(F.col("html"), 'href="[^"]*"'), " ").alias("links"))


@query("C13", "WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages) SELECT page_id, CAST(line AS INTEGER) AS line, CAST(instr(x, regexp_extract(x, '<p>[^<]*')) AS INTEGER) AS \"column\" FROM l WHERE regexp_matches(x, '<p>[^<]*')")
def match_locations(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(T.match_lines(F.col("html"), "<p>[^<]*")).alias("m")).select("page_id", "m.line", "m.column")


@query("C14", "WITH p AS (SELECT page_id, html, len(regexp_extract_all(html, '<p>')) AS n, len(string_split(html, chr(10))) AS lines, regexp_matches(array_to_string(string_split(html, chr(10))[1:2], chr(10)), '<p>') AS head FROM pages) SELECT page_id, round(CASE WHEN n > 0 THEN least(1.0, 0.5 + least(0.2, 0.05 * n) + CASE WHEN head THEN 0.2 ELSE 0 END + least(0.1, n / lines * 10)) ELSE 0 END::DOUBLE, 6) AS score FROM p")
def pattern_score(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.round(T.pattern_score(F.col("html"), "<p>"), 6).alias("score"))


@query("C16 C17 C18", "SELECT page_id, length(trim(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))) AS n, CASE WHEN regexp_matches(html, '(?i)(union\\s+select|drop\\s+table|or\\s+1\\s*=\\s*1)') THEN 'sql' WHEN regexp_matches(html, '(?i)(ignore\\s+(all\\s+)?previous|system\\s+prompt)') THEN 'prompt' WHEN regexp_matches(html, '(;\\s*rm\\s|\\$\\(|&&\\s*curl)') THEN 'command' WHEN regexp_matches(html, '(\\.\\./|/etc/passwd)') THEN 'path' END AS risk FROM pages")
def sanitize_and_detect(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(T.sanitized(F.col("html"))).cast("long").alias("n"), T.injection(F.col("html")).alias("risk"))


SORTS = ["importance", "created_at; DROP TABLE mem", "created_at", "content"]


@query("C16 G1", f"{MEM}, a AS (SELECT 'importance' AS sort, id, row_number() OVER (ORDER BY importance DESC, id) AS place FROM mem UNION ALL SELECT 'created_at', id, row_number() OVER (ORDER BY created_at DESC, id) FROM mem) SELECT sort, id, place FROM a WHERE place <= 20")
def validated_lists(spark, sf):
    """First pages by columns that a caller names: what isn't a sortable column is refused before a plan is built."""
    from strandline.operators.filters import validated_sort

    pages = []
    for name in SORTS:
        try:
            column = validated_sort(name)
        except ValueError:
            continue
        best = memories(spark, sf).select("id", column).orderBy(F.col(column).desc(), "id").limit(20)
        pages.append(best.select(F.lit(name).alias("sort"), "id", F.row_number().over(Window.orderBy(F.col(column).desc(), "id")).cast("long").alias("place")))
    return functools.reduce(DataFrame.union, pages)


@query("C19 I17", "WITH s AS (SELECT event_id, value / 500 AS s FROM events) SELECT event_id, CASE WHEN s > 0.8 THEN 'excellent' WHEN s >= 0.6 THEN 'good' ELSE 'weak' END AS label, CASE WHEN s >= 0.95 THEN 'high' WHEN s >= 0.85 THEN 'medium' WHEN s >= 0.75 THEN 'low' ELSE 'none' END AS band FROM s")
def score_labels(spark, sf):
    s = F.col("value") / 500
    return table(spark, sf, "events").select("event_id", X.confidence_label(s).alias("label"), X.similarity_band(s).alias("band"))


@query("A2", f"{MEM} SELECT id, project_name, importance FROM mem WHERE id = 17")
def point_lookup(spark, sf):
    return memories(spark, sf).where("id = 17").limit(1).select("id", "project_name", "importance")


@query("A1 E1", f"{MEM} SELECT count(*) AS n, count(*) FILTER (importance > 0.7) AS n_important FROM mem")
def count_rows(spark, sf):
    return memories(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("importance") > 0.7).alias("n_important"))


@query("G6", f"{MEM} SELECT id, round(c, 6) AS confidence FROM (SELECT id, CASE provenance_source WHEN 'user_explicit' THEN 0.9 WHEN 'documentation' THEN 0.85 WHEN 'code_indexed' THEN 0.8 WHEN 'inferred' THEN 0.7 WHEN 'auto_classified' THEN 0.6 ELSE 0.5 END::DOUBLE AS c FROM mem) WHERE c < 0.6 ORDER BY c, id LIMIT 50")
def low_confidence(spark, sf):
    m = memories(spark, sf).withColumn("c", X.source_confidence(F.col("provenance_source")))
    return m.where("c < 0.6").orderBy("c", "id").limit(50).select("id", F.round("c", 6).alias("confidence"))


@query("G7", f"{MEM} SELECT id, created_at FROM mem WHERE NOT verified AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 45 DAY ORDER BY created_at, id LIMIT 50")
def unverified_old(spark, sf):
    return memories(spark, sf).where(~F.col("verified") & (F.col("created_at") < as_of() - F.make_dt_interval(F.lit(45)))).orderBy("created_at", "id").limit(50).select("id", "created_at")


# aggregates


@query("E2", f"{MEM} SELECT DISTINCT project_name FROM mem WHERE project_name IS NOT NULL")
def distinct_projects(spark, sf):
    return memories(spark, sf).select("project_name").where("project_name IS NOT NULL").distinct()


@query("E3 Q21", f"{MEM} SELECT project_name, count(*) AS n, count(DISTINCT category) AS n_categories, count(*) FILTER (context_level = 'SESSION_STATE') AS n_session, max(created_at) AS last_update, count(*) FILTER (lifecycle_state = 'STALE') AS n_stale FROM mem GROUP BY project_name")
def project_stats(spark, sf):
    return memories(spark, sf).groupBy("project_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("category").alias("n_categories"),
        F.count_if(F.col("context_level") == "SESSION_STATE").alias("n_session"),
        F.max("created_at").alias("last_update"),
        F.count_if(F.col("lifecycle_state") == "STALE").alias("n_stale"),
    )


@query("E4", f"{MEM} SELECT project_name, min(category) AS language, max(last_accessed) AS last_indexed, count(*) AS n_units FROM mem GROUP BY project_name ORDER BY last_indexed DESC, project_name LIMIT 10 OFFSET 5")
def indexed_files(spark, sf):
    g = memories(spark, sf).groupBy("project_name").agg(F.min("category").alias("language"), F.max("last_accessed").alias("last_indexed"), F.count(F.lit(1)).alias("n_units"))
    return g.orderBy(F.col("last_indexed").desc(), "project_name").offset(5).limit(10)


@query("E5 B7 B14", f"{MEM} SELECT 'category' AS dimension, category AS value, count(*) AS n FROM mem GROUP BY 2 UNION ALL SELECT 'project_name', project_name, count(*) FROM mem GROUP BY 2 UNION ALL SELECT 'lifecycle_state', lifecycle_state, count(*) FROM mem GROUP BY 2")
def facets(spark, sf):
    return L.breakdown(memories(spark, sf), "category", "project_name", "lifecycle_state")


@query("E6", f"{MEM} SELECT 'Found ' || count(*) || ' rows in ' || count(DISTINCT project_name) || ' projects and ' || count(DISTINCT category) || ' categories' AS summary FROM mem")
def result_summary(spark, sf):
    g = memories(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("project_name").alias("p"), F.countDistinct("category").alias("c"))
    return g.select(F.format_string("Found %d rows in %d projects and %d categories", "n", "p", "c").alias("summary"))


@query("E7", f"{MEM} SELECT project_name, category, count(*) AS n, count(*) FILTER (scope = 'global') AS n_global, grouping(project_name) + grouping(category) AS level FROM mem GROUP BY ROLLUP (project_name, category)")
def dashboard_stats(spark, sf):
    r = memories(spark, sf).rollup("project_name", "category")
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("scope") == "global").alias("n_global"), (F.grouping("project_name") + F.grouping("category")).cast("long").alias("level"))


@query("E8", f"{MEM} SELECT id, CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS shown FROM mem ORDER BY created_at DESC, id LIMIT 20")
def recent_activity(spark, sf):
    shown = F.when(F.length("content") > 100, F.concat(F.substring("content", 1, 100), F.lit("..."))).otherwise(F.col("content"))
    return memories(spark, sf).orderBy(F.col("created_at").desc(), "id").limit(20).select("id", shown.alias("shown"))


@query("E18 E20", f"{MEM}, {LOG_SQL} SELECT (SELECT count(*) FROM mem) AS n_rows, (SELECT round(count(*) FILTER (lifecycle_state = 'STALE') / count(*), 6) FROM mem) AS noise, (SELECT round(avg(latency_ms), 6) FROM log) AS avg_latency, (SELECT count(*) / 30 FROM log) AS per_day")
def metrics_snapshot(spark, sf):
    m = memories(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.count_if(F.col("lifecycle_state") == "STALE") / F.count(F.lit(1)), 6).alias("noise"))
    q = query_log(spark, sf).agg(F.round(F.avg("latency_ms"), 6).alias("avg_latency"), (F.count(F.lit(1)) / 30).alias("per_day"))
    return m.crossJoin(F.broadcast(q))  # one row each


@query("E36", f"{MEM} SELECT count(*) AS n, CAST(sum(CASE WHEN verified THEN 1 ELSE 0 END) AS BIGINT) AS n_in, CAST(sum(CASE WHEN verified THEN 0 ELSE 1 END) AS BIGINT) AS n_out FROM mem")
def consent_stats(spark, sf):
    return memories(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("verified"), 1).otherwise(0)).cast("long").alias("n_in"), F.sum(F.when(F.col("verified"), 0).otherwise(1)).cast("long").alias("n_out"))


@query("E38 E39", f"{MEM} SELECT lifecycle_state, count(*) AS n, CAST(sum(strlen(content) + 3072) AS BIGINT) AS bytes FROM mem GROUP BY lifecycle_state")
def storage_by_state(spark, sf):
    return L.storage_by_state(memories(spark, sf))


@query("E40", f"{MEM} SELECT lifecycle_state, count(*) AS n, CAST(sum(strlen(content) + 3072) AS BIGINT) AS bytes, round(sum(strlen(content) + 3072) * 0.4::DOUBLE, 3) AS saving FROM mem WHERE strlen(content) + 3072 > 10240 GROUP BY lifecycle_state")
def large_rows(spark, sf):
    return L.large_rows(memories(spark, sf)).withColumn("saving", F.round("saving", 3))


@query("E41", f"{MEM}, g AS (SELECT category || '_' || context_level || '_' || CAST(floor(length(content) / 100) * 100 AS BIGINT) AS signature, count(*) AS n, sum(strlen(content) + 3072) - arg_min(strlen(content) + 3072, id) AS bytes FROM mem GROUP BY 1) SELECT signature, n, CAST(bytes AS BIGINT) AS bytes FROM g WHERE n >= 2")
def duplicate_signatures(spark, sf):
    return L.duplicate_signatures(memories(spark, sf)).withColumn("bytes", F.col("bytes").cast("long"))


@query("E42 E43 L10", f"{MEM} SELECT count(*) FILTER (lifecycle_state = 'STALE' AND last_accessed < TIMESTAMP '{AS_OF}' - INTERVAL 40 DAY) AS n_stale, count(*) FILTER (context_level = 'SESSION_STATE' AND last_accessed < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR) AS n_expired FROM mem")
def stale_opportunities(spark, sf):
    old = lambda days: F.col("last_accessed") < as_of() - F.make_dt_interval(F.lit(days))
    return memories(spark, sf).agg(F.count_if((F.col("lifecycle_state") == "STALE") & old(40)).alias("n_stale"), F.count_if((F.col("context_level") == "SESSION_STATE") & old(2)).alias("n_expired"))


@query("E44", f"{MEM} SELECT count(*) AS n, round(avg(importance), 6) AS mean, round(median(importance), 6) AS median, min(importance) AS low, max(importance) AS high, count(*) FILTER (importance < 0.2) AS b0, count(*) FILTER (importance >= 0.2 AND importance < 0.4) AS b1, count(*) FILTER (importance >= 0.4 AND importance < 0.6) AS b2, count(*) FILTER (importance >= 0.6 AND importance < 0.8) AS b3, count(*) FILTER (importance >= 0.8) AS b4 FROM mem")
def importance_summary(spark, sf):
    i = F.col("importance")
    bins = [F.count_if((i >= k / 5) & (i < (k + 1) / 5 if k < 4 else F.lit(True))).alias(f"b{k}") for k in range(1, 5)]
    return memories(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(i), 6).alias("mean"), F.round(F.median(i), 6).alias("median"), F.min(i).alias("low"), F.max(i).alias("high"), F.count_if(i < 0.2).alias("b0"), *bins)


@query("E45", f"{MEM}, c AS (SELECT category, count(*) AS n FROM mem GROUP BY 1) SELECT (SELECT count(DISTINCT project_name) FROM mem) AS n_files, category, n FROM c ORDER BY n DESC, category LIMIT 10")
def indexed_stats(spark, sf):
    m = memories(spark, sf)
    c = m.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category").limit(10)
    return c.crossJoin(F.broadcast(m.agg(F.countDistinct("project_name").alias("n_files"))))  # one row


@query("E47 N1", f"{MEM}, t AS (SELECT unnest(tags) AS tag FROM mem) SELECT tag, count(*) AS n FROM t GROUP BY tag")
def tag_counts(spark, sf):
    return memories(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("E48 N2", "WITH w AS (SELECT n_regionkey AS workspace, list(n_nationkey ORDER BY n_nationkey) AS repos FROM nation GROUP BY 1) SELECT count(*) AS n_workspaces, CAST(sum(len(repos)) AS BIGINT) AS n_memberships, round(avg(len(repos)), 2) AS avg_memberships FROM w")
def workspace_stats(spark, sf):
    w = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("workspace")).agg(F.collect_list("n_nationkey").alias("repos"))
    return w.agg(F.count(F.lit(1)).alias("n_workspaces"), F.sum(F.size("repos")).cast("long").alias("n_memberships"), F.round(F.avg(F.size("repos")), 2).alias("avg_memberships"))


@query("E50", "WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS dir, strlen(html) AS size FROM pages) SELECT dir, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, sum(size) > 20000 AS exclude FROM p GROUP BY dir")
def directory_analysis(spark, sf):
    g = table(spark, sf, "pages").groupBy(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))
    return g.withColumn("exclude", F.col("bytes") > 20000)


@query("E51 E52", f"{LOG}, h AS (SELECT CAST(timestamp AS DATE) AS day, avg(latency_ms) AS l, count(*) FILTER (kind = 'error') / count(*) AS e, count(*) FILTER (relevance IS NOT NULL) / count(*) AS h FROM log GROUP BY 1), s AS (SELECT day, greatest(0, 100 - CASE WHEN l > 100 THEN 30 WHEN l > 50 THEN 15 ELSE 0 END - CASE WHEN e > 0.1 THEN 40 WHEN e > 0.02 THEN 20 ELSE 0 END - CASE WHEN h < 0.5 THEN 20 WHEN h < 0.8 THEN 10 ELSE 0 END) AS score FROM h) SELECT day, CAST(score AS INTEGER) AS score, CASE WHEN score < 50 THEN 'act now' WHEN score < 80 THEN 'look into errors' ELSE 'fine' END AS insight FROM s")
def health_score(spark, sf):
    h = M.daily(query_log(spark, sf), "timestamp", F.avg("latency_ms").alias("l"), (F.count_if(F.col("kind") == "error") / F.count(F.lit(1))).alias("e"), (F.count("relevance") / F.count(F.lit(1))).alias("h"))
    s = h.select("day", X.health_score(F.col("l"), F.col("e"), F.col("h")).alias("score"))
    return s.withColumn("insight", F.when(F.col("score") < 50, "act now").when(F.col("score") < 80, "look into errors").otherwise("fine"))


# git


@query("D1", f"{GIT} SELECT c.commit_hash, author, author_date, lines_added FROM changes c JOIN commits USING (commit_hash) WHERE file_path = 42 ORDER BY author_date DESC, c.commit_hash LIMIT 100")
def commits_by_file(spark, sf):
    return G.commits_by_file(commits(spark, sf), file_changes(spark, sf), 42).select("commit_hash", "author", "author_date", "lines_added")


CHURN_SQL = f"""{GIT}, per AS (SELECT file_path, count(*) AS n_changes, min(author_date) AS first_change, max(author_date) AS last_change, CAST(sum(lines_added) AS BIGINT) AS added, CAST(sum(lines_deleted) AS BIGINT) AS deleted, count(DISTINCT author) AS n_authors FROM changes JOIN commits USING (commit_hash) GROUP BY file_path)
SELECT *, round(n_changes / greatest(0.1, date_diff('day', first_change, last_change) / 7), 6) AS per_week, round(least(1, n_changes / greatest(0.1, date_diff('day', first_change, last_change) / 7) / 5 * ((added + deleted) / n_changes / 100)), 6) AS score FROM per"""


@query("E9", CHURN_SQL)
def churn(spark, sf):
    return G.churn(commits(spark, sf), file_changes(spark, sf)).withColumn("per_week", F.round("per_week", 6)).withColumn("score", F.round("score", 6))


@query("E10 Q14", f"{GIT} SELECT file_path, count(*) AS n_changes, count(DISTINCT author) AS n_authors, CAST(sum(lines_added + lines_deleted) AS BIGINT) AS lines FROM changes JOIN commits USING (commit_hash) WHERE author_date >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY GROUP BY file_path HAVING count(*) >= 5 ORDER BY n_changes DESC, file_path LIMIT 10")
def churn_hotspots(spark, sf):
    return G.hotspots(commits(spark, sf), file_changes(spark, sf), as_of("2001-08-01 00:00:00"), days=365)


@query("E11", f"{GIT} SELECT author, count(DISTINCT commit_hash) AS n_commits, CAST(sum(lines_added) AS BIGINT) AS added, CAST(sum(lines_deleted) AS BIGINT) AS deleted, min(author_date) AS first_commit, max(author_date) AS last_commit FROM changes JOIN commits USING (commit_hash) GROUP BY author")
def code_authors(spark, sf):
    return G.authors(commits(spark, sf), file_changes(spark, sf))


@query("E12", f"{GIT} SELECT commit_hash, author_date, date_diff('day', author_date, TIMESTAMP '2001-08-01') AS days_ago FROM commits WHERE author_date >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY ORDER BY author_date DESC, commit_hash LIMIT 50")
def recent_changes(spark, sf):
    now = as_of("2001-08-01 00:00:00")
    c = commits(spark, sf).where(F.col("author_date") >= now - F.make_dt_interval(F.lit(30)))
    return c.orderBy(F.col("author_date").desc(), "commit_hash").limit(50).select("commit_hash", "author_date", F.timestamp_diff("DAY", F.col("author_date"), now).alias("days_ago"))


@query("F10 Q25", f"{GIT}, o AS (SELECT c.commit_hash, file_path, author_date, lines_added, lines_deleted, lag(author_date) OVER w AS p, lag(lines_added) OVER w AS added_before FROM changes c JOIN commits USING (commit_hash) WINDOW w AS (PARTITION BY file_path ORDER BY author_date, c.commit_hash, lines_added, lines_deleted)) SELECT file_path, commit_hash, author_date, lines_added, lines_deleted, date_diff('day', p, author_date) AS days_since, added_before FROM o")
def evolution_lag(spark, sf):
    return G.evolution(commits(spark, sf), file_changes(spark, sf)).select("file_path", "commit_hash", "author_date", "lines_added", "lines_deleted", "days_since", "added_before")


@query("A9", "WITH d AS (SELECT page_id, replace(html, '<', chr(10) || '+<') AS diff FROM pages) SELECT page_id, CAST(len(list_filter(string_split(diff, chr(10)), lambda x: regexp_matches(x, '^\\+') AND NOT regexp_matches(x, '^\\+\\+\\+'))) AS INTEGER) AS added, CAST(len(list_filter(string_split(diff, chr(10)), lambda x: regexp_matches(x, '^-') AND NOT regexp_matches(x, '^---'))) AS INTEGER) AS deleted FROM d")
def diff_line_counts(spark, sf):
    d = table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("<"), F.lit("\n+<")).alias("diff"))
    return d.select("page_id", G.diff_lines(F.col("diff"), "+").alias("added"), G.diff_lines(F.col("diff"), "-").alias("deleted"))


# metrics


@query("E13 E16 E17 E15", f"{LOG} SELECT kind, round(avg(latency_ms), 6) AS avg_latency, round(avg(relevance), 6) AS avg_relevance, round(avg(result_count), 6) AS avg_results, count(*) / 30 AS per_day FROM log GROUP BY kind")
def query_averages(spark, sf):
    return query_log(spark, sf).groupBy("kind").agg(F.round(F.avg("latency_ms"), 6).alias("avg_latency"), F.round(F.avg("relevance"), 6).alias("avg_relevance"), F.round(F.avg("result_count"), 6).alias("avg_results"), (F.count(F.lit(1)) / 30).alias("per_day"))


@query("E14 Q12", f"{LOG}, r AS (SELECT kind, latency_ms, row_number() OVER (PARTITION BY kind ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM log) SELECT kind, latency_ms AS p95 FROM r WHERE i = least(floor(n * 0.95), n - 1)")
def p95_nearest_rank(spark, sf):
    return M.nearest_rank(query_log(spark, sf), ["kind"], "latency_ms", 0.95, "p95")


FIRST, LAST = "2024-01-08", "2024-01-21"


def _sketches(spark, sf):
    path = scratch_path(spark, "sketches")
    K.write_sketches(K.daily_sketches(query_log(spark, sf), "timestamp", ["kind"], "latency_ms"), path)
    return path


@query("E14 E53")
def sketch_history(spark, sf):
    """Median, p95 and p99 of two weeks for each kind, from the sketches of their days. Ranks are tested against all rows."""
    return K.quantiles(K.merged(spark, _sketches(spark, sf), FIRST, LAST, ["kind"]), ["kind"], p50=0.5, p95=0.95, p99=0.99)


@query("E14 E53 L20", f"{LOG} SELECT kind, count(latency_ms) AS n, true AS within FROM log WHERE CAST(timestamp AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY kind")
def sketch_rank_bound(spark, sf):
    """The same sketches against the rows they stand for: whether the p95's rank is off by no more than the bound."""
    found = K.quantiles(K.merged(spark, _sketches(spark, sf), FIRST, LAST, ["kind"]), ["kind"], p95=0.95)
    rows = query_log(spark, sf).where(F.to_date("timestamp").between(F.to_date(F.lit(FIRST)), F.to_date(F.lit(LAST))) & F.col("latency_ms").isNotNull())
    per = rows.join(F.broadcast(found), "kind").groupBy("kind", "n").agg(F.avg((F.col("latency_ms") < F.col("p95")).cast("int")).alias("below"), F.avg((F.col("latency_ms") <= F.col("p95")).cast("int")).alias("upto"))  # a row a kind
    return per.select("kind", "n", ((F.col("below") - K.RANK_ERROR <= 0.95) & (F.col("upto") + K.RANK_ERROR >= 0.95)).alias("within"))


@query("L9 E14 L20", f"{LOG} SELECT CAST(timestamp AS DATE) AS day, kind, count(latency_ms) AS n FROM log GROUP BY ALL")
def stream_sketches(spark, sf):
    """A sketch a day and kind from the stream of events."""
    from strandline.streaming.streams import drained, event_stream

    d = drained(K.daily_sketches(event_stream(spark, sf), "timestamp", ["kind"], "latency_ms"), "complete")
    return K.quantiles(d, ["day", "kind"]).select("day", "kind", "n")


@query("C15", "SELECT page_id, 'hardcoded_urls' AS preset, CAST(len(regexp_extract_all(html, 'https?://[^\\s\"'']+')) AS BIGINT) AS n FROM pages WHERE regexp_matches(html, 'https?://[^\\s\"'']+') UNION ALL SELECT page_id, 'magic_numbers', CAST(len(regexp_extract_all(html, '\\b\\d{3,}\\b')) AS BIGINT) FROM pages WHERE regexp_matches(html, '\\b\\d{3,}\\b') UNION ALL SELECT page_id, 'security_keywords', CAST(len(regexp_extract_all(html, '(password|secret|token|api[_-]?key|private[_-]?key)')) AS BIGINT) FROM pages WHERE regexp_matches(html, '(password|secret|token|api[_-]?key|private[_-]?key)')")
def regex_presets_of_pages(spark, sf):
    """Three of the presets over all pages."""
    p = table(spark, sf, "pages").select("page_id", "html")
    found = [p.where(T.matches(F.col("html"), f"@preset:{n}")).select("page_id", F.lit(n).alias("preset"), T.match_count(F.col("html"), f"@preset:{n}").cast("long").alias("n")) for n in ("hardcoded_urls", "magic_numbers", "security_keywords")]
    return functools.reduce(DataFrame.union, found)


@query("E19 L9 E53", f"{LOG} SELECT CAST(timestamp AS DATE) AS day, count(*) AS n, round(avg(latency_ms), 6) AS avg_latency, CAST(floor(avg(result_count)) AS INTEGER) AS avg_results FROM log GROUP BY 1")
def daily_metrics(spark, sf):
    return M.daily(query_log(spark, sf), "timestamp", F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"), F.avg("result_count").cast("int").alias("avg_results"))


@query("E53", f"{LOG}, d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day), n AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM log WHERE kind = 'purchase' GROUP BY 1) SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (day)")
def trend_series(spark, sf):
    days = M.daily(query_log(spark, sf).where("kind = 'purchase'"), "timestamp", F.count(F.lit(1)).alias("n"))
    return M.zero_filled(days, "2023-12-25", "2024-02-05", "n")


@query("E21 E22 E27 F8", f"{LOG}, k AS (SELECT * FROM log WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) SELECT kind, count(*) AS n, max(timestamp) AS latest, arg_max(latency_ms, timestamp) AS last_latency FROM k GROUP BY kind")
def metrics_history(spark, sf):
    kept = query_log(spark, sf).where(F.col("timestamp") >= as_of("2024-01-31 00:00:00") - F.make_dt_interval(F.lit(7)))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("latest"), F.max_by("latency_ms", "timestamp").alias("last_latency"))


BASE_SQL = f"""{LOG}, b AS (SELECT kind, avg(latency_ms) AS mean, stddev_samp(latency_ms) AS stdev, min(latency_ms) AS low, max(latency_ms) AS high, count(latency_ms) AS n FROM log WHERE timestamp < TIMESTAMP '2024-01-24' GROUP BY kind HAVING count(latency_ms) >= 10),
c AS (SELECT kind, avg(latency_ms) AS value FROM log WHERE timestamp >= TIMESTAMP '2024-01-24' GROUP BY kind)"""


def _baseline(spark, sf):
    log = query_log(spark, sf)
    cut = as_of("2024-01-24 00:00:00")
    return M.baseline(log.where(F.col("timestamp") < cut), "kind", "latency_ms"), log.where(F.col("timestamp") >= cut).groupBy("kind").agg(F.avg("latency_ms").alias("value"))


@query("E23", f"{BASE_SQL} SELECT kind, round(mean, 6) AS mean, round(stdev, 6) AS stdev, low, high, n FROM b")
def baseline(spark, sf):
    return _baseline(spark, sf)[0].withColumn("mean", F.round("mean", 6)).withColumn("stdev", F.round("stdev", 6))


REG_SQL = f"{BASE_SQL}, r AS (SELECT kind, value, CASE WHEN kind IN ('error', 'click') THEN (value - mean) / mean ELSE (mean - value) / mean END AS degradation FROM c JOIN b USING (kind)), s AS (SELECT kind, round(value, 6) AS value, round(degradation, 6) AS degradation, CASE WHEN degradation <= 0 THEN 'NONE' WHEN degradation >= 0.6 THEN 'CRITICAL' WHEN degradation >= 0.4 THEN 'SEVERE' WHEN degradation >= 0.25 THEN 'MODERATE' WHEN degradation >= 0.1 THEN 'MINOR' ELSE 'NONE' END AS severity FROM r)"


def _regressions(spark, sf):
    base, now = _baseline(spark, sf)
    return M.regressions(base, now, "kind", F.col("kind").isin("error", "click")).select("kind", F.round("value", 6).alias("value"), F.round("degradation", 6).alias("degradation"), "severity")


@query("E24 E25", f"{REG_SQL} SELECT * FROM s")
def regression(spark, sf):
    return _regressions(spark, sf)


@query("E26", f"{REG_SQL} SELECT count(*) AS n_metrics, count(*) FILTER (degradation > 0) AS n_worse, round(max(degradation), 6) AS worst FROM s")
def performance_report(spark, sf):
    return _regressions(spark, sf).agg(F.count(F.lit(1)).alias("n_metrics"), F.count_if(F.col("degradation") > 0).alias("n_worse"), F.round(F.max("degradation"), 6).alias("worst"))


GROW_SQL = f"""{LOG}, d AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM log GROUP BY 1), t AS (SELECT CAST(day AS TIMESTAMP) AS stamp, CAST(sum(n) OVER (ORDER BY day) AS DOUBLE) AS total FROM d),
g AS (SELECT regr_slope(total, epoch_us(stamp) / 86400000000.0) AS slope, arg_max(total, stamp) AS last FROM t)"""


def _growth(spark, sf):
    d = M.daily(query_log(spark, sf), "timestamp", F.count(F.lit(1)).alias("n"))
    # one row a day: the window runs over as many rows as the log has days
    t = d.select(F.col("day").cast("timestamp_ntz").alias("at"), F.sum("n").over(Window.orderBy("day")).cast("double").alias("total"))
    return M.growth(t, "at", "total")


@query("E28", f"{GROW_SQL} SELECT round(slope, 3) AS slope, last FROM g")
def growth_slope(spark, sf):
    return _growth(spark, sf).select(F.round("slope", 3).alias("slope"), "last")


@query("E29 E30 E31", f"{GROW_SQL} SELECT round(last + slope * 30, 2) AS forecast, CASE WHEN slope > 10 THEN 'GROWING' WHEN slope < -10 THEN 'SHRINKING' ELSE 'STABLE' END AS trend, CASE WHEN last >= 40000 THEN 0 WHEN slope > 0 THEN CAST(trunc((40000 - last) / slope) AS INTEGER) END AS days_to_warning, CASE WHEN last >= 50000 THEN 0 WHEN slope > 0 THEN CAST(trunc((50000 - last) / slope) AS INTEGER) END AS days_to_critical, CASE WHEN greatest(last, last + slope * 30) >= 50000 THEN 'CRITICAL' WHEN greatest(last, last + slope * 30) >= 40000 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM g")
def capacity(spark, sf):
    return M.forecast(_growth(spark, sf), 30, 40_000, 50_000, 10).select(F.round("forecast", 2).alias("forecast"), "trend", "days_to_warning", "days_to_critical", "status")


@query("E32", f"{GROW_SQL} SELECT CASE WHEN last >= 50000 THEN 'CRITICAL' WHEN last >= 9000 THEN 'WARNING' ELSE 'HEALTHY' END AS overall FROM g")
def overall_capacity(spark, sf):
    g = _growth(spark, sf)
    a = F.when(F.col("last") >= 50_000, "CRITICAL").otherwise("HEALTHY")
    b = F.when(F.col("last") >= 9_000, "WARNING").otherwise("HEALTHY")
    return g.select(M.worst(a, b, F.lit("HEALTHY")).alias("overall"))


@query("E33 E34 N7", f"{LOG} SELECT kind, count(*) AS n, CAST(sum((result_count % 2)) AS BIGINT) AS accepted, round(coalesce(avg(result_count % 2), 0), 6) AS rate FROM log GROUP BY ROLLUP (kind)")
def acceptance_rate(spark, sf):
    yes = F.col("result_count") % 2
    return query_log(spark, sf).rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(yes).alias("accepted"), F.round(F.coalesce(F.avg(yes), F.lit(0.0)), 6).alias("rate"))


@query("E35", f"{LOG}, a AS (SELECT kind, count(*) AS n, avg(result_count % 2) AS rate FROM log GROUP BY kind) SELECT kind, round(CASE WHEN n < 10 THEN 0.8 ELSE least(0.95, greatest(0.7, CASE WHEN rate < 0.6 THEN 0.85 WHEN rate > 0.8 THEN 0.75 ELSE 0.8 END)) END::DOUBLE, 2) AS threshold FROM a")
def threshold_adjustment(spark, sf):
    a = query_log(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("result_count") % 2).alias("rate"))
    return a.select("kind", F.round(M.adjusted_threshold(F.lit(0.8), F.col("rate"), F.col("n")), 2).alias("threshold"))


@query("E37", f"{LOG}, l AS (SELECT session_id, latency_ms, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS r FROM log) SELECT session_id, round(avg(latency_ms), 6) AS avg_last FROM l WHERE r <= 10 GROUP BY session_id")
def average_of_latest(spark, sf):
    from strandline.operators.sessions import last_of_each

    return last_of_each(query_log(spark, sf), "session_id", "timestamp", 10, "id").groupBy("session_id").agg(F.round(F.avg("latency_ms"), 6).alias("avg_last"))


@query("E54", f"{LOG} SELECT kind, count(*) FILTER (relevance IS NOT NULL) AS hits, count(*) FILTER (relevance IS NULL) AS misses, round(count(relevance) / count(*), 6) AS hit_rate FROM log GROUP BY kind")
def cache_counters(spark, sf):
    return query_log(spark, sf).groupBy("kind").agg(F.count("relevance").alias("hits"), F.count_if(F.col("relevance").isNull()).alias("misses"), F.round(F.count("relevance") / F.count(F.lit(1)), 6).alias("hit_rate"))


@query("A14 B4", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_props(spark, sf):
    from strandline.sources.exchange import decoded

    return decoded(table(spark, sf, "events").select("event_id", "event_type", "props"), "props", "k long").select("event_id", "k", "event_type")


@query("L20", f"{LOG}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS hour, avg(latency_ms) AS l, count(*) FILTER (kind = 'error') / count(*) AS e FROM log GROUP BY 1) SELECT hour, CASE WHEN l > 60 THEN 'slow' WHEN e > 0.4 THEN 'errors' ELSE 'ok' END AS alert FROM w")
def windowed_alerts(spark, sf):
    w = query_log(spark, sf).groupBy(F.window("timestamp", "1 hour").alias("w")).agg(F.avg("latency_ms").alias("l"), (F.count_if(F.col("kind") == "error") / F.count(F.lit(1))).alias("e"))
    return w.select(F.col("w.start").alias("hour"), F.when(F.col("l") > 60, "slow").when(F.col("e") > 0.4, "errors").otherwise("ok").alias("alert"))
