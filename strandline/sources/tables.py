"""Reads the provided tables and presents them in the engine's data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time that ages are counted back from; every time-dependent operator takes such an argument.
AS_OF = "2024-03-01 00:00:00"


def as_of(text: str = AS_OF) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


LEVELS = ["USER_PREFERENCE", "PROJECT_CONTEXT", "SESSION_STATE"]
STATES = ["ACTIVE", "RECENT", "ARCHIVED", "STALE"]
SOURCES = ["user_explicit", "inferred", "documentation", "code_indexed", "auto_classified", "imported", "legacy"]


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as memory rows; what the tables lack is derived from doc_id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("category"), F.col("source").alias("project_name"), "n_chars")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    i = F.col("id")
    return docs.join(labels, "id", "left").select(
        "id",
        "content",
        "category",
        "project_name",
        "n_chars",
        _pick(LEVELS, i).alias("context_level"),
        F.when(i % 4 == 0, "global").otherwise("project").alias("scope"),
        ((F.coalesce(F.col("quality") * 60 + 20, F.lit(50)) + (i % 5) * 4) / 100).alias("importance"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 80000 as int), 0)").alias("created_at"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 80000 as int) + 60 * cast(id % 97 as int), 0)").alias("last_accessed"),
        _pick(STATES, i).alias("lifecycle_state"),
        _pick(SOURCES, i).alias("provenance_source"),
        (i % 5 == 0).alias("verified"),
        (i * 7 % 53).alias("use_count"),
        F.array(F.col("category"), F.concat(F.lit("t"), i % 7), F.concat(F.lit("u"), i % 3)).alias("tags"),
    )


#: The same rows for DuckDB, as a common table expression named mem.
MEM_SQL = """mem AS (
SELECT d.doc_id AS id, d.text AS content, d.lang AS category, d.source AS project_name, d.n_chars,
 (['USER_PREFERENCE','PROJECT_CONTEXT','SESSION_STATE'])[d.doc_id % 3 + 1] AS context_level,
 CASE WHEN d.doc_id % 4 = 0 THEN 'global' ELSE 'project' END AS scope,
 (coalesce(l.quality * 60 + 20, 50) + (d.doc_id % 5) * 4) / 100 AS importance,
 TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id % 80000) AS created_at,
 TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id % 80000 + 60 * (d.doc_id % 97)) AS last_accessed,
 (['ACTIVE','RECENT','ARCHIVED','STALE'])[d.doc_id % 4 + 1] AS lifecycle_state,
 (['user_explicit','inferred','documentation','code_indexed','auto_classified','imported','legacy'])[d.doc_id % 7 + 1] AS provenance_source,
 d.doc_id % 5 = 0 AS verified, d.doc_id * 7 % 53 AS use_count,
 [d.lang, 't' || d.doc_id % 7, 'u' || d.doc_id % 3] AS tags
FROM documents d LEFT JOIN labels l USING (doc_id))"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as commits: hash, author, date, message."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("commit_hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("author_date"), F.col("o_orderpriority").alias("message"), F.col("o_totalprice").alias("size"))


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as file changes: one row a commit and file."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("commit_hash"),
        F.col("l_partkey").alias("file_path"),
        F.col("l_returnflag").alias("change_type"),
        F.col("l_quantity").cast("long").alias("lines_added"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("long").alias("lines_deleted"),
    )


COMMIT_SQL = """commits AS (SELECT o_orderkey AS commit_hash, o_custkey AS author, o_orderdate AS author_date, o_orderpriority AS message, o_totalprice AS size FROM orders),
changes AS (SELECT l_orderkey AS commit_hash, l_partkey AS file_path, l_returnflag AS change_type, CAST(l_quantity AS BIGINT) AS lines_added, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS lines_deleted FROM lineitem)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of queries: session user, kind, latency, results, relevance."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("kind"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("result_count"),
        F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 100) / 100).alias("relevance"),
    )


LOG_SQL = """log AS (SELECT event_id AS id, user_id AS session_id, event_type AS kind, ts AS timestamp, value AS latency_ms,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS result_count, CASE WHEN event_id % 3 <> 0 THEN (event_id % 100) / 100 END AS relevance FROM events)"""
