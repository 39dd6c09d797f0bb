"""What keeps a store in order: jobs, caches, scopes, stale repositories, bounded deletes, sinks of git history."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.lifecycle import soft_deleted

#: The states that a job may go to from each state; any other update is refused.
JOB_MOVES = {"queued": ["running", "cancelled"], "running": ["paused", "completed", "failed", "cancelled"], "paused": ["running", "cancelled"], "completed": [], "failed": ["queued"], "cancelled": []}


def job_states(updates: DataFrame, job: str = "job", status: str = "status", order: str = "at") -> DataFrame:
    """job, status, n_moves, n_refused: where a job's updates lead from 'queued', in order; a job has few."""
    moves = F.create_map(*[x for k, v in JOB_MOVES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    steps = updates.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(order, status))).alias("u"))
    start = F.struct(F.lit("queued").alias("s"), F.lit(0).alias("moved"), F.lit(0).alias("refused"))

    def step(a: Column, u: Column) -> Column:
        ok = F.array_contains(moves[a["s"]], u[status])
        return F.struct(F.when(ok, u[status]).otherwise(a["s"]).alias("s"), (a["moved"] + ok.cast("int")).alias("moved"), (a["refused"] + (~ok).cast("int")).alias("refused"))

    return steps.select(job, F.aggregate("u", start, step).alias("a")).select(job, F.col("a.s").alias("status"), F.col("a.moved").alias("n_moves"), F.col("a.refused").alias("n_refused"))


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """requests with `hit` and the cached vector, null where there is none or its time is over. Both have key; cache: vector, created_at."""
    fresh = cache.where(F.col("created_at") > now - F.make_dt_interval(F.lit(days))).select("key", "vector")
    return requests.join(fresh, "key", "left").withColumn("hit", F.col("vector").isNotNull())


def cache_filled(found: DataFrame, cache: DataFrame, embed, now: Column, days: int = 30) -> DataFrame:
    """The cache after a look-up: entries whose time isn't over, and a new one for each missed key. found: key, text, hit."""
    kept = cache.where(F.col("created_at") > now - F.make_dt_interval(F.lit(days))).select("key", "vector", "created_at")
    missed = found.where(~F.col("hit")).groupBy("key").agg(F.min("text").alias("text"))
    return kept.unionByName(missed.select("key", embed(F.col("text")).alias("vector"), now.alias("created_at")))


def stale_repositories(repos: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Repositories to index again: STALE, ERROR, or INDEXED longer ago."""
    old = (F.col("status") == "INDEXED") & (F.col("last_updated") < now - F.make_dt_interval(F.lit(days)))
    return repos.where(F.col("status").isin("STALE", "ERROR") | old)


def workspaces_with(workspaces: DataFrame, tags: list[str] | None = None, repo=None) -> DataFrame:
    """Workspaces that have all the tags and a repository. workspaces: tags and repositories are arrays."""
    for t in tags or []:
        workspaces = workspaces.where(F.array_contains("tags", t))
    return workspaces if repo is None else workspaces.where(F.array_contains("repositories", repo))


def search_scope(repos: DataFrame, workspaces: DataFrame, workspace=None, tags: list[str] | None = None, include_stale: bool = False) -> DataFrame:
    """repository: those of a workspace, else those that have a tag; INDEXED ones only unless stale ones are asked for, too."""
    found = repos.where(F.col("status").isin(*(["INDEXED", "STALE"] if include_stale else ["INDEXED"])))
    if workspace is not None:
        mine = workspaces.where(F.col("workspace") == workspace).select(F.explode("repositories").alias("repository"))
        return found.join(mine, "repository", "left_semi").select("repository")
    return (found.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else found).select("repository")


def workspace_statistics(workspaces: DataFrame) -> DataFrame:
    """One row: workspaces, distinct repositories, how many have each flag, distinct tags, mean repositories (2 digits)."""
    return workspaces.agg(
        F.count(F.lit(1)).alias("n_workspaces"),
        F.sum(F.col("auto_index").cast("long")).alias("n_auto_index"),
        F.sum(F.col("cross_search").cast("long")).alias("n_cross_search"),
        F.round(F.avg(F.size("repositories")), 2).alias("mean_repositories"),
    ).crossJoin(F.broadcast(workspaces.select(F.explode("repositories").alias("r")).agg(F.countDistinct("r").alias("n_repositories")))).crossJoin(F.broadcast(workspaces.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("n_tags"))))  # one row each


def bulk_delete(rows: DataFrame, condition: Column, most: int, rollback_id: str | None, now: Column, id_: str = "id") -> DataFrame:
    """rows after a delete of the first `most` matches by id, at most: marked if there is a rollback id, else gone.

    The bound is the operator's own; its ids are a top-k.
    """
    chosen = rows.where(condition).select(id_).orderBy(id_).limit(most)
    if rollback_id is None:
        return rows.join(F.broadcast(chosen), id_, "left_anti")  # `most` rows
    marked = rows.join(F.broadcast(chosen.withColumn("_gone", F.lit(True))), id_, "left")
    return soft_deleted(marked, F.col("_gone"), rollback_id, now).drop("_gone")


def pruned_sessions(rows: DataFrame, now: Column, hours: int = 48, safe_hours: int = 24) -> DataFrame:
    """Session rows older than their time that nobody used in the last safe_hours."""
    age = lambda h: now - F.make_dt_interval(hours=F.lit(h))
    return rows.where((F.col("context_level") == "SESSION_STATE") & (F.col("created_at") < age(hours)) & (F.coalesce("last_accessed", "created_at") < age(safe_hours)))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def store_git(spark: SparkSession, path: str, commits: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appends commits and file changes under ids that follow from their keys; what is there already isn't written twice.

    Returns both stored tables. Dates are stored as epoch seconds. Rows meet by their keys' text, which is shorter than the ids made of it.
    """
    commits = commits.withColumn("author_date", F.unix_seconds(F.col("author_date").cast("timestamp")))
    text = lambda c: F.col(c).cast("string")
    out = []
    own = F.col("_key")
    for name, rows, key, of in (
        ("git_commits", commits, F.coalesce(F.concat(F.lit(":"), text("commit_hash")), F.lit("")), F.concat(F.lit("commit"), F.nullif(own, F.lit("")))),
        ("git_file_changes", changes, F.concat_ws(":", F.lit(""), text("commit_hash"), text("file_path")), F.concat(F.lit("change"), own)),
    ):
        at, rows = f"{path}/{name}", rows.withColumn("_key", key)
        there = spark._jvm.org.apache.hadoop.fs.Path(at)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            rows = rows.join(spark.read.parquet(at).select(key.alias("_key")), "_key", "left_anti")
        rows = rows.dropDuplicates(["_key"]).withColumn("id", uuid5(of))
        rows.drop("_key").write.mode("append").parquet(at)
        out.append(spark.read.parquet(at))
    return out[0], out[1]


def directory_analysis(files: DataFrame, small: int = 2) -> DataFrame:
    """directory, extension, n_files, bytes, share of all bytes, and whether to leave it out (many bytes, few files)."""
    per = files.groupBy("directory", "extension").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"))
    whole = per.agg(F.sum("bytes").alias("_all"))
    out = per.crossJoin(F.broadcast(whole)).withColumn("share", F.round(F.col("bytes") / F.col("_all"), 6))  # one row
    return out.withColumn("exclude", (F.col("n_files") <= small) & (F.col("share") > 0.01)).drop("_all")


def optimisation_estimate(analysis: DataFrame, seconds_a_file: float = 0.1) -> DataFrame:
    """One row: files, files and bytes that the suggestions leave out, and the time of indexing before over that after, of a second at least."""
    left_out = F.coalesce(F.sum(F.when(F.col("exclude"), F.col("n_files"))), F.lit(0))
    per = analysis.agg(F.sum("n_files").alias("n_files"), left_out.alias("n_left_out"), F.coalesce(F.sum(F.when(F.col("exclude"), F.col("bytes"))), F.lit(0)).alias("bytes_saved"))
    before = F.col("n_files") * seconds_a_file
    return per.withColumn("speedup", F.when(F.col("n_files") > 0, before / F.greatest(F.lit(1.0), before - F.col("n_left_out") * seconds_a_file)).otherwise(1.0))


def repository_entries(files: DataFrame) -> DataFrame:
    """repository, status, n_files, n_units, last: failed before error before indexed. files: repository, at, units, problem (null: none)."""
    has = lambda p: F.coalesce(F.bool_or(F.col("problem") == p), F.lit(False))
    status = F.when(has("failed"), "failed").when(has("error"), "error").otherwise("indexed")
    return files.groupBy("repository").agg(status.alias("status"), F.count(F.lit(1)).alias("n_files"), F.sum("units").alias("n_units"), F.max("at").alias("last"))


def insights(figures: DataFrame, rules: list[tuple[int, str, Column]]) -> DataFrame:
    """priority, insight: the rules that hold for a row of figures, most urgent first."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(t).alias("insight"))) for p, t, c in rules]))
    return figures.select(F.explode(F.array_sort(found)).alias("i")).select("i.*")
