"""Analytics over commits and file changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def commits_by_file(commits: DataFrame, changes: DataFrame, path, limit: int = 100) -> DataFrame:
    """A file's changes with their commits, latest first; one join instead of a look-up a change."""
    mine = changes.where(F.col("file_path") == path)
    return mine.join(commits, "commit_hash").orderBy(F.col("author_date").desc(), "commit_hash").limit(limit)


def search_commits(commits: DataFrame, touched: DataFrame | None = None, since: str | None = None, until: str | None = None, condition: Column | None = None, limit: int = 100) -> DataFrame:
    """Commits of a date range and condition that touch some files, latest first."""
    found = commits
    if since:
        found = found.where(F.col("author_date") >= F.expr(f"timestamp_ntz'{since} 00:00:00'"))
    if until:
        found = found.where(F.col("author_date") < F.expr(f"timestamp_ntz'{until} 00:00:00'"))
    if condition is not None:
        found = found.where(condition)
    if touched is not None:
        found = found.join(touched.select("commit_hash"), "commit_hash", "left_semi")
    return found.orderBy(F.col("author_date").desc(), "commit_hash").limit(limit)


def churn(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """For each file: changes, first and last date, changes a week, lines, authors and a score."""
    both = changes.join(commits, "commit_hash")
    per = both.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n_changes"),
        F.min("author_date").alias("first_change"),
        F.max("author_date").alias("last_change"),
        F.sum("lines_added").alias("added"),
        F.sum("lines_deleted").alias("deleted"),
        F.countDistinct("author").alias("n_authors"),
    )
    weeks = F.greatest(F.lit(0.1), F.timestamp_diff("DAY", F.col("first_change"), F.col("last_change")) / 7)
    per = per.withColumn("per_week", F.col("n_changes") / weeks)
    size = (F.col("added") + F.col("deleted")) / F.col("n_changes")
    return per.withColumn("score", F.least(F.lit(1.0), F.col("per_week") / 5 * (size / 100)))


def hotspots(commits: DataFrame, changes: DataFrame, now: Column, days: int = 90, least: int = 5, limit: int = 10) -> DataFrame:
    """Files with most changes in the last days."""
    recent = commits.where(F.col("author_date") >= now - F.make_dt_interval(F.lit(days)))
    per = changes.join(recent, "commit_hash").groupBy("file_path").agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct("author").alias("n_authors"), F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("lines"))
    return per.where(F.col("n_changes") >= least).orderBy(F.col("n_changes").desc(), "file_path").limit(limit)


def authors(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """For each author: commits, lines and dates."""
    both = changes.join(commits, "commit_hash")
    return both.groupBy("author").agg(
        F.countDistinct("commit_hash").alias("n_commits"),
        F.sum("lines_added").alias("added"),
        F.sum("lines_deleted").alias("deleted"),
        F.min("author_date").alias("first_commit"),
        F.max("author_date").alias("last_commit"),
    )


def evolution(commits: DataFrame, changes: DataFrame, author: Column | None = None) -> DataFrame:
    """Each file's changes in order, with the days and the lines since the one before."""
    both = changes.join(commits if author is None else commits.where(author), "commit_hash")
    order = Window.partitionBy("file_path").orderBy("author_date", "commit_hash", "lines_added", "lines_deleted")
    return both.withColumn("days_since", F.timestamp_diff("DAY", F.lag("author_date").over(order), F.col("author_date"))).withColumn("added_before", F.lag("lines_added").over(order))


def diff_lines(diff: Column, sign: str) -> Column:
    """Lines of a diff that add ('+') or delete ('-'), without its file headers."""
    mark = "\\+" if sign == "+" else "-"
    return F.size(F.filter(F.split(diff, "\n"), lambda x: x.rlike(f"^{mark}") & ~x.rlike(f"^{mark}{mark}{mark}")))
