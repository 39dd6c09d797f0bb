"""Commits and file changes from the text of a git log dump; no version control runs inside tasks.

The dump comes from: git log --numstat --date=iso-strict --pretty=format:'@%H|%an|%ae|%ad|%s'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def commit_header(value: Column) -> Column:
    """struct of a header line, or null for other lines."""
    p = F.split(F.substring(value, 2, 1 << 30), r"\|", 5)
    head = F.struct(p[0].alias("commit_hash"), p[1].alias("author_name"), p[2].alias("author_email"), F.try_to_timestamp(F.regexp_replace(p[3], "T", " ")).cast("timestamp_ntz").alias("author_date"), p[4].alias("message"))
    return F.when(value.startswith("@"), head)


def commits(lines: DataFrame) -> DataFrame:
    """A row a commit. lines: value."""
    return lines.select(commit_header(F.col("value")).alias("c")).where("c IS NOT NULL").select("c.*")


def file_changes(lines: DataFrame) -> DataFrame:
    """commit_hash, file_path, lines_added, lines_deleted. lines: dump, line (place in its dump), value.

    A change belongs to the last header before it in its dump, so dumps should be cut at commits into
    files of moderate size.
    """
    to_here = Window.partitionBy("dump").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    known = lines.withColumn("commit_hash", F.last(commit_header(F.col("value"))["commit_hash"], ignorenulls=True).over(to_here))
    part = F.split("value", "\t")
    n = lambda i: F.coalesce(F.try_to_number(part[i], F.lit("999999999")).cast("long"), F.lit(0))  # noqa: E731  '-' of binary files
    return known.where(~F.col("value").startswith("@") & (F.size(part) == 3)).select("commit_hash", part[2].alias("file_path"), n(0).alias("lines_added"), n(1).alias("lines_deleted"))
