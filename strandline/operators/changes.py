"""Differences between two versions of a table: files, units, renames, what to index again."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def file_diff(old: DataFrame, new: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """path, change: added, deleted or modified; unchanged files don't show."""
    a = old.select(key, F.sha2(content, 256).alias("_old"))
    b = new.select(key, F.sha2(content, 256).alias("_new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return both.withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def unit_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same by name, over contents without outer white space."""
    strip = lambda d: d.select("name", F.regexp_replace("content", r"^\s+|\s+$", "").alias("content"))
    return file_diff(strip(old), strip(new), "name")


def index_plan(diff: DataFrame, new: DataFrame, full_above: float = 0.7) -> DataFrame:
    """One row: how many units to add, update and delete, and whether to index all anew."""
    n = new.agg(F.count(F.lit(1)).alias("_n"))
    per = diff.agg(*[F.sum(F.when(F.col("change") == c, 1).otherwise(0)).cast("long").alias(name) for c, name in (("added", "to_add"), ("modified", "to_update"), ("deleted", "to_delete"))])
    per = per.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in per.columns])
    return per.crossJoin(F.broadcast(n)).withColumn("full_reindex", (F.col("to_add") + F.col("to_update") + F.col("to_delete")) > full_above * F.col("_n")).drop("_n")


def text_ratio_above(least: float):
    """Similarity of two texts by matching blocks, from 0 to 1, where it is at least so much, and 0 elsewhere: upper bounds spare most comparisons."""

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out, matcher = [], difflib.SequenceMatcher(None)
        for x, y in zip(a, b, strict=True):
            matcher.set_seqs(x or "", y or "")
            near = matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least
            r = matcher.ratio() if near else 0.0
            out.append(r if r >= least else 0.0)
        return pd.Series(out)

    return ratio


#: Characters of a shingle, and how many shingles of a deleted file look for partners.
SHINGLE, RAREST = 5, 48


def shingles(content: Column, n: int = SHINGLE) -> Column:
    """Distinct hashes of all runs of n characters; a shorter text is one run."""
    # characters are cut once and bound by the outer transform, so a run is found by its place and not by counting from the start
    runs = F.transform(F.array(F.split(content, "")), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(c, i, n))))
    return F.array_distinct(F.element_at(runs, 1))


def rename_candidates(deleted: DataFrame, added: DataFrame, rarest: int = RAREST) -> DataFrame:
    """old_path, new_path: pairs that share one of a deleted file's rarest shingles, of those that added files hold at all.

    Rare is what few pairs share: the number of deleted files with a shingle times that of added ones. Frequent shingles
    are asked for only by files that hold no others.
    """
    a = deleted.select(F.col("path").alias("old_path"), F.explode(shingles(F.coalesce("content", F.lit("")))).alias("s"))
    b = added.select(F.col("path").alias("new_path"), F.explode(shingles(F.coalesce("content", F.lit("")))).alias("s"))
    held = b.groupBy("s").agg(F.count(F.lit(1)).alias("n_new")).join(a.groupBy("s").agg(F.count(F.lit(1)).alias("n_old")), "s")
    place = F.row_number().over(Window.partitionBy("old_path").orderBy(F.col("n_new") * F.col("n_old"), "s"))
    asked = a.join(held, "s").withColumn("place", place).where(F.col("place") <= rarest).select("old_path", "s")
    return asked.join(b, "s").select("old_path", "new_path").distinct()


def renames(deleted: DataFrame, added: DataFrame, threshold: float = 0.8) -> DataFrame:
    """old_path, new_path, similarity: the best added file for each deleted one.

    Sizes must be within a factor of two. Only files that share a rare shingle are compared. An empty file has no partner but empty ones.
    """
    pairs = rename_candidates(deleted, added)
    pairs = pairs.join(deleted.select(F.col("path").alias("old_path"), F.col("content").alias("old")), "old_path").join(added.select(F.col("path").alias("new_path"), F.col("content").alias("new")), "new_path")
    pairs = pairs.where((F.least(F.length("old"), F.length("new")) / F.greatest(F.length("old"), F.length("new"), F.lit(1))) >= 0.5)
    scored = pairs.withColumn("similarity", text_ratio_above(threshold)("old", "new")).where(F.col("similarity") >= threshold)
    place = F.row_number().over(Window.partitionBy("old_path").orderBy(F.col("similarity").desc(), "new_path"))
    return scored.withColumn("place", place).where("place = 1").select("old_path", "new_path", "similarity")


def stale_entries(indexed: DataFrame, current: DataFrame, key: str = "file_path") -> DataFrame:
    return indexed.join(current.select(key), key, "left_anti")


def changed(old_time: Column, new_time: Column, old_hash: Column, new_hash: Column) -> Column:
    """Modification time first; the content's hash only if that differs."""
    return (old_time != new_time) & (old_hash != new_hash)
