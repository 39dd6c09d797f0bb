"""Sessions by inactivity, and what was used in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(log: DataFrame, key: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """key, started, ended (last event), n: events less than the gap apart are one session."""
    w = F.session_window(F.col(time), gap)
    s = log.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("started"), F.max(time).alias("ended"))
    return s.select(key, "started", "ended", "n")


def last_of_each(log: DataFrame, key: str, time: str, n: int, tie: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(tie).desc()))
    return log.withColumn("place", place).where(F.col("place") <= n)


def usage(log: DataFrame, key: str, time: str, score: str) -> DataFrame:
    """key, first_seen, last_used, use_count, last_score; cumulative."""
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_used"), F.count(F.lit(1)).alias("use_count"), F.max_by(score, time).alias("last_score"))


def usage_update(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Adds a batch's usage to the table: counts add up, times extend, the later score stays."""
    both = current.unionByName(new)
    return both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_used").alias("last_used"), F.sum("use_count").alias("use_count"), F.max_by("last_score", "last_used").alias("last_score"))
