"""Quantiles from mergeable KLL sketches: one stored a day and group, merged for whatever range is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size parameter of a sketch: ranks are off by less than RANK_ERROR of the rows with near certainty, whatever is merged.
SIZE, RANK_ERROR = 400, 0.01


def daily_sketches(log: DataFrame, time: str, by: list[str], value: str, size: int = SIZE) -> DataFrame:
    """day, by, sketch: values are sketched before they are shuffled. As a stream, a day per window and group."""
    rows = log.where(F.col(value).isNotNull())
    if log.isStreaming:
        per = rows.groupBy(F.window(time, "1 day").alias("w"), *by).agg(F.kll_sketch_agg_double(value, size).alias("sketch"))
        return per.select(F.to_date("w.start").alias("day"), *by, "sketch")
    return rows.groupBy(F.to_date(time).alias("day"), *by).agg(F.kll_sketch_agg_double(value, size).alias("sketch"))


def write_sketches(sketches: DataFrame, path: str) -> None:
    sketches.repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)


def merged(spark: SparkSession, path: str, first: str, last: str, by: list[str]) -> DataFrame:
    """by, sketch of a range of days: their sketches are read, and no row of the log."""
    rows = spark.read.parquet(path).where(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return rows.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, by: list[str], **shares: float) -> DataFrame:
    """by, n and a column for each share."""
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(share).cast("double")).alias(name) for name, share in shares.items()]
    return sketches.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), *at)
