"""Roll-ups, baselines, regressions, growth and capacity over metric and query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scores import severity


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float, name: str, bins: int = 1024) -> DataFrame:
    """The value at place min(int(n * share), n - 1) of each group's sorted values.

    Values are first counted in bins of equal width between a group's bounds. Only the bin that holds the place is looked into: counts of its distinct
    values are summed up to the place. So no task sorts a group, unless its values all stand close together.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    bounds = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        return left.join(right, same).drop(*[f"_r_{c}" for c in by])

    width = (F.col("_hi") - F.col("_lo")).cast("double")
    place_in = F.floor((F.col(value) - F.col("_lo")) / width * bins)
    bin_ = F.when(width > 0, F.coalesce(F.least(place_in, F.lit(bins - 1)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = joined(rows, bounds).withColumn("_bin", bin_)
    counts = binned.groupBy(*by, "_n", "_bin").agg(F.count(F.lit(1)).alias("_c"))
    up_to = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin"))  # bins rows a group
    place = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
    holds = counts.withColumn("_up", up_to).withColumn("_place", place).where("_up > _place AND _up - _c <= _place").select(*by, F.col("_bin").alias("_at"), (F.col("_up") - F.col("_c")).alias("_before"), "_place")
    inside = joined(binned, holds).where("_bin = _at").groupBy(*by, value, "_before", "_place").agg(F.count(F.lit(1)).alias("_c"))
    reached = F.sum("_c").over(Window.partitionBy(*by).orderBy(value)) + F.col("_before")
    return inside.withColumn("_up", reached).where("_up > _place").groupBy(*by).agg(F.min(value).alias(name))


def daily(df: DataFrame, time: str, *aggs: Column) -> DataFrame:
    return df.groupBy(F.to_date(time).alias("day")).agg(*aggs)


def baseline(df: DataFrame, metric: str, value: str, least: int = 10) -> DataFrame:
    """mean, sample deviation, bounds and n of each metric that has enough values."""
    b = df.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return b.where(F.col("n") >= least)


def regressions(base: DataFrame, current: DataFrame, metric: str, lower_is_better: Column) -> DataFrame:
    """current (metric, value) against its baseline: degradation as a share, with a severity."""
    mean = F.col("mean")
    d = F.when(lower_is_better, (F.col("value") - mean) / mean).otherwise((mean - F.col("value")) / mean)
    return current.join(base, metric).withColumn("degradation", F.when(mean != 0, d).otherwise(0.0)).withColumn("severity", F.when(F.col("degradation") > 0, severity(F.col("degradation"))).otherwise("NONE"))


def growth(df: DataFrame, time: str, value: str, by: list[str] | None = None) -> DataFrame:
    """slope a day by least squares and the last value; slope 0 where it isn't defined."""
    days = F.unix_micros(F.col(time).cast("timestamp")) / 86_400_000_000.0
    x = df.withColumn("_d", days)
    g = x.groupBy(*(by or [])).agg(F.regr_slope(value, "_d").alias("slope"), F.max_by(value, time).alias("last"), F.var_pop("_d").alias("_v"))
    return g.withColumn("slope", F.when(F.col("_v") < 1e-10, 0.0).otherwise(F.coalesce("slope", F.lit(0.0)))).drop("_v")


def forecast(g: DataFrame, days: int, warn: float, critical: float, band: float) -> DataFrame:
    """Adds forecast, trend, days to both limits (null if never) and status to growth()'s result."""
    later = F.col("last") + F.col("slope") * days
    to = lambda limit: F.when(F.col("last") >= limit, 0).when(F.col("slope") > 0, ((limit - F.col("last")) / F.col("slope")).cast("int"))
    status = F.when(F.greatest(F.col("last"), later) >= critical, "CRITICAL").when(F.greatest(F.col("last"), later) >= warn, "WARNING").otherwise("HEALTHY")
    trend = F.when(F.col("slope") > band, "GROWING").when(F.col("slope") < -band, "SHRINKING").otherwise("STABLE")
    return g.withColumn("forecast", later).withColumn("trend", trend).withColumn("days_to_warning", to(warn)).withColumn("days_to_critical", to(critical)).withColumn("status", status)


STATUS = ["HEALTHY", "WARNING", "CRITICAL"]


def worst(*statuses: Column) -> Column:
    rank = lambda c: F.array_position(F.array(*[F.lit(s) for s in STATUS]), c)
    return F.element_at(F.array(*[F.lit(s) for s in STATUS]), F.greatest(*[rank(c) for c in statuses]).cast("int"))


def adjusted_threshold(current: Column, rate: Column, n: Column) -> Column:
    """Up by 0.05 under a rate of 0.6, down above 0.8, within [0.70, 0.95]; unchanged below ten ratings."""
    new = F.when(rate < 0.6, current + 0.05).when(rate > 0.8, current - 0.05).otherwise(current)
    return F.when(n < 10, current).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.7), new)))


def zero_filled(days: DataFrame, first: str, last: str, value: str) -> DataFrame:
    """A row for each day of a range; days without a row get 0."""
    spark = days.sparkSession
    every = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return every.join(days, "day", "left").select("day", F.coalesce(value, F.lit(0)).alias(value))
