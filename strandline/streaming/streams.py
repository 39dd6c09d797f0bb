"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators.sessions import usage, usage_update
from strandline.session import discard, scratch_path, stored


def nearest_ms(time: Column) -> Column:
    """A time in whole milliseconds, the nearest, halves away from 1970: long."""
    return F.call_function("div", F.round(F.unix_micros(time), -3), F.lit(1000))


def event_stream(spark: SparkSession, sf_dir: str, lateness: str = "1 hour", in_ms: bool = False) -> DataFrame:
    """The events file as a stream with event time and a watermark.

    in_ms: event times are the nearest milliseconds, before the watermark is taken from them, so it and what counts in milliseconds agree.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder, files = _folder(spark, sf_dir)
    e = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    time = F.col("ts").cast("timestamp")
    time = F.timestamp_millis(nearest_ms(time)) if in_ms else time
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), time.alias("timestamp"), F.col("value").alias("latency_ms")).withWatermark("timestamp", lateness)


def _folder(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A file source reads folders: that of the table's file, or the table itself if it is one; and which files there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return (f"{sf_dir}/events.parquet", "*.parquet") if fs.getFileStatus(path).isDirectory() else (sf_dir, "events*.parquet")


def session_stream(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions by inactivity; state goes when the watermark passes a session's end."""
    s = log.groupBy("session_id", F.session_window("timestamp", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"))
    return s.select("session_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


def daily_stream(log: DataFrame) -> DataFrame:
    d = log.groupBy(F.window("timestamp", "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.to_date("w.start").alias("day"), "kind", "n")


def sliding_stream(log: DataFrame, length: str = "30 days", step: str = "1 day") -> DataFrame:
    d = log.groupBy(F.window("timestamp", length, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency"))
    return d.select(F.col("w.start").alias("start"), "n", "avg_latency")


def debounced(changes: DataFrame, path: str = "path") -> DataFrame:
    """One event a path within the watermark, however often it changed."""
    return changes.dropDuplicatesWithinWatermark([path])


def shown_ids(log: DataFrame, gap_ms: int = 30 * 60 * 1000) -> DataFrame:
    """session_id, n_shown: distinct ids shown in the current session, kept as state with a timeout."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "n_shown": [0]})
            return
        shown, last = state.get if state.exists else ("", 0)
        known = set(shown.split()) if shown else set()
        for rows in batches:
            for t, i in sorted(zip(rows["timestamp"].astype("int64") // 1_000_000, rows["id"], strict=True)):
                if last and t - last > gap_ms:
                    known = set()
                known.add(str(i))
                last = max(last, t)
        state.update((" ".join(sorted(known)), last))
        state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "n_shown": [len(known)]})

    return log.groupBy("session_id").applyInPandasWithState(step, "session_id long, n_shown long", "shown string, last long", "update", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str, name: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, into a table in the shared scratch folder."""
    spark = stream.sparkSession
    at = scratch_path(spark, "stream")

    def sink(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/data")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/data")


#: Buckets of an upserted table: a batch writes those that it touches.
BUCKETS = 64


def upserted_usage(log: DataFrame, folder: str | None = None) -> DataFrame:
    """Usage per session user, upserted by micro-batch: a batch reads the buckets of its own keys and writes these again.

    A version is a list of buckets and of the batches that wrote them. Versions, buckets and the stream's checkpoint stand in a folder. A
    later call with the same folder resumes there, in a new session, too; a replayed batch writes its own version again from the
    one before, so it counts once. Buckets that the last two versions don't name are deleted.
    """
    spark = log.sparkSession
    at = folder or scratch_path(spark, "usage")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(of: str) -> list[str]:
        return [f.getPath().getName() for f in fs.listStatus(path(of))] if fs.exists(path(of)) else []

    def known() -> list[int]:
        """Versions that were written whole."""
        return sorted(int(n[1:]) for n in names(f"{at}/versions") if fs.exists(path(f"{at}/versions/{n}/_SUCCESS")))

    def buckets(version: int) -> dict[int, int]:
        return {r.bucket: r.batch for r in spark.read.schema("bucket int, batch long").parquet(f"{at}/versions/v{version}").collect()}  # BUCKETS rows

    def rows(of: dict[int, int]) -> DataFrame:
        return spark.read.parquet(*[f"{at}/data/v{batch}/bucket={b}" for b, batch in sorted(of.items())])

    def sink(df: DataFrame, epoch: int) -> None:
        before = [e for e in known() if e < epoch]
        old = buckets(before[-1]) if before else {}
        new = stored(usage(df.withColumnRenamed("session_id", "item"), "item", "timestamp", "latency_ms"), "usage-batch")
        bucket = F.pmod(F.xxhash64("item"), F.lit(BUCKETS)).cast("int")
        touched = [r[0] for r in new.select(bucket).distinct().collect()]
        held = {b: old[b] for b in touched if b in old}
        out = usage_update(rows(held), new, "item") if held else new
        out.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/data/v{epoch}")
        discard(new)
        now = list((old | dict.fromkeys(touched, epoch)).items())
        spark.createDataFrame(now, "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{at}/versions/v{epoch}")
        last = known()
        used = {f"v{batch}/bucket={b}" for v in last[-2:] for b, batch in buckets(v).items()}
        for batch in names(f"{at}/data"):
            if int(batch[1:]) < last[-1]:
                for b in names(f"{at}/data/{batch}"):
                    if b.startswith("bucket=") and f"{batch}/{b}" not in used:
                        fs.delete(path(f"{at}/data/{batch}/{b}"), True)
        for v in last[:-2]:
            fs.delete(path(f"{at}/versions/v{v}"), True)

    q = log.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = rows(buckets(known()[-1]))
    return out.select("item", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_used").cast("timestamp_ntz").alias("last_used"), "use_count", "last_score")
