"""Session settings and scratch space that every part of the engine shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOCAL_SCRATCH = "/tmp/strandline-scratch"


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark: UTC, AQE on, few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's spark.checkpoint.dir.

    Only a local session (tests, a laptop) may leave it unset, and gets a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = f"{LOCAL_SCRATCH}/{os.getpid()}"
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared scratch folder that nothing else uses."""
    return f"{scratch_root(spark)}/strandline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote to the scratch folder; results that read it end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/strandline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows of a few large input partitions over all cores, before heavy per-row work.

    A table with a partition a core or more, as any large one has, is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextlib.contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Lets Spark delete an execution's shuffle files when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared scratch folder, reads it back.

    Unlike a cached or locally checkpointed table it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _cleaned_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() wrote, once nothing will read it again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
