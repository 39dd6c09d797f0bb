"""Import and export of memory rows: JSON documents and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = ["id", "content", "category", "context_level", "scope", "project_name", "importance", "tags", "created_at", "updated_at"]


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, written by all tasks."""
    rows.write.mode("errorifexists").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON objects, or one document {"memories": [...]}."""
    lines = spark.read.schema(f"memories array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in schema.split(','))}>>, {schema}").option("multiLine", "false").json(path)
    inner = lines.where("memories is not null").select(F.explode("memories").alias("m")).select("m.*")
    return lines.where("memories is null").drop("memories").unionByName(inner)


def markdown(rows: DataFrame) -> DataFrame:
    """A column `value` with a Markdown section a row."""
    return rows.select(F.format_string("## %s\n\n- category: %s\n- project: %s\n- importance: %.2f\n\n%s\n", F.col("id").cast("string"), "category", "project_name", "importance", "content").alias("value"))


def payload(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Promotes nothing reserved: metadata entries under core names are dropped."""
    return rows.withColumn(metadata, F.map_filter(metadata, lambda k, v: ~k.isin(RESERVED)))


def decoded(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Typed fields from a JSON column."""
    return rows.withColumn("_p", F.from_json(column, schema)).select(*[c for c in rows.columns if c != column], "_p.*")
