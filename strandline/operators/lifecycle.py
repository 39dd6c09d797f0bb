"""Writes as table transformations: upserts, updates, deletes, merges, retention, import and export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_id() -> Column:
    return F.expr("uuid()")


def unit_id(project: Column, path: Column, start_line: Column, name: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of project:path:line:name."""
    return F.substring(F.sha2(F.concat_ws(":", project, path, start_line.cast("string"), name), 256), 1, 32)


def indexable_text(path: Column, start: Column, end: Column, kind: Column, name: Column, signature: Column, content: Column) -> Column:
    return F.format_string("File: %s:%s-%s\nType: %s\nName: %s\nSignature: %s\n\nContent:\n%s", path, start, end, kind, name, signature, content)


def upsert(current: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key; a new row wins over a current one of the same version."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_new").desc()))
    return both.withColumn("_place", place).where("_place = 1").drop("_place", "_new")


def update(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns where a condition holds."""
    return rows.withColumns({name: F.when(condition, value).otherwise(F.col(name)) for name, value in values.items()})


def merged_map(old: Column, new: Column) -> Column:
    """Entries of both maps; the new one's win."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true: null keeps a row."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def breakdown(rows: DataFrame, *columns: str) -> DataFrame:
    """dimension, value, n: counts by each of some columns in one pass."""
    sets = rows.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*columns).alias("_g"))
    bits = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    dimension = F.coalesce(*[F.when(F.col("_g") == b, F.lit(c)) for c, b in bits.items()])
    value = F.coalesce(*[F.when(F.col("_g") == b, F.col(c).cast("string")) for c, b in bits.items()])
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n")


def deletion_preview(rows: DataFrame, condition: Column, sure_above: int = 10) -> DataFrame:
    """What a delete would do, before it: n, important rows, bytes, and whether to ask."""
    size = F.octet_length("content") + 3072
    return rows.where(condition).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("importance") > 0.7, 1).otherwise(0)).cast("long").alias("n_important"),
        F.sum(size).cast("long").alias("bytes"),
        (F.count(F.lit(1)) > sure_above).alias("needs_confirmation"),
    )


def soft_deleted(rows: DataFrame, condition: Column, rollback_id: str, now: Column, keep_days: int = 30) -> DataFrame:
    """Marks rows as deleted, to be restored until an expiry."""
    mark = F.struct(F.lit(rollback_id).alias("rollback_id"), now.alias("deleted_at"), (now + F.make_dt_interval(F.lit(keep_days))).alias("expires_at"))
    return rows.withColumn("deletion", F.when(condition, mark))


def rolled_back(rows: DataFrame, rollback_id: str) -> DataFrame:
    return rows.withColumn("deletion", F.when(F.coalesce(F.col("deletion.rollback_id") != rollback_id, F.lit(False)), F.col("deletion")))


def purged(rows: DataFrame, now: Column) -> DataFrame:
    """Without rows whose time to be restored is over."""
    return rows.where(F.col("deletion").isNull() | (F.col("deletion.expires_at") >= now))


def merged_rows(rows: DataFrame, group: str, order: str, separator: str = "\n\n---\n\n", most_bytes: int = 256 << 20) -> DataFrame:
    """group, id (its smallest), content: the distinct contents in order, joined.

    A merged content is one value, so a group of more than most_bytes is refused, before its contents are gathered.
    """
    firsts = rows.groupBy(group, "content").agg(F.min(order).alias(order))
    sizes = firsts.groupBy(group).agg(F.sum(F.octet_length("content")).alias("_bytes"))
    fits = F.when(F.coalesce("_bytes", F.lit(0)) <= most_bytes, True).otherwise(F.raise_error(F.lit("a group is too large to be one row")).cast("boolean"))
    firsts = firsts.join(sizes.where(fits), group)
    texts = firsts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "content"))).alias("c"))
    return texts.select(group, F.col("c")[0][order].alias("id"), F.array_join(F.transform("c", lambda s: s["content"]), separator).alias("content"), F.size("c").alias("n"))


def imported(current: DataFrame, new: DataFrame, key: str, mode: str) -> DataFrame:
    """Conflicts by mode: skip keeps current rows, overwrite takes new ones, merge fills their nulls."""
    names = [c for c in current.columns if c != key]
    a = current.withColumn("_a", F.lit(True))
    b = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in names]).withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    pick = {
        "skip": lambda c: F.when(F.col("_a"), F.col(c)).otherwise(F.col(f"_n_{c}")),
        "overwrite": lambda c: F.when(F.col("_b"), F.col(f"_n_{c}")).otherwise(F.col(c)),
        "merge": lambda c: F.coalesce(F.col(f"_n_{c}"), F.col(c)),
    }[mode]
    return both.select(key, *[pick(c).alias(c) for c in names])


def expired_sessions(rows: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    return rows.where((F.col("context_level") == "SESSION_STATE") & (F.coalesce("last_accessed", "created_at") < now - F.make_dt_interval(hours=F.lit(hours))))


def unused(rows: DataFrame, cutoff: Column, but: list[str]) -> DataFrame:
    return rows.where((F.coalesce("use_count", F.lit(0)) == 0) & (F.col("created_at") < cutoff) & ~F.col("context_level").isin(but))


def pruned(rows: DataFrame, gone: DataFrame, key: str, dry_run: bool = False) -> DataFrame:
    """What stays after pruning; in a dry run everything."""
    return rows if dry_run else delete(rows, gone, key)


def read_only(df: DataFrame) -> ReadOnly:
    return ReadOnly(df)


@dataclass(frozen=True)
class ReadOnly:
    """A table that can be read and transformed but not written."""

    _df: DataFrame

    def __getattr__(self, name: str):
        if name in ("write", "writeTo", "writeStream", "mergeInto"):
            raise PermissionError("this store is read-only")
        return getattr(self._df, name)


# storage analysis


def row_bytes(content: Column, metadata: Column | None = None, width: int = 768) -> Column:
    n = F.octet_length(content) + 4 * width
    return n + F.octet_length(F.to_json(metadata)) if metadata is not None else n


def storage_by_state(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lifecycle_state").agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(F.col("content"))).cast("long").alias("bytes"))


def large_rows(rows: DataFrame, least: int = 10_240, saving: float = 0.4) -> DataFrame:
    size = row_bytes(F.col("content"))
    return rows.where(size > least).groupBy("lifecycle_state").agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"), (F.sum(size) * saving).alias("saving"))


def duplicate_signatures(rows: DataFrame) -> DataFrame:
    """Groups of like category, level and length: bytes of all but the first row."""
    sig = F.concat_ws("_", "category", "context_level", (F.floor(F.length("content") / 100) * 100).cast("string"))
    g = rows.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(F.col("content"))).cast("long").alias("all_bytes"), F.min_by(row_bytes(F.col("content")), "id").alias("first_bytes"))
    return g.where("n >= 2").select("signature", "n", (F.col("all_bytes") - F.col("first_bytes")).alias("bytes"))
