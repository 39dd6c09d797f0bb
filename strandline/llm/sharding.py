"""Operator 10: sharding by vector bin packing, under the law `bytes` (sizes near equal).

What is packed are units: equal texts (a group) hash to one of ``UNITS`` units, so a group stays
together. A large group is a unit of its own; one above a shard's fair share in bytes, tokens or rows
can't stay together, and is cut by a hash of its rows into pieces that are units of their own. Few
groups can be above a given share, so the driver sees a bounded table of units, whatever the corpus. Units are placed
in order of size, each into the shard where the dot product of its (bytes, tokens, rows) with the
shard's residual capacity is highest among those with room for its bytes.

Slots are counted on two levels: by a window inside parts of units (a large group is dealt over many
parts), over a shard's parts on the driver.

Defined results: a null text counts as empty (size 1, crc32 of no bytes); a null doc_id is carried;
repeated rows each get a slot; an empty table gives no rows; further columns are not read. A single document
larger than a shard's share is placed whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import stored, word_count

UNITS = 8192
#: A piece of a cut group holds about this share of a shard; so do the parts that slots are counted in.
PIECE = 0.05
#: What bytes, tokens and rows weigh in the product; bytes lead, as theirs is the law.
LEAD = np.array([4.0, 1.0, 1.0])


def pack(loads: np.ndarray, shards: int, slack: float = 1.0005) -> np.ndarray:
    """A shard for each unit. loads: (units, 3) of bytes, tokens and rows.

    Units come in order of bytes, large ones first; a unit goes where load . residual is highest
    among shards that stay within the mean of bytes, or else where most bytes are free.
    """
    totals = np.maximum(loads.sum(axis=0), 1)
    share = loads / totals * shards  # a shard's capacity is 1 in each measure
    residual = np.ones((shards, 3))
    where = np.zeros(len(loads), dtype=np.int64)
    for i in np.lexsort((np.arange(len(loads)), -share.sum(axis=1), -share[:, 0])).tolist():
        fits = residual[:, 0] >= share[i, 0] - (slack - 1)
        score = residual @ (share[i] * LEAD)
        j = int(np.where(fits, score, -np.inf).argmax()) if fits.any() else int(residual[:, 0].argmax())
        where[i] = j
        residual[j] -= share[i]
    return where


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, tokens, text_crc32, law, shard, slot and grown_shard for every row of docs."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        word_count().alias("tokens"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("content"),
        F.monotonically_increasing_id().alias("nth"),
    )
    rows = stored(rows, "shard-rows")
    measures = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    total = rows.agg(*measures).first()
    fair = {m: max(1.0, (total[m] or 0) / shards) for m in ("size", "tokens", "n")}
    # groups above a piece's share of a shard in some measure: at most 3 x shards / PIECE
    groups = rows.groupBy("content").agg(*measures).where("n > 1").where(" or ".join(f"{m} > {PIECE * fair[m]!r}D" for m in fair)).collect()
    large = []
    for number, r in enumerate(sorted(groups, key=lambda r: r["content"])):
        most = max(r[m] / fair[m] for m in fair)
        large.append((r["content"], UNITS + (number << 20), int(np.ceil(most / PIECE)) if most > 1 else 1, int(np.ceil(r["n"] / (PIECE * fair["n"])))))
    large = spark.createDataFrame(large, "content long, first_unit long, pieces int, parts int")
    deal = F.xxhash64("content", "doc_id", "nth")  # rows may share a doc_id, too
    rows = (
        rows.join(F.broadcast(large), "content", "left")
        .withColumn("unit", F.coalesce(F.col("first_unit") + F.pmod(deal, F.col("pieces")), F.pmod("content", F.lit(UNITS))))
        .withColumn("part", F.coalesce(F.pmod(F.shiftright(deal, 20), F.col("parts")), F.lit(0)))
        .drop("first_unit", "pieces", "parts")
    )
    parts = rows.groupBy("unit", "part").agg(*measures).orderBy("unit", "part").toPandas()  # bounded by UNITS and the large groups' parts
    units = parts.groupby("unit", as_index=False)[["size", "tokens", "n"]].sum()
    units["shard"] = pack(units[["size", "tokens", "n"]].to_numpy(dtype=np.float64), shards).astype(np.int32)
    parts = parts.merge(units[["unit", "shard"]], on="unit")
    parts["before"] = parts.groupby("shard")["n"].cumsum() - parts["n"]
    table = spark.createDataFrame([tuple(map(int, r)) for r in parts[["unit", "part", "shard", "before"]].itertuples(index=False)], "unit long, part long, shard int, before long")
    slot = F.row_number().over(Window.partitionBy("unit", "part").orderBy("content", F.col("doc_id").asc_nulls_first(), "nth"))
    return (
        rows.withColumn("in_unit", slot)
        .join(F.broadcast(table), ["unit", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("in_unit") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
    )
