"""Operator 6: mixing sources to target weights by systematic sampling.

Each source's target is its weighted share of all words, held at ``max_epochs`` times its own size;
the excess is shared again by weight (the level at which this settles comes from one sorted pass
over the sources). A document's expected copies are its source's target over its size. Within
a source documents stand in order of size and then of a hash of their id and text; the prefix sums of
expected copies start at one pseudo-random offset, and a document is emitted once for each integer
that its step crosses. Standing by size makes the sample take a like share of every size, so a source misses
its target by less than its largest document.

All expected copies of a source are equal, so a prefix sum is a rank times that number. Ranks are
counted on two levels: within blocks of (source, class of size, first byte of the hash), and over the
blocks. A source with any share of all rows is thus dealt over hundreds of blocks. Identical rows are counted
before they are shuffled, and have neighbouring ranks; where they become rows again, they are dealt in pieces of bounded size.

Defined results: a null text has size 0; a null source is a source, the last; a source of only
empty documents has target 0; repeated rows are documents of their own; an empty table gives no
rows; a very long text is one row, read by a pattern in the JVM. Further columns are carried by mix(), unread by mixing_plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import fresh, stored, word_count

WEIGHTS = (5, 2, 1)
#: Identical rows that become rows again at one place.
PIECE = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """source, source_size and target, a row a source. sizes: source, size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    # with all sources before this one held at their caps, the others would get this level
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(everything)["level"]
    return per.withColumn("level", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _unit(text: Column) -> Column:
    """A number in [0, 1) from a string's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _place_hash(seed: str) -> Column:
    """What places a document among those of its size: its id and its text."""
    digits, text = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return F.md5(F.concat(F.lit(seed), digits, F.lit(":"), F.md5(text.cast("binary"))))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, h (what placed it), source_size, target, copies and taken for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), _place_hash(seed).alias("h"))
    return _with_copies(stored(rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n")), "mix-sizes"), weights, max_epochs, seed)


def _with_copies(rows: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: str) -> DataFrame:
    """Adds copies and taken to distinct rows with doc_id, source, size, h and their number n, a row each again."""
    block = ["source", "size_class", "deal"]
    rows = rows.withColumn("size_class", F.floor(F.sqrt(F.col("size").cast("double")))).withColumn("deal", F.substring("h", 1, 2))
    earlier = Window.partitionBy(*block).orderBy("size", "h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    in_block = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    blocks = rows.groupBy(*block).agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("size"))
    before = Window.partitionBy("source").orderBy("size_class", "deal").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    targets = source_targets(blocks.select("source", "size"), weights, max_epochs).withColumnRenamed("source", "t_source")
    blocks = blocks.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("b_source"), F.col("size_class").alias("b_class"), F.col("deal").alias("b_deal"), "before", "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size_class") == F.col("b_class")) & (F.col("deal") == F.col("b_deal"))
    pieces = rows.withColumn("in_block", in_block).join(blocks, same).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))))
    dealt = pieces.repartition("h", "doc_id", "piece")
    ranked = dealt.withColumn("nth", F.explode(F.sequence(F.col("piece") * PIECE + 1, F.least(F.col("n"), (F.col("piece") + 1) * PIECE))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit(""))))
    rank = (F.col("before") + F.col("in_block") + F.col("nth")).cast("double")
    copies = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    ranked = ranked.withColumn("copies", F.least(copies, F.lit(max_epochs)).cast("long"))
    return ranked.select("doc_id", "source", "size", "h", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the rows of docs with all their columns, each as often as the mix takes it.

    Copies are found per source and (doc_id, text): rows that agree in these share their copies in a fixed order of
    all their columns.
    """
    names = docs.columns
    source, h, part, nth, copies, copy = (fresh(docs, f"mix_{n}") for n in ("source", "h", "part", "nth", "copies", "copy"))
    keyed = docs.withColumns({source: F.col("source").cast("string"), h: _place_hash(seed)})
    plan = mixing_plan(docs, weights, max_epochs, seed).groupBy("source", "h", "copies").agg(F.count(F.lit(1)).alias("n"))
    # rows that agree in both: the first so many have the fewest copies, and so on; a row each of up to max_epochs + 1 numbers
    up_to = F.sum("n").over(Window.partitionBy("source", "h").orderBy("copies"))
    plan = stored(plan.select("source", "h", F.col("copies").alias(copies), (up_to - F.col("n")).alias("above"), up_to.alias("up_to")), "mix-plan")
    same = F.col(f"k.{source}").eqNullSafe(F.col("p.source")) & (F.col(f"k.{h}") == F.col("p.h"))
    if not plan.where("up_to > 1").isEmpty():
        keyed = _numbered(keyed, [source, h], names, part, nth)
        same = same & (F.col(f"k.{nth}") > F.col("p.above")) & (F.col(f"k.{nth}") <= F.col("p.up_to"))
    taken = keyed.alias("k").join(plan.where(F.col(copies) > 0).hint("shuffle_hash").alias("p"), same)
    # a Generate that repeats the row for each of its copies, of which there are max_epochs at most
    return taken.select(*[F.col(f"k.`{c}`") for c in names], F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy)).drop(copy)


def _numbered(rows: DataFrame, keys: list[str], names: list[str], part: str, nth: str) -> DataFrame:
    """rows with their number (from 1) among those of equal keys, counted in the parts that read them and then over the parts."""
    rows = stored(rows.withColumn(part, F.spark_partition_id()), "mix-parts")  # parts stay what they were, whoever reads them
    counts = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of = {c: fresh(rows, f"of_{c}") for c in (*keys, part, "before")}
    counts = counts.select(*[F.col(c).alias(of[c]) for c in (*keys, part)], before.alias(of["before"]))
    own = F.row_number().over(Window.partitionBy(*keys, part).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in names])))
    same = F.col(of[part]) == F.col(part)
    for c in keys:
        same = same & F.col(of[c]).eqNullSafe(F.col(c))
    placed = rows.withColumn(nth, own).join(counts, same)
    return placed.withColumn(nth, F.col(nth) + F.col(of["before"])).drop(*of.values())


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST(('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u,
             CAST(row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(d.size)), substr(d.h, 1, 2), d.size, d.h, d.doc_id) AS DOUBLE) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(size * least(copies, 3) AS BIGINT) AS taken FROM y
"""
