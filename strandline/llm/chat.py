"""Operator 1: chat formatting, with cumulative snapshots collapsed. DataFrame functions only.

A chat service logs a conversation again after each exchange, so most logged conversations are
prefixes of a longer one. Each turn is hashed with its number, role and text; the running
combination of these hashes names every prefix of a conversation. A conversation whose whole
hash is another's proper prefix is dropped by an anti-join, and of identical conversations the
smallest conv_id stays. What remains is rendered.

Nothing gathers a conversation in one place. Distinct turns are range-partitioned and numbered in order, so a
frequent conv_id, or turn number, is dealt over many tasks. A conversation is cut into parts of ``part_turns`` turn
numbers, and these into pieces of as many rows; turns are hashed within pieces, and only the pieces' totals
meet in a running window. Rendered text comes per piece, in order, so no row outgrows a piece.

Defined results: turns are ordered by turn, role and text, nulls first; a repeated row counts once; null turn
numbers come first, in a part -1 of their own; a null role or text renders as empty but
differs from an empty one in comparisons; rows with a null conv_id form one conversation with
that id; an empty table gives no rows. Further columns are not read. Marker strings inside a
text are broken with a space so that no text can pose as a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import stored

#: The markers of a rendered turn.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def _xor_all(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _turn_hash(x: Column, seed: int) -> Column:
    """64 bits of a turn; nulls are told from empty strings."""
    nil = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.xxhash64(F.lit(seed), x["turn"].isNull(), nil(x["turn"]), x["role"].isNull(), nil(x["role"]), x["text"].isNull(), nil(x["text"]))


def _hashing(seed: int):
    return lambda x: _turn_hash(x, seed)


_ORDER = ("conv_id", "turn", "role", "text")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Distinct turns with seq, which ascends in the order of conv_id, turn, role and text; its upper bits are a partition's."""
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    rows = turns.select(*_ORDER).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.withColumn("seq", F.monotonically_increasing_id()), "turns")


def conversation_pieces(rows: DataFrame, part_turns: int) -> DataFrame:
    """conv_id, part, piece, first_seq and the piece's turns in order, part_turns at most."""
    rows = rows.withColumns({"part": F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long"), "nil": F.col("turn").isNull(), "partition": F.shiftright("seq", 33)})
    runs = rows.groupBy("conv_id", "nil", "part", "partition").agg(F.min("seq").alias("start"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id", "nil", "part").orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("of"), F.col("nil").alias("of_nil"), F.col("part").alias("of_part"), F.col("partition").alias("of_partition"), "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("nil") == F.col("of_nil")) & (F.col("part") == F.col("of_part")) & (F.col("partition") == F.col("of_partition"))
    return (
        rows.join(runs, same)
        .withColumn("piece", F.floor((F.col("seq") - F.col("start") + F.col("before")) / part_turns).cast("long"))
        .groupBy("conv_id", "nil", "part", "piece")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "turn", "role", "text"))).alias("turns"), F.min("seq").alias("first_seq"))
    )


def maximal_conversations(pieces: DataFrame) -> DataFrame:
    """conv_id and n_copies of conversations that are nobody's proper prefix, one of each content."""
    hashed = pieces.select("conv_id", "first_seq", *[F.transform("turns", _hashing(s)).alias(f"h{s}") for s in (1, 2)])
    hashed = hashed.select(
        "conv_id",
        "first_seq",
        F.size("h1").alias("n"),
        *[_xor_all(F.col(f"h{s}")).alias(f"all{s}") for s in (1, 2)],
        F.transform(
            F.sequence(F.lit(1), F.size("h1")),
            lambda i: F.struct(*[_xor_all(F.slice(F.col(f"h{s}"), F.lit(1), i)).alias(f"p{s}") for s in (1, 2)], i.alias("i")),
        ).alias("prefixes"),
    )
    conversation = Window.partitionBy("conv_id").orderBy("first_seq")
    before = conversation.rowsBetween(Window.unboundedPreceding, -1)
    rolled = hashed.select(
        F.col("first_seq").alias("at"),
        F.lead("first_seq").over(conversation).isNull().alias("ends"),
        *[F.coalesce(F.expr(f"bit_xor(all{s})").over(before), F.lit(0)).alias(f"o{s}") for s in (1, 2)],
    )
    prefixes = (
        hashed.select("first_seq", "n", "prefixes")
        .join(rolled, F.col("first_seq") == F.col("at"))
        .select("n", "ends", "o1", "o2", F.explode("prefixes").alias("p"))
        .where(~(F.col("ends") & (F.col("p.i") == F.col("n"))))
        .select(F.col("o1").bitwiseXOR(F.col("p.p1")).alias("p1"), F.col("o2").bitwiseXOR(F.col("p.p2")).alias("p2"))
        .distinct()
    )
    contents = hashed.groupBy("conv_id").agg(F.expr("bit_xor(all1)").alias("p1"), F.expr("bit_xor(all2)").alias("p2"))
    contents = contents.groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    return contents.join(prefixes, ["p1", "p2"], "left_anti").select("conv_id", "n_copies")


def render_turn(x: Column) -> Column:
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    return F.concat(F.lit(TURN_START), clean(x["role"]), F.lit("\n"), clean(x["text"]), F.lit(TURN_END + "\n"))


def format_chats(turns: DataFrame, part_turns: int = 256) -> DataFrame:
    """conv_id, part, piece, n_copies (conversations of this content), n_turns and rendered, a row a piece."""
    pieces = conversation_pieces(numbered_turns(turns), part_turns)
    kept = maximal_conversations(pieces).withColumnRenamed("conv_id", "kept_id")
    return pieces.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select(
        "conv_id",
        "part",
        "piece",
        "n_copies",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", render_turn), "").alias("rendered"),
    )


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS i FROM c)),
u AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns),
k AS (SELECT u.conv_id, u.n_copies FROM u ANTI JOIN p ON u.turns = p.turns)
SELECT t.conv_id, part, piece, any_value(k.n_copies) AS n_copies, count(*) AS n_turns,
       string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|im_', '< |im_') || chr(10)
         || replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, role, text) - 1) // 256 AS piece
      FROM (SELECT *, CAST(floor(turn / 256.0) AS BIGINT) AS part FROM t)) AS t JOIN k ON t.conv_id = k.conv_id
GROUP BY t.conv_id, part, piece
"""
