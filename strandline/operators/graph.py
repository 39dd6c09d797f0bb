"""Graphs as edge tables (src, dst): closures, paths, cycles, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strandline.session import discard, scratch_path, stored


def dependencies(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == node).select("dst").distinct()


def dependents(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("dst") == node).select("src").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reachable(edges: DataFrame, start: DataFrame, depth: int = 10) -> DataFrame:
    """node, depth (the least) of what a start reaches in up to depth steps, without the start.

    start: node. Edges are written once. All rings stand in one table, a folder for each depth: a round joins the last ring
    with the edges, drops what the table holds and adds its own folder, so the plan doesn't grow and lost executors cost one round.
    """
    spark = edges.sparkSession
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    at = scratch_path(spark, "visited")
    start.select("node").distinct().write.parquet(f"{at}/depth=0")
    node = start.select("node").schema
    for d in range(1, depth + 1):
        ring = spark.read.schema(node).parquet(f"{at}/depth={d - 1}")
        step = ring.join(edges, ring["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        known = spark.read.schema(node).parquet(*[f"{at}/depth={i}" for i in range(d)])
        step.join(known, "node", "left_anti").write.parquet(f"{at}/depth={d}")
        if spark.read.schema(node).parquet(f"{at}/depth={d}").isEmpty():
            break
    return spark.read.schema(StructType([*node.fields, StructField("depth", IntegerType())])).option("basePath", at).parquet(at).where("depth > 0")


def shortest_path(edges: DataFrame, source, target, depth: int = 10) -> DataFrame:
    """One row with path (array) and hops, the least one in node order; no row if there is none.

    A node keeps only its best path, so rows stay within the number of nodes. Edges are written once, paths in one table with a
    folder for each length.
    """
    spark = edges.sparkSession
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    kind = edges.schema["src"].dataType
    best = spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.array(F.lit(source).cast(kind)).alias("path"))
    schema, at = best.schema, scratch_path(spark, "paths")
    best.write.parquet(f"{at}/0")
    for d in range(depth + 1):
        ring = spark.read.schema(schema).parquet(f"{at}/{d}")
        if d == depth or ring.isEmpty() or not ring.where(F.col("node") == target).isEmpty():
            break
        step = ring.join(edges, ring["node"] == edges["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        known = spark.read.schema(schema).parquet(*[f"{at}/{i}" for i in range(d + 1)])
        step.groupBy("node").agg(F.min("path").alias("path")).join(known.select("node"), "node", "left_anti").write.parquet(f"{at}/{d + 1}")
    return ring.where(F.col("node") == target).select("path", (F.size("path") - 1).alias("hops"))


def _runs_in(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, at, least, loops (and fell) for each node with one edge in: the first node behind it that hasn't one, and the least label from there (without it) to the node.

    Each job doubles how far back a node has looked. Behind nodes with loops there is no such node, but a ring of nodes with one
    edge in; their least label is final. It ends when no node finds the end of its run any more and no label falls.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("at")).where("n = 1")
    run = stored(into.join(labels.hint("merge"), "node").select("node", "at", F.col("label").alias("least"), F.lit(True).alias("loops"), F.lit(False).alias("fell")), "runs")
    known, n = (run.count(), 1), -1
    while known[0] and (known[0] != n or known[1]):
        n = known[0]
        behind = run.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("least").alias("more"))
        far = run.join(behind.hint("merge"), "at", "left")
        fell = F.coalesce(F.col("more") < F.col("least"), F.lit(False))
        before, run = run, stored(far.select("node", F.coalesce("to", "at").alias("at"), F.least("least", "more").alias("least"), F.col("to").isNotNull().alias("loops"), fell.alias("fell")), "runs")
        discard(before)
        known = run.agg(F.count_if("loops"), F.count_if("fell")).first()
    return run


def _least_reaching(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node and label: the least label of the nodes that reach it, its own included. labels: node, label; edges are distinct, without loops.

    What reaches a node with one edge in comes by that edge. Such nodes are skipped, and step by step labels go only between the
    others, by jobs as many as the longest way over these. Only labels that fell are sent on.
    """
    run = _runs_in(edges, labels)
    skip = run.select(F.col("node").alias("src"), "at", "least", "loops")
    ways = edges.join(run.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti").join(skip.hint("merge"), "src", "left")
    ways = stored(ways.select(F.when(F.col("at").isNull(), F.col("src")).when(~F.col("loops"), F.col("at")).alias("src"), "dst", "least"), "ways")
    first = ways.groupBy(F.col("dst").alias("node")).agg(F.min("least").alias("given"))
    now = stored(labels.join(run.select("node").hint("merge"), "node", "left_anti").join(first.hint("merge"), "node", "left").select("node", F.least("label", "given").alias("label"), F.lit(True).alias("moved")), "labels")
    hops = stored(ways.where("src <> dst").select("src", "dst").distinct(), "hops")
    while not (moved := now.where("moved")).isEmpty():
        sent = moved.join(hops.hint("merge"), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("got"))
        before, now = now, stored(now.join(sent.hint("merge"), "node", "left").select("node", F.least("label", "got").alias("label"), F.coalesce(F.col("got") < F.col("label"), F.lit(False)).alias("moved")), "labels")
        discard(before)
    ends = now.select(F.col("node").alias("at"), "label")
    skipped = run.join(ends.hint("merge"), "at", "left").select("node", F.least("least", F.when(~F.col("loops"), F.col("label"))).alias("label"))
    out = stored(now.select("node", "label").union(skipped), "labels")
    for x in (run, ways, hops, now):
        discard(x)
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): nodes that reach each other, by the least nodes before and behind them.

    A round finds for each node the least one that reaches it and the least one that it reaches. Where both are the same, that
    node's component is found; an edge whose ends differ in either lies in no component and goes. Nodes of a component never differ, and
    rounds end when no edge is left. From the second round on nodes are ordered by a hash, another one each round, so that no
    numbering of the nodes makes many rounds. What a round leaves is written. Joins aren't broadcast: their sides would pass through the driver in each step.
    """
    live = stored(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    every, turn = None, 0
    while not live.isEmpty():
        order = F.xxhash64("node", F.lit(turn)) if turn else F.lit(0).cast("long")
        ends = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct()
        labels = stored(ends.select("node", F.struct(order.alias("place"), "node").alias("label")), "labels")
        fore, back = _least_reaching(live, labels), _least_reaching(reversed_edges(live), labels)
        both = stored(fore.withColumnRenamed("label", "fore").join(back.withColumnRenamed("label", "back").hint("merge"), "node"), "both")
        whole = both.where("fore = back").select("node", "fore")
        least = whole.select("node", F.col("fore.node").alias("component"))
        if turn:
            least = whole.join(whole.groupBy("fore").agg(F.min("node").alias("component")).hint("merge"), "fore").select("node", "component")
        found = stored(least, "components")
        every = found if every is None else every.union(found)
        of = lambda end: both.where("fore <> back").select(F.col("node").alias(end), F.struct("fore", "back").alias(f"of_{end}"))
        before, live = live, stored(live.join(of("src").hint("merge"), "src").join(of("dst").hint("merge"), "dst").where("of_src = of_dst").select("src", "dst"), "edges")
        for x in (before, labels, fore, back, both):
            discard(x)
        turn += 1
    if every is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(every.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cycles(edges: DataFrame, longest: int = 10) -> DataFrame:
    """cycle: each simple cycle of up to longest nodes once, begun at its smallest node.

    A cycle stands within one strong component, so paths are followed there only: a graph without cycles has none.
    """
    of = stored(strong_components(edges), "components")
    end = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    out = edges.where("src = dst").select(F.array("src").alias("cycle"))
    edges = stored(edges.where("src <> dst").join(end("src"), "src").join(end("dst"), "dst").where("of_src = of_dst").select("src", "dst").distinct(), "edges")
    paths = edges.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    for _ in range(longest - 1):
        if paths.isEmpty():
            break
        step = paths.join(edges, paths["last"] == edges["src"])
        out = out.unionByName(step.where(F.col("dst") == F.col("path")[0]).select(F.col("path").alias("cycle")))
        paths = stored(step.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")), "cycle-paths")
    return out.distinct()


def closes_cycle(edges: DataFrame, src, dst, depth: int = 10) -> bool:
    """Whether a new edge src -> dst would close a cycle: whether dst reaches src."""
    if src == dst:
        return True
    start = edges.sparkSession.range(1).select(F.lit(dst).cast(edges.schema["src"].dataType).alias("node"))
    return not reachable(edges, start, depth).where(F.col("node") == src).isEmpty()


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree and in_degree over distinct edges."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def call_edges(units: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """src (caller), dst (callee): identifiers before '(' in a unit that name another unit."""
    called = units.select(F.col(name).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(content), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))).alias("dst"))
    return called.join(units.select(F.col(name).alias("dst")).distinct(), "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()


def resolved_imports(imports: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """src, dst: each import's first candidate path that is a known file. files: file_path."""
    tried = imports.select("src", "module", F.posexplode(candidates).alias("place", "file_path"))
    found = tried.join(files.select("file_path").distinct(), "file_path")
    return found.groupBy("src", "module").agg(F.min(F.struct("place", "file_path")).alias("best")).select("src", "module", F.col("best.file_path").alias("dst"))


def statistics(edges: DataFrame, k: int = 5) -> DataFrame:
    """figure, node, n, mean: the number of nodes with the mean degree, then the k nodes of most edges out and in."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("incoming"))
    both = out.join(into, "node", "full_outer").na.fill(0, ["outgoing", "incoming"])
    whole = both.agg(F.count(F.lit(1)).alias("n"), F.sum("outgoing").alias("edges"))
    kind = edges.schema["src"].dataType
    rows = whole.select(F.lit("all").alias("figure"), F.lit(None).cast(kind).alias("node"), "n", F.round(F.col("edges") / F.col("n"), 6).alias("mean"))
    for name in ("outgoing", "incoming"):
        best = both.orderBy(F.col(name).desc(), "node").limit(k)
        rows = rows.union(best.select(F.lit(name), "node", F.col(name), F.lit(None).cast("double")))
    return rows
