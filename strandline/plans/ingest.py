"""Queries over sources: code files, units, configuration, git dumps, stored layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import graph as R
from strandline.operators import lifecycle as L
from strandline.operators import search as S
from strandline.plans.registry import query
from strandline.plans.retrieval import VEC_SQL, _similar
from strandline.plans.structure import EDGE_SQL, _edges
from strandline.session import scratch_path
from strandline.sources import code as K
from strandline.sources import git_log, statements
from strandline.sources.tables import MEM_SQL, memories, table

MEM = f"WITH {MEM_SQL}"


def _sources(spark, sf):
    """A small Python or Go file for each part."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    py = F.format_string("import os\n\n\nclass %s:\n    def size(self, x):\n        return %s\n", name, F.col("p_size").cast("string"))
    go = F.format_string('package p\n\nimport "fmt"\n\nfunc %s(x int) int {\n\treturn %s\n}\n', name, F.col("p_size").cast("string"))
    even = F.col("p_partkey") % 2 == 0
    return table(spark, sf, "part").select(F.concat(F.lit("src/"), "p_partkey", F.when(even, ".py").otherwise(".go")).alias("path"), F.when(even, py).otherwise(go).alias("content"), F.when(even, "python").otherwise("go").alias("language"))


@query("A3 A4 P3 P4", "SELECT 'src/' || p_partkey || '.py' AS path, unnest(['class', 'function']) AS unit_type, unnest([replace(p_name, ' ', '_'), 'size']) AS name, unnest([4, 5])::INTEGER AS start_line, 6::INTEGER AS end_line FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'src/' || p_partkey || '.go', 'function', replace(p_name, ' ', '_'), 5, 7 FROM part WHERE p_partkey % 2 = 1")
def code_units(spark, sf):
    return K.code_units(_sources(spark, sf)).select("path", "unit_type", "name", "start_line", "end_line")


@query("A3", "SELECT 'src/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.go' END AS path, CASE WHEN p_partkey % 2 = 0 THEN 'os' ELSE 'fmt' END AS module, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 3 END::INTEGER AS line, false AS relative FROM part")
def import_lines(spark, sf):
    return statements.import_details(_sources(spark, sf)).select("path", "module", "line", "relative")


@query("P6", "SELECT event_id, 'k' AS name, 1::INTEGER AS start_line FROM events")
def config_keys(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("content"), F.lit("json").alias("language"))
    return K.code_units(e).select(F.col("path").cast("long").alias("event_id"), "name", "start_line")


DUMP = "concat('@', o_orderkey, '|', 'Author ', o_custkey, '|', o_custkey, '@example.com|', date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'), '|', o_orderpriority, ' | more')"


@query("A8", "SELECT CAST(o_orderkey AS VARCHAR) AS commit_hash, 'Author ' || o_custkey AS author_name, o_custkey || '@example.com' AS author_email, o_orderdate AS author_date, o_orderpriority || ' | more' AS message FROM orders")
def git_log_commits(spark, sf):
    return git_log.commits(table(spark, sf, "orders").select(F.expr(DUMP).alias("value")))


@query("A8 A9", "SELECT CAST(l_orderkey AS VARCHAR) AS commit_hash, 'f' || l_partkey AS file_path, CAST(l_quantity AS BIGINT) AS lines_added, CAST(l_linenumber AS BIGINT) AS lines_deleted FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def git_log_changes(spark, sf):
    head = table(spark, sf, "orders").select(F.col("o_orderkey").alias("dump"), F.lit(0).alias("line"), F.expr(DUMP).alias("value"))
    body = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("dump"), F.col("l_linenumber").alias("line"), F.concat_ws("\t", F.col("l_quantity").cast("long"), "l_linenumber", F.concat(F.lit("f"), "l_partkey")).alias("value"))
    return git_log.file_changes(head.unionByName(body)).where("commit_hash IS NOT NULL")


@query("B1", f"{MEM} SELECT count(*) * 2 AS n, count(*) * 2 AS n_ids FROM mem")
def insert_with_ids(spark, sf):
    m = memories(spark, sf).select("content")
    both = m.union(m).withColumn("id", L.row_id())
    return both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


@query("B21", f"{MEM} SELECT count(*) AS n, true AS refused FROM mem")
def read_only_store(spark, sf):
    store = L.read_only(memories(spark, sf))
    try:
        store.write  # noqa: B018
        refused = False
    except PermissionError:
        refused = True
    return store.agg(F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))


@query("D12 N3", f"WITH RECURSIVE {EDGE_SQL}, walk(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 2), {VEC_SQL} SELECT id, round(similarity, 6) AS similarity FROM vec WHERE id IN (SELECT node FROM walk) ORDER BY vec.similarity DESC, id LIMIT 10")
def dependency_search(spark, sf):
    start = spark.range(1).select(F.lit(3).cast("long").alias("node"))
    scope = R.reachable(_edges(spark, sf), start, 2).select("node").union(start)
    found = _similar(spark, sf).join(scope.distinct(), F.col("id") == F.col("node"), "left_semi")
    return S.top(found, "similarity", 10).select("id", F.round("similarity", 6).alias("similarity"))


@query("E49", f"{MEM}, {VEC_SQL}, r AS (SELECT project_name, id, row_number() OVER (PARTITION BY project_name ORDER BY similarity DESC, id) AS place FROM vec JOIN mem USING (id)) SELECT count(*) AS n_found, count(DISTINCT project_name) AS n_projects FROM r WHERE place <= 10")
def multi_search_totals(spark, sf):
    rows = _similar(spark, sf).join(memories(spark, sf).select("id", "project_name"), "id")
    place = F.row_number().over(Window.partitionBy("project_name").orderBy(F.col("similarity").desc(), "id"))
    return rows.withColumn("place", place).where("place <= 10").agg(F.count(F.lit(1)).alias("n_found"), F.countDistinct("project_name").alias("n_projects"))


@query("H3", "SELECT unnest(['*.log', 'build/', 'node_modules/', 'src/*.tmp']) AS pattern")
def merged_ignore_patterns(spark, sf):
    return spark.createDataFrame([(p,) for p in K.merged_patterns(["build/", "*.log", "node_modules/"], ["node_modules/x.js", "*.log", "src/*.tmp", "build/out/"])], "pattern string")


@query("N10 N9", f"{MEM} SELECT id, importance FROM mem WHERE project_name = 'src3' AND category = 'en' AND importance >= 0.5")
def stored_layout(spark, sf):
    """A table partitioned by project, with Bloom filters on id and sorted for min/max statistics."""
    path = scratch_path(spark, "memories")
    rows = memories(spark, sf).drop("content").hint("rebalance", "project_name").sortWithinPartitions("category", "importance")
    rows.write.partitionBy("project_name").option("parquet.bloom.filter.enabled#id", "true").parquet(path)
    return spark.read.parquet(path).where("project_name = 'src3' AND category = 'en' AND importance >= 0.5").select("id", "importance")


@query("A14 B18", f"{MEM} SELECT id, category, round(importance, 6) AS importance FROM mem")
def json_round_trip(spark, sf):
    """What an export holds, as an import reads it."""
    from strandline.sources.exchange import export_json, import_json

    path = scratch_path(spark, "export")
    export_json(memories(spark, sf).select("id", "category", "importance"), path)
    return import_json(spark, path, "id long, category string, importance double").withColumn("importance", F.round("importance", 6))


#: Lines of one dump, more or less.
DUMP_LINES = 1_000_000


def _dumps(spark, sf):
    """Orders as commits and their lines as changes, written as a folder of dumps of many commits each."""
    head = table(spark, sf, "orders").select(F.col("o_orderkey").alias("dump"), F.lit(0).alias("line"), F.expr(DUMP).alias("value"))
    body = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    body = body.select(F.col("l_orderkey").alias("dump"), F.col("l_linenumber").alias("line"), F.concat_ws("\t", F.col("l_quantity").cast("long"), "l_linenumber", F.concat(F.lit("f"), "l_partkey")).alias("value"))
    path = scratch_path(spark, "dumps")
    # how many dumps there are follows from the rows: a task sorts one of them
    lines = head.unionByName(body)
    parts = max(4, -(-(head.count() + table(spark, sf, "lineitem").count()) // DUMP_LINES))
    lines.repartitionByRange(parts, "dump").sortWithinPartitions("dump", "line").select("value").write.text(path)
    return path


@query("A8 A9", "SELECT CAST(l_orderkey AS VARCHAR) AS commit_hash, 'f' || l_partkey AS file_path, CAST(l_quantity AS BIGINT) AS lines_added, CAST(l_linenumber AS BIGINT) AS lines_deleted FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def git_dump_changes(spark, sf):
    """Large dumps, each read by several tasks that cut it at commits."""
    from strandline.sources import folders

    folders.register(spark)
    return spark.read.format("git_dump").option("range_bytes", 1 << 17).load(_dumps(spark, sf))


@query("A8", "SELECT CAST(o_orderkey AS VARCHAR) AS commit_hash, o_custkey || '@example.com' AS author_email, o_orderdate AS author_date, o_orderpriority || ' | more' AS message FROM orders WHERE o_custkey = 7 AND o_orderdate >= TIMESTAMP '1994-01-01'")
def git_dump_commits(spark, sf):
    """One author's commits: the author is tested at the source."""
    from strandline.sources import folders

    folders.register(spark)
    c = spark.read.format("git_dump").option("table", "commits").load(_dumps(spark, sf))
    return c.where("author_name = 'Author 7' AND author_date >= timestamp_ntz'1994-01-01'").select("commit_hash", "author_email", "author_date", "message")


FOLDER_SQL = "SELECT priority AS folder, count(*) AS n_lines, CAST(sum(length(line) + 1) AS BIGINT) AS n_bytes FROM (SELECT o_orderpriority AS priority, o_orderkey || ' ' || o_orderstatus AS line FROM orders) GROUP BY 1"


def _folder(spark, sf):
    """Orders as text files, in a folder for each priority."""
    path = scratch_path(spark, "folder")
    table(spark, sf, "orders").select("o_orderpriority", F.concat_ws(" ", "o_orderkey", "o_orderstatus").alias("value")).repartition(3).write.partitionBy("o_orderpriority").text(path)
    return path


def _per_folder(files):
    folder = F.url_decode(F.regexp_extract("path", "o_orderpriority=([^/]+)/", 1))
    lines = F.size(F.split("content", "\n")) - 1
    return files.groupBy(folder.alias("folder")).agg(F.sum(lines).cast("long").alias("n_lines"), F.sum("size").cast("long").alias("n_bytes"))


@query("A4", FOLDER_SQL)
def folder_scan(spark, sf):
    """Every file below a folder, as a batch."""
    from strandline.sources import folders

    folders.register(spark)
    return _per_folder(spark.read.format("watched_folder").option("suffix", ".txt").load(_folder(spark, sf)))


@query("A4 L1", FOLDER_SQL)
def folder_stream(spark, sf):
    """The same as a stream whose offset is the last file's time and path."""
    from strandline.sources import folders
    from strandline.streaming.streams import drained

    folders.register(spark)
    return _per_folder(drained(spark.readStream.format("watched_folder").option("suffix", ".txt").load(_folder(spark, sf)), "append"))


@query("B1 B2", f"{MEM} SELECT category, count(*) AS n, count(*) AS n_ids, round(sum(importance), 4) AS importance FROM mem WHERE importance >= 0.5 GROUP BY category")
def inserted_rows(spark, sf):
    """Rows get ids as they are appended in two batches, and are read back from what was written."""
    path = scratch_path(spark, "inserted")
    m = memories(spark, sf).select("category", "importance", "content")
    for batch in (m.where("importance >= 0.7"), m.where("importance >= 0.5 AND importance < 0.7")):
        batch.withColumn("id", L.row_id()).write.mode("append").partitionBy("category").parquet(path)
    return spark.read.parquet(path).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.round(F.sum("importance"), 4).alias("importance"))


@query("I8 I1", "WITH RECURSIVE e AS (SELECT DISTINCT page_id AS src, n AS dst FROM (SELECT page_id, unnest(regexp_extract_all(html, '[0-9]+')) AS d FROM pages), (SELECT page_id AS n FROM pages) WHERE TRY_CAST(d AS BIGINT) = n AND n <> page_id), w(node, depth) AS (SELECT (SELECT min(src) FROM e), 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE node <> (SELECT min(src) FROM e) GROUP BY node")
def stored_reference_graph(spark, sf):
    """Pages and the pages whose numbers they name: stored as metadata of each page, from which a later job builds the graph and walks it."""
    p = table(spark, sf, "pages")
    path = scratch_path(spark, "references")
    p.select("page_id", F.transform(F.regexp_extract_all("html", F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("long")).alias("references")).write.parquet(path)
    stored = spark.read.parquet(path)
    e = stored.select(F.col("page_id").alias("src"), F.explode(F.array_distinct("references")).alias("dst")).where("src <> dst")
    e = e.join(stored.select(F.col("page_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    start = e.agg(F.min("src").alias("node")).where("node IS NOT NULL")
    return R.reachable(e, start, 3).join(F.broadcast(start), "node", "left_anti")  # one row
