"""Queries over graphs, near-duplicates, code metrics and classifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import code as C
from strandline.functions import scores as X
from strandline.functions import text as T
from strandline.operators import dedup as D
from strandline.operators import graph as R
from strandline.operators.keyword_index import distinct_terms
from strandline.operators.sessions import last_of_each
from strandline.plans.registry import query
from strandline.session import spread
from strandline.sources import code as K
from strandline.sources.tables import AS_OF, MEM_SQL, as_of, memories, table

MEM = f"WITH {MEM_SQL}"

# A graph of suppliers: each depends on the next two of its nation by key, the last one on the first.
EDGE_SQL = """edges AS (SELECT s_suppkey AS src, coalesce(lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), min(s_suppkey) OVER (PARTITION BY s_nationkey)) AS dst FROM supplier
 UNION SELECT src, dst FROM (SELECT s_suppkey AS src, lead(s_suppkey, 2) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS dst FROM supplier) WHERE dst IS NOT NULL)"""


def _edges(spark, sf):
    s = table(spark, sf, "supplier")
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    ring = s.select(F.col("s_suppkey").alias("src"), F.coalesce(F.lead("s_suppkey").over(w), F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))).alias("dst"))
    skip = s.select(F.col("s_suppkey").alias("src"), F.lead("s_suppkey", 2).over(w).alias("dst")).where("dst IS NOT NULL")
    return ring.union(skip).distinct()


@query("I1 I2 I7", f"WITH {EDGE_SQL} SELECT 'out' AS direction, dst AS node FROM edges WHERE src = 3 UNION ALL SELECT 'in', src FROM edges WHERE dst = 3")
def graph_neighbours(spark, sf):
    e = _edges(spark, sf)
    out = R.dependencies(e, 3).select(F.lit("out").alias("direction"), F.col("dst").alias("node"))
    return out.union(R.dependents(e, 3).select(F.lit("in").alias("direction"), F.col("src").alias("node")))


CLOSURE = "WITH RECURSIVE {e}, walk(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT {to}, depth + 1 FROM walk JOIN edges ON {on} = node WHERE depth < 10) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE node <> 3 GROUP BY node"


def _start(spark, node):
    return spark.range(1).select(F.lit(node).cast("long").alias("node"))


@query("I3 I8 I9 Q26", CLOSURE.format(e=EDGE_SQL, to="dst", on="src"))
def graph_closure(spark, sf):
    return R.reachable(_edges(spark, sf), _start(spark, 3)).where("node <> 3")


@query("I4", CLOSURE.format(e=EDGE_SQL, to="src", on="dst"))
def graph_dependents_closure(spark, sf):
    return R.reachable(R.reversed_edges(_edges(spark, sf)), _start(spark, 3)).where("node <> 3")


@query("I5", f"WITH RECURSIVE {EDGE_SQL}, goal AS (SELECT max(s_suppkey) AS g FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 3)), walk(node, path) AS (SELECT 3::BIGINT, [3::BIGINT] UNION SELECT dst, list_append(path, dst) FROM walk JOIN edges ON src = node WHERE len(path) <= 10 AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops FROM walk, goal WHERE node = g ORDER BY len(path), walk.path LIMIT 1")
def shortest_path(spark, sf):
    s = table(spark, sf, "supplier")
    goal = s.join(s.where("s_suppkey = 3").select("s_nationkey"), "s_nationkey").agg(F.max("s_suppkey")).first()[0]
    return R.shortest_path(_edges(spark, sf), 3, goal).select(F.array_join("path", ">").alias("path"), "hops")


# A small registry graph with cycles: nations depend on their region's first nation and that on its region's second.
REPO_SQL = """edges AS (SELECT n_nationkey AS src, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS dst FROM nation QUALIFY src <> dst UNION
 SELECT min(n_nationkey), list_sort(list(n_nationkey))[2] FROM nation GROUP BY n_regionkey UNION SELECT list_sort(list(n_nationkey))[3], list_sort(list(n_nationkey))[2] FROM nation GROUP BY n_regionkey UNION SELECT list_sort(list(n_nationkey))[2], list_sort(list(n_nationkey))[3] FROM nation GROUP BY n_regionkey)"""


def _repos(spark, sf):
    n = table(spark, sf, "nation")
    up = n.select(F.col("n_nationkey").alias("src"), F.min("n_nationkey").over(Window.partitionBy("n_regionkey")).alias("dst")).where("src <> dst")
    g = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))
    at = lambda i, j: g.select(F.col("k")[i].alias("src"), F.col("k")[j].alias("dst"))
    return up.union(at(0, 1)).union(at(2, 1)).union(at(1, 2)).distinct()


@query("I6", f"WITH RECURSIVE {REPO_SQL}, walk(path, last) AS (SELECT [src, dst], dst FROM edges WHERE src < dst UNION SELECT list_append(path, dst), dst FROM walk JOIN edges ON src = last WHERE dst > path[1] AND NOT list_contains(path, dst) AND len(path) < 10) SELECT DISTINCT array_to_string(path, '>') AS cycle FROM walk JOIN edges ON src = last AND dst = path[1]")
def graph_cycles(spark, sf):
    return R.cycles(_repos(spark, sf)).select(F.array_join("cycle", ">").alias("cycle"))


SCC_SQL = """edges AS (SELECT s_suppkey AS src, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS dst FROM supplier UNION SELECT s_suppkey, (s_suppkey * 3) % (SELECT count(*) FROM supplier) FROM supplier WHERE s_suppkey % 4 > 0)"""


@query("I6 I9", f"WITH RECURSIVE {SCC_SQL}, walk(x, y) AS (SELECT src, dst FROM edges UNION SELECT x, dst FROM walk JOIN edges ON src = y), n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, least(node, coalesce((SELECT min(a.y) FROM walk a JOIN walk b ON a.x = b.y AND a.y = b.x WHERE a.x = node), node)) AS component FROM n")
def strong_components(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey")
    s = s.crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("n"))))
    to = lambda c: s.select(F.col("s_suppkey").alias("src"), (c % F.col("n")).alias("dst"))
    return R.strong_components(to(F.col("s_suppkey") * 7 + 3).union(to(F.col("s_suppkey") * 3).where("src % 4 > 0")))


@query("I10", f"WITH RECURSIVE {REPO_SQL}, walk(node) AS (SELECT 1 UNION SELECT dst FROM walk JOIN edges ON src = node) SELECT count(*) > 0 AS closes FROM walk WHERE node = 6")
def cycle_guard(spark, sf):
    return spark.createDataFrame([(R.closes_cycle(_repos(spark, sf), 6, 1),)], "closes boolean")


@query("E46", f"WITH {EDGE_SQL}, o AS (SELECT src AS node, count(*) AS o FROM edges GROUP BY 1), i AS (SELECT dst AS node, count(*) AS i FROM edges GROUP BY 1) SELECT node, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM o FULL JOIN i USING (node)")
def degree_stats(spark, sf):
    return R.degrees(_edges(spark, sf))


CALL_SQL = """u AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') AS name FROM part), n AS (SELECT count(*) AS n FROM part),
c AS (SELECT u.name AS src, a.name AS x, b.name AS y FROM u, n JOIN u AS a ON a.k = (u.k * 7) % n JOIN u AS b ON b.k = (u.k * 3 + 1) % n)"""


@query("D10 L8", f"WITH {CALL_SQL} SELECT DISTINCT src, dst FROM (SELECT src, x AS dst FROM c UNION ALL SELECT src, y FROM c) WHERE src <> dst")
def call_edges(spark, sf):
    """Parts as functions; each calls two others, and one that is no unit."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    n = p.agg(F.count(F.lit(1)).alias("n"))
    at = lambda key, name: p.select(F.col("k").alias(key), F.col("name").alias(name))
    units = p.crossJoin(F.broadcast(n)).withColumns({"kx": F.col("k") * 7 % F.col("n"), "ky": (F.col("k") * 3 + 1) % F.col("n")}).join(at("kx", "x"), "kx").join(at("ky", "y"), "ky")
    return R.call_edges(units.select("name", F.format_string("def run():\n    return %s(1) + %s (2) + unknown_%s(name)\n", "x", "y", "name").alias("content")))


@query("D11 Q27", "WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), k AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS file_path FROM p), i AS (SELECT DISTINCT path AS src, split_part(path, '/', 1) AS module FROM p), t AS (SELECT src, module, module || '/' || ext AS f, place FROM i, (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) v(ext, place)) SELECT src, module, arg_min(f, place) AS dst FROM t JOIN k ON f = file_path GROUP BY src, module")
def import_resolution(spark, sf):
    path = F.regexp_replace("url", "^https?://", "")
    p = table(spark, sf, "pages").select(path.alias("path"))
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    files = p.select(F.concat(part(1), F.lit("/"), part(2)).alias("file_path"))
    found = p.select(F.col("path").alias("src"), part(1).alias("module")).distinct()
    return R.resolved_imports(found, files, F.array(*[F.concat("module", F.lit("/" + x)) for x in ("de", "en", "es", "fr")]))


# near-duplicate vectors; the table has no pair above 0.5, so the thresholds of these queries are lower

PAIR_SQL = "pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4)"
CLUSTER_SQL = "members AS (WITH RECURSIVE walk(id, m) AS (SELECT id, id FROM (SELECT a AS id FROM pairs UNION SELECT b FROM pairs) UNION SELECT e.y, walk.m FROM walk JOIN (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs) e ON walk.id = e.x) SELECT id, min(m) AS cluster FROM walk GROUP BY id)"


def _pairs(spark, sf, threshold=0.4):
    return D.similar_pairs(table(spark, sf, "embeddings"), threshold, id_="vec_id")


@query("D8 D9 I15 I16", f"WITH {PAIR_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def dup_pairs(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("I11 I12", f"WITH {PAIR_SQL}, {CLUSTER_SQL} SELECT id, cluster FROM members")
def dup_clusters(spark, sf):
    return D.clusters(_pairs(spark, sf))


@query("I11 I18 I19", f"WITH {PAIR_SQL}, {CLUSTER_SQL}, s AS (SELECT cluster, count(*) AS size FROM members GROUP BY 1) SELECT cluster, any_value(size) AS size, round(avg(similarity), 6) AS mean_similarity, min(similarity) >= 0.42 AS auto_merge, bool_or(similarity >= 0.4 AND similarity < 0.42) AS review FROM pairs JOIN members ON a = id JOIN s USING (cluster) GROUP BY cluster")
def cluster_figures(spark, sf):
    p = _pairs(spark, sf)
    m = D.clusters(p)
    figures = D.cluster_figures(m, p).select("cluster", "size", F.round("mean_similarity", 6).alias("mean_similarity"))
    return figures.join(D.merge_candidates(m, p, 0.42, 0.4), "cluster")


@query("I13 Q22", f"WITH {PAIR_SQL}, {CLUSTER_SQL} SELECT cluster, arg_min(id, {{'d': label < 5, 'c': label, 'i': id}}) AS canonical FROM members JOIN embeddings ON vec_id = id GROUP BY cluster")
def canonical_members(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).alias("documented"), F.col("label").alias("complexity"), F.lit(0).alias("length"))
    return D.canonical(D.clusters(_pairs(spark, sf)), rows)


@query("I14", f"""WITH RECURSIVE {PAIR_SQL}, o AS (SELECT a, list_sort(list(DISTINCT b)) AS bs, row_number() OVER (ORDER BY a) AS k FROM pairs GROUP BY a),
r(k, taken, leader, mine) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN list_contains(taken, o.a) THEN taken ELSE list_concat(list_concat(taken, [o.a]), list_filter(bs, lambda x: NOT list_contains(taken, x))) END, o.a,
 CASE WHEN list_contains(taken, o.a) THEN [] ELSE list_filter(bs, lambda x: NOT list_contains(taken, x)) END FROM r JOIN o ON o.k = r.k + 1) SELECT leader, unnest(mine) AS member FROM r""")
def greedy_leaders(spark, sf):
    return D.greedy_leaders(_pairs(spark, sf))


@query("I20", f"WITH {PAIR_SQL}, s AS (SELECT a AS id, similarity FROM pairs UNION ALL SELECT b, similarity FROM pairs) SELECT vec_id AS id, round(coalesce(max(similarity), 0), 6) AS duplication FROM embeddings LEFT JOIN s ON vec_id = id GROUP BY vec_id")
def duplication_score(spark, sf):
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return D.duplication_score(_pairs(spark, sf), ids, 0.4).select("id", F.round("duplication", 6).alias("duplication"))


@query("G3 N9")
def lsh_pairs(spark, sf):
    return D.lsh_pairs(table(spark, sf, "embeddings"), 0.4, planes=6, tables=32, id_="vec_id")


@query("H5", "WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2)) AS t FROM benchmark) SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard FROM b x JOIN b y ON x.item_id < y.item_id WHERE len(list_intersect(x.t, y.t)) > 0")
def jaccard_pairs(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    # items meet by shared tokens, not all with all
    postings = b.select("item_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    x, y = postings.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "token"), postings.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "token")
    shared = x.join(y, "token").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return shared.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard"))


@query("H5", "WITH b AS (SELECT item_id AS id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2)) AS t FROM benchmark UNION ALL SELECT 1000000 + doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2)) FROM documents), p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.t, y.t)) AS i, len(x.t) + len(y.t) AS n FROM b x JOIN b y ON x.id < y.id AND least(len(x.t), len(y.t)) >= 0.6 * greatest(len(x.t), len(y.t)) - 0.001 AND len(x.t) > 0) SELECT a, b, round(i / (n - i), 6) AS jaccard FROM p WHERE i / (n - i) >= 0.6")
def similar_sets(spark, sf):
    """Texts and benchmark items whose sets of terms are alike to 0.6."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = table(spark, sf, "documents").select((F.col("doc_id") + 1_000_000).alias("id"), "text")
    return D.similar_sets(distinct_terms(b.union(d), "id", "text", "items"), 0.6).withColumn("jaccard", F.round("jaccard", 6))


# code metrics over page sources

CODE_SQL = r"""code AS (SELECT page_id, html, least(40, 1 + len(regexp_extract_all(html, '\bif\b')) + len(regexp_extract_all(html, '\belif\b')) + len(regexp_extract_all(html, '\bfor\b')) + len(regexp_extract_all(html, '\bwhile\b')) + len(regexp_extract_all(html, '\band\b')) + len(regexp_extract_all(html, '\bor\b')) + len(regexp_extract_all(html, '\bexcept\b')) + len(regexp_extract_all(html, '\bcase\b'))) AS cyc,
 len(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '\S') AND NOT regexp_matches(x, '^\s*(#|//|/\*|\*|"{3}|''{3})'))) AS lines,
 least(10, greatest(0, coalesce(list_max(list_transform(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '\S')), lambda x: length(regexp_extract(x, '^(\s*)', 1)) // 4)), 0))) AS nest,
 least(10, len(list_filter(list_transform(string_split(regexp_extract(html, '\((.*?)\)', 1), ','), lambda x: trim(x)), lambda x: length(x) > 0 AND lower(x) NOT IN ('self', 'cls', 'this')))) AS params, length(regexp_extract(html, '(?s)"{3}.*?"{3}')) > 10 AS docs FROM pages)"""


def _code(spark, sf):
    h = F.col("html")
    p = spread(table(spark, sf, "pages").select("page_id", "html"))
    return p.withColumns({"cyc": C.cyclomatic(h), "lines": C.code_lines(h), "nest": C.nesting(h), "params": C.parameters(h), "docs": C.documented(h)})


@query("K4 K5 K6 K7 K8", f"WITH {CODE_SQL} SELECT page_id, CAST(cyc AS INTEGER) AS cyc, CAST(lines AS INTEGER) AS lines, CAST(nest AS INTEGER) AS nest, CAST(params AS INTEGER) AS params, docs FROM code")
def code_metrics(spark, sf):
    return _code(spark, sf).drop("html")


SCORE_SQL = "round(greatest(0.3, least(0.7, 0.3 + (least(cyc / 20, 1) * 0.4 + least(lines / 500, 1) * 0.3 + least(nest / 5, 1) * 0.2 + least(params / 5, 1) * 0.1) * 0.4 + CASE WHEN docs THEN 0.05 ELSE 0 END))::DOUBLE, 6)"
MI_SQL = "greatest(0, least(95, CAST(trunc(100 - 2 * cyc - lines / 10) AS INTEGER))) + CASE WHEN docs THEN 5 ELSE 0 END"


@query("K9 K10 K11 K12 K13", f"WITH {CODE_SQL}, m AS (SELECT *, {SCORE_SQL} AS score, {MI_SQL} AS mi FROM code) SELECT page_id, score, CAST(mi AS INTEGER) AS mi, CASE WHEN cyc <= 5 THEN 'low' WHEN cyc <= 10 THEN 'medium' WHEN cyc <= 20 THEN 'high' ELSE 'critical' END AS complexity, CASE WHEN mi >= 85 THEN 'low' WHEN mi >= 65 THEN 'medium' WHEN mi >= 50 THEN 'high' ELSE 'critical' END AS upkeep, array_to_string(list_filter([CASE WHEN cyc > 10 THEN 'high_complexity' END, CASE WHEN lines > 100 THEN 'long_function' END, CASE WHEN nest > 4 THEN 'deep_nesting' END, CASE WHEN params > 5 THEN 'many_parameters' END, CASE WHEN NOT docs THEN 'missing_docs' END], lambda x: x IS NOT NULL), ' ') AS flags FROM m")
def maintainability(spark, sf):
    c = [F.col(x) for x in ("cyc", "lines", "nest", "params", "docs")]
    m = _code(spark, sf).withColumn("mi", C.maintainability(c[0], c[1], c[4]))
    return m.select("page_id", F.round(C.complexity_score(*c), 6).alias("score"), "mi", C.complexity_class(c[0]).alias("complexity"), C.maintainability_class(F.col("mi")).alias("upkeep"), F.array_join(C.quality_flags(*c, F.lit(0.0)), " ").alias("flags"))


@query("K14", f"WITH {CODE_SQL}, h AS (SELECT page_id, unnest(list_filter([CASE WHEN cyc > 10 THEN 'complexity' END, CASE WHEN lines > 100 THEN 'length' END, CASE WHEN NOT docs THEN 'docs' END], lambda x: x IS NOT NULL)) AS hotspot FROM code) SELECT page_id, hotspot FROM h")
def quality_hotspots(spark, sf):
    hot = F.array_compact(F.array(F.when(F.col("cyc") > 10, "complexity"), F.when(F.col("lines") > 100, "length"), F.when(~F.col("docs"), "docs")))
    return _code(spark, sf).select("page_id", F.explode(hot).alias("hotspot"))


WORDS_SQL = "len(list_filter(['password','secret','token','auth','encrypt','permission','credential','hash'], lambda k: regexp_matches(lower(text), '\\b' || k || '\\b')))"


@query("K15 K16 K17 K18", f"WITH c AS (SELECT doc_id, {WORDS_SQL} AS n, regexp_matches(text, '\\b(try|catch|except|rescue)\\b|Result<|if err != nil') AS errors, regexp_matches(text, '@(require|login|permission|csrf|admin|authenticated)') AS decorated, greatest(0.0, least(1.0, CASE WHEN regexp_matches(lower(source), '^(main|app|index|server|run|start|handler|init)') THEN 0.5 ELSE 0 END + 0.5 / len(string_split(lang || '/' || source, '/')))) AS near FROM documents) SELECT doc_id, CAST(n AS INTEGER) AS n_keywords, errors, round(least(0.3, CASE WHEN n >= 3 THEN 0.10 WHEN n = 2 THEN 0.06 WHEN n = 1 THEN 0.02 ELSE 0 END + CASE WHEN errors THEN 0.03 ELSE 0 END + CASE WHEN decorated THEN 0.05 ELSE 0 END + near * 0.02)::DOUBLE, 6) AS boost FROM c")
def criticality_boost(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "source", "lang"))
    n, errors = F.size(C.security_keywords(F.col("text"))), C.handles_errors(F.col("text"))
    near = C.proximity(F.concat_ws("/", "lang", "source"), F.col("source"))
    return d.select("doc_id", n.alias("n_keywords"), errors.alias("errors"), F.round(C.criticality(n, errors, C.decorated(F.col("text")), near), 6).alias("boost"))


@query("K19 K20 K21", "WITH u AS (SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS callers FROM lineitem GROUP BY 1), b AS (SELECT p_partkey, least(0.2, CASE WHEN callers >= 40 THEN 0.10 WHEN callers >= 20 THEN 0.03 + (callers - 20) / 20 * 0.07 WHEN callers > 0 THEN callers / 20 * 0.03 ELSE 0 END + CASE WHEN p_name LIKE '\\_%' ESCAPE '\\' THEN 0 ELSE 0.03 END + CASE WHEN p_type = 'ECONOMY' THEN 0.03 ELSE 0 END + CASE WHEN p_size > 40 THEN 0.04 ELSE 0 END) AS boost, p_size FROM part LEFT JOIN (SELECT part, callers FROM u) ON part = p_partkey) SELECT p_partkey, round(coalesce(boost, 0)::DOUBLE, 6) AS boost, round(greatest(0, least(1, (0.3 + coalesce(boost, 0) + 0.1) / 1.2))::DOUBLE, 6) AS importance FROM b")
def usage_importance(spark, sf):
    callers = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("callers"))
    p = table(spark, sf, "part").join(callers, F.col("p_partkey") == F.col("l_partkey"), "left")
    boost = C.usage_boost(F.coalesce("callers", F.lit(0)), C.is_public(F.col("p_name")), F.col("p_type") == "ECONOMY", F.col("p_size") > 40, 20, 40)
    return p.select("p_partkey", F.round(boost, 6).alias("boost"), F.round(C.importance(F.lit(0.3), boost, F.lit(0.1)), 6).alias("importance"))


# scores and classifiers

AGE = f"floor(date_diff('second', created_at, TIMESTAMP '{AS_OF}') / 86400)"
SRC = "CASE provenance_source WHEN 'user_explicit' THEN 0.9 WHEN 'documentation' THEN 0.85 WHEN 'code_indexed' THEN 0.8 WHEN 'inferred' THEN 0.7 WHEN 'auto_classified' THEN 0.6 ELSE 0.5 END::DOUBLE"
SEEN = f"floor(date_diff('second', last_accessed, TIMESTAMP '{AS_OF}') / 86400)"


def _aged(spark, sf):
    return memories(spark, sf).withColumns({"conf": X.source_confidence(F.col("provenance_source")), "age": X.age_days(F.col("created_at"), as_of()), "seen": X.age_days(F.col("last_accessed"), as_of())})


@query("K22 K25", f"{MEM} SELECT id, round(greatest(0, least(1, {SRC} * 0.3 + CASE WHEN verified THEN 0.25 ELSE 0.1 END + CASE WHEN use_count >= 20 THEN 0.2 WHEN use_count >= 10 THEN 0.15 WHEN use_count >= 5 THEN 0.1 ELSE 0.05 END + CASE WHEN {SEEN} < 30 THEN least(0.15, CASE WHEN {AGE} < 30 THEN 0.15 WHEN {AGE} < 90 THEN 0.12 WHEN {AGE} < 180 THEN 0.08 ELSE 0.05 END + 0.05) ELSE CASE WHEN {AGE} < 30 THEN 0.15 WHEN {AGE} < 90 THEN 0.12 WHEN {AGE} < 180 THEN 0.08 ELSE 0.05 END END + 0.1))::DOUBLE, 6) AS trust FROM mem")
def trust_score(spark, sf):
    return _aged(spark, sf).select("id", F.round(X.trust(F.col("conf"), F.col("verified"), F.col("use_count"), F.col("age"), F.col("seen")), 6).alias("trust"))


@query("K23", f"{MEM} SELECT id, array_to_string(list_filter([CASE WHEN importance >= 0.8 THEN 'strong match' END, CASE WHEN verified THEN 'verified' END, CASE WHEN use_count >= 10 THEN 'used ' || use_count || ' times' END, 'created ' || CASE WHEN {AGE} < 1 THEN 'today' WHEN {AGE} < 7 THEN CAST({AGE} AS BIGINT) || ' days ago' WHEN {AGE} < 30 THEN CAST(floor({AGE} / 7) AS BIGINT) || ' weeks ago' ELSE CAST(floor({AGE} / 30) AS BIGINT) || ' months ago' END], lambda x: x IS NOT NULL), '; ') AS why FROM mem")
def trust_explanation(spark, sf):
    return _aged(spark, sf).select("id", F.array_join(X.explanation(F.col("verified"), F.col("use_count"), F.col("age"), F.col("importance")), "; ").alias("why"))


@query("K24", f"{MEM}, a AS (SELECT id, verified, use_count, {SEEN} AS seen, CASE WHEN {AGE} > 365 THEN {SRC} * 0.8 WHEN {AGE} > 180 THEN {SRC} * 0.9 ELSE {SRC} END AS c FROM mem), b AS (SELECT *, CASE WHEN verified THEN least(1.0, c + 0.15) ELSE c END AS d FROM a), e AS (SELECT *, CASE WHEN seen < 30 THEN least(1.0, d + 0.1) ELSE d END AS f FROM b) SELECT id, round(CASE WHEN use_count > 10 THEN least(1.0, f + 0.05) ELSE f END::DOUBLE, 6) AS confidence FROM e")
def provenance_confidence(spark, sf):
    return _aged(spark, sf).select("id", F.round(X.confidence(F.col("conf"), F.col("verified"), F.col("use_count"), F.col("age"), F.col("seen")), 6).alias("confidence"))


LEVEL_SQL = "least(1.0, (regexp_matches(lower(text), '\\bprefer')::INT + regexp_matches(lower(text), '\\balways\\b')::INT + regexp_matches(lower(text), '\\bnever\\b')::INT + regexp_matches(lower(text), '\\blike\\b')::INT) / 1.2) AS p, least(1.0, (regexp_matches(lower(text), '\\bproject\\b')::INT + regexp_matches(lower(text), '\\barchitecture\\b')::INT + regexp_matches(lower(text), '\\buses?\\b')::INT + regexp_matches(lower(text), '\\bdatabase\\b')::INT + regexp_matches(lower(text), '\\bthis\\b')::INT) / 1.5) AS c, least(1.0, (regexp_matches(lower(text), '\\bcurrent')::INT + regexp_matches(lower(text), '\\bnow\\b')::INT + regexp_matches(lower(text), '\\btoday\\b')::INT + regexp_matches(lower(text), '\\bworking\\b')::INT) / 1.2) AS s"


@query("K26 K27", f"WITH l AS (SELECT doc_id, {LEVEL_SQL} FROM documents) SELECT doc_id, CASE WHEN greatest(p, c, s) < 0.3 THEN 'PROJECT_CONTEXT' WHEN p >= c AND p >= s THEN 'USER_PREFERENCE' WHEN c >= s THEN 'PROJECT_CONTEXT' ELSE 'SESSION_STATE' END AS level, round(greatest(p, c, s)::DOUBLE, 6) AS best FROM l")
def context_classifier(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.level_scores(F.col("text")).alias("s"))
    return d.select("doc_id", X.classified_level(F.col("s")).alias("level"), F.round(F.array_max(F.map_values("s")), 6).alias("best"))


@query("K28", "WITH h AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '\\?')) + len(regexp_extract_all(lower(text), '\\b(how|what|why|where)\\b')) AS q, len(regexp_extract_all(lower(text), '\\b(error|exception|bug|fail)')) + len(regexp_extract_all(lower(text), '\\bnot work')) AS d FROM conversations) SELECT conv_id, turn, round(CASE WHEN d > 0 AND least(0.99, 0.8 + 0.1 * (d - 1)) >= CASE WHEN q > 0 THEN least(0.99, 0.7 + 0.1 * (q - 1)) ELSE 0 END THEN least(0.99, 0.8 + 0.1 * (d - 1)) ELSE least(0.99, 0.7 + 0.1 * (q - 1)) END::DOUBLE, 6) AS confidence FROM h WHERE q > 0 OR d > 0")
def pattern_detect(spark, sf):
    c = table(spark, sf, "conversations").withColumn("p", F.filter(X.detected_patterns(F.col("text")), lambda s: s["kind"].isin("question", "debugging")))
    return c.where(F.size("p") > 0).select("conv_id", "turn", F.round(F.col("p")[0]["confidence"], 6).alias("confidence"))


NAMES_SQL = r"list_concat(list_concat(regexp_extract_all(text, '\b[a-z]+_[a-z_]+\b'), regexp_extract_all(text, '\b[A-Z][a-z]+[A-Z][A-Za-z]*\b')), regexp_extract_all(text, '\b[a-z]+\(\)'))"


@query("K29", f"WITH n AS (SELECT doc_id, {NAMES_SQL} AS n FROM documents) SELECT doc_id, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i)[1:10], ' ') AS entities FROM n")
def entities(spark, sf):
    """Every document, whatever its characters."""
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.array_join(X.entities(F.col("text")), " ").alias("entities"))


@query("K30 M5", "WITH r AS (SELECT conv_id, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) <= 20), q AS (SELECT conv_id, list(text) AS t FROM r GROUP BY conv_id), s AS (SELECT conv_id, len(list_filter(t, lambda x: regexp_matches(lower(x), '\\b(error|bug|fix|fail|exception)\\b'))) / len(t) AS d, len(list_filter(t, lambda x: regexp_matches(lower(x), '\\b(how|what|explain|understand|que)\\b'))) / len(t) AS l, len(list_filter(t, lambda x: regexp_matches(lower(x), '\\b(add|create|implement|build)\\b'))) / len(t) AS i, len(list_filter(t, lambda x: regexp_matches(lower(x), '\\b(find|where|show|list|der)\\b'))) / len(t) AS e FROM q) SELECT conv_id, CASE WHEN greatest(d, l, i, e) = 0 THEN 'general' WHEN d = greatest(d, l, i, e) THEN 'debugging' WHEN l = greatest(d, l, i, e) THEN 'learning' WHEN i = greatest(d, l, i, e) THEN 'implementation' ELSE 'exploration' END AS intent, round(greatest(d, l, i, e), 6) AS confidence FROM s")
def intent_detection(spark, sf):
    """The intent of each conversation's last twenty questions."""
    q = last_of_each(table(spark, sf, "conversations").where("role = 'user'"), "conv_id", "turn", 20, "text").groupBy("conv_id").agg(F.collect_list("text").alias("t"))
    return q.select("conv_id", X.intent(F.col("t")).alias("i")).select("conv_id", "i.intent", F.round("i.confidence", 6).alias("confidence"))


@query("K31 K32 M6", f"{MEM} SELECT id, round(greatest(0, least(1, 0.5 * importance + 0.2 * CASE WHEN {SEEN} <= 7 THEN 1.0 WHEN {SEEN} <= 30 THEN 0.8 WHEN {SEEN} <= 90 THEN 0.5 WHEN {SEEN} <= 180 THEN 0.3 ELSE 0.1 END + 0.2 * importance + 0.1 * CASE WHEN verified THEN 1 ELSE 0 END))::DOUBLE, 6) AS confidence FROM mem")
def suggestion_confidence(spark, sf):
    m = _aged(spark, sf)
    return m.select("id", F.round(X.suggestion_confidence(F.col("importance"), X.stepped_recency(F.col("seen")), F.col("importance"), F.col("verified").cast("int")), 6).alias("confidence"))


@query("K33 K34", f"{MEM} SELECT id, round(CASE lifecycle_state WHEN 'ACTIVE' THEN 1.0 WHEN 'RECENT' THEN 0.7 WHEN 'ARCHIVED' THEN 0.3 ELSE 0.1 END * CASE WHEN project_name = 'src1' THEN 2.0 ELSE 0.3 END::DOUBLE, 6) AS weight FROM mem")
def search_weights(spark, sf):
    w = X.lookup(X.LIFECYCLE_WEIGHT, F.col("lifecycle_state"), 0.1) * F.when(F.col("project_name") == "src1", 2.0).otherwise(0.3)
    return memories(spark, sf).select("id", F.round(w, 6).alias("weight"))


@query("K36 K37", "SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s % 3600 // 60 || 'm' END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 50) AS BIGINT) AS s FROM orders)")
def human_time(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.human_time(F.floor(F.col("o_totalprice") / 50)).alias("shown"))


@query("K38", "SELECT doc_id, left(CASE WHEN length(regexp_extract(trim(text), '(?s)^(.*?[.!?])(\\s|$)', 1)) > 0 THEN regexp_extract(trim(text), '(?s)^(.*?[.!?])(\\s|$)', 1) ELSE trim(text) END, 200) AS summary FROM documents")
def text_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("K39 L19", "SELECT doc_id, sha256(text) || ':mini' AS key FROM documents")
def cache_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.cache_key(F.col("text"), "mini").alias("key"))


@query("A6 A7", "SELECT page_id, left(sha256('web:' || url || ':1:page'), 32) AS unit_id, length('File: ' || url || ':1-2' || chr(10) || 'Type: page' || chr(10) || 'Name: p' || chr(10) || 'Signature: ' || chr(10) || chr(10) || 'Content:' || chr(10) || html) AS n FROM pages")
def unit_ids(spark, sf):
    from strandline.operators.lifecycle import indexable_text, unit_id

    lit = F.lit
    n = F.length(indexable_text(F.col("url"), lit("1"), lit("2"), lit("page"), lit("p"), lit(""), F.col("html")))
    return table(spark, sf, "pages").select("page_id", unit_id(lit("web"), F.col("url"), lit(1), lit("page")).alias("unit_id"), n.cast("long").alias("n"))


@query("A11", "WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS module FROM pages) SELECT page_id, array_to_string(list_sort(list_distinct(list(module))), ' ') AS modules, count(*) AS n_imports FROM i GROUP BY page_id")
def import_metadata(spark, sf):
    i = table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("module"))
    return K.dependency_metadata(i).select(F.col("path").alias("page_id"), F.array_join("modules", " ").alias("modules"), "n_imports")


@query("A13", "WITH u AS (SELECT l_orderkey AS path, l_linenumber AS n, l_linenumber * 10 AS s, l_linenumber * 10 + 6 AS e FROM lineitem), d AS (SELECT o_orderkey AS path, 12 AS s, 14 AS e FROM orders) SELECT d.path, arg_min(u.n, u.s) AS unit FROM d LEFT JOIN u ON d.path = u.path AND d.s > u.s AND d.s <= u.e GROUP BY d.path")
def docstring_linkage(spark, sf):
    u = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("name"), (F.col("l_linenumber") * 10).alias("start_line"), (F.col("l_linenumber") * 10 + 6).alias("end_line"))
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.lit(0).alias("doc_id"), F.lit(12).alias("start"), F.lit(14).alias("end"), F.lit("python").alias("language"))
    return K.linked_docstrings(d, u).select("path", "unit")


@query("P5", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'typescript' END AS language FROM part")
def language_of_extension(spark, sf):
    name = F.concat("p_name", F.element_at(F.array(*[F.lit(x) for x in (".py", ".rs", ".tsx", ".txt")]), F.col("p_size") % 4 + 1))
    return table(spark, sf, "part").select("p_partkey", C.language_of(name).alias("language"))


@query("M1 M2 M3")
def hash_embedding(spark, sf):
    from strandline.functions.embedding import embed

    d = table(spark, sf, "documents").select("doc_id", embed(F.col("text")).alias("e"))
    return d.select("doc_id", F.round(F.aggregate(F.transform("e", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x), 3).alias("squared"))
