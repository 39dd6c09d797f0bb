"""Queries over small source files, one set for each nation: imports, documentation comments, units, import graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import graph as R
from strandline.plans.registry import query
from strandline.sources import code as K
from strandline.sources import statements as S
from strandline.sources.tables import table

#: path, language and content of the files. @ stands for the nation's key.
FILES = [
    ("app.py", "python", '"""Module text."""\nimport os, sys as system\nfrom ..pkg import (\n    one,\n    two as zwei,\n)\nfrom . import util@\n\n\nclass App:\n    """Runs\n    things."""\n\n    def go(self):\n        return os\n'),
    ("broken.py", "python", "import json as j\nfrom a.b import c, d as e\ndef f(:\n"),
    ("ui.ts", "typescript", "import React, { useState as s, Fragment } from 'react';\nimport * as path from \"./path@\";\n// import x from 'commented';\nimport './style.css';\nconst fs = require('fs');\n/** Loads\n * lazily. */\nfunction lazy() {\n  return import('./lazy');\n}\n"),
    ("Main.java", "java", "package p;\nimport java.util.List;\nimport static java.lang.Math.*;\n/** Entry. */\npublic class Main {\n  public static void main(String a) {\n  }\n}\n"),
    ("main.go", "go", 'package main\n\nimport "fmt"\nimport (\n\tio "io/ioutil"\n\t"net/http"\n)\n\n// Run starts\n// it.\nfunc Run(x int) int {\n\treturn x\n}\n'),
    ("lib.rs", "rust", "use std::collections::{HashMap, HashSet as Set};\npub use crate::core::Thing@;\nmod inner;\nuse super::all::*;\n/// Adds.\npub fn add(a: i32) -> i32 {\n    a\n}\n"),
    ("t.rb", "ruby", "module Shop\n  class Cart\n    def total\n      1\n    end\n  end\nend\n"),
    ("t.c", "c", "#include <x.h>\nstruct point {\n  int x;\n};\nstatic int area(int w, int h) {\n  if (w) {\n    return w * h;\n  }\n  return 0;\n}\n"),
    ("t.cpp", "cpp", "class Box {\n  int n;\n};\nint Box::size(int k) const {\n  return n;\n}\n"),
    ("t.cs", "csharp", "public class Svc {\n  public int Get(int id) {\n    return id;\n  }\n}\n"),
    ("t.sql", "sql", "CREATE TABLE items (\n  id int\n);\ncreate or replace function total() returns int as $$ select 1 $$;\n"),
    ("t.php", "php", "<?php\nclass Page {\n  function show() {\n    return 1;\n  }\n}\n"),
    ("t.yaml", "yaml", "name: x\nsteps:\n  - run: a\n  - run: b\n# end\nlast-key: 1\n"),
]

#: path, module, items, type, line, relative, alias
IMPORTS = [
    ("app.py", "os", "", "import", 2, False, None), ("app.py", "sys", "", "import", 2, False, "system"), ("app.py", "..pkg", "one two", "from_import", 3, True, None), ("app.py", ".", "util@", "from_import", 7, True, None),
    ("broken.py", "json", "", "import", 1, False, "j"), ("broken.py", "a.b", "c d", "from_import", 2, False, None),
    ("ui.ts", "react", "React useState Fragment", "import", 1, False, None), ("ui.ts", "./path@", "*", "import", 2, True, None), ("ui.ts", "./style.css", "", "import", 4, True, None), ("ui.ts", "fs", "", "require", 5, False, None), ("ui.ts", "./lazy", "", "dynamic_import", 9, True, None),
    ("Main.java", "java.util", "List", "import", 2, False, None), ("Main.java", "java.lang.Math", "*", "import", 3, False, None),
    ("main.go", "fmt", "", "import", 3, False, None), ("main.go", "io/ioutil", "", "import", 5, False, "io"), ("main.go", "net/http", "", "import", 6, False, None),
    ("lib.rs", "std::collections", "HashMap HashSet", "use", 1, False, None), ("lib.rs", "crate::core::Thing@", "Thing@", "use", 2, True, None), ("lib.rs", "inner", "", "mod", 3, True, None), ("lib.rs", "super::all", "*", "use", 4, True, None),
]
#: path, style, start, end, content, the unit that it documents
DOCS = [
    ("app.py", "python", 1, 1, "Module text.", None), ("app.py", "python", 11, 12, "Runs\n    things.", "App"),
    ("ui.ts", "jsdoc", 6, 7, "Loads\nlazily.", "lazy"), ("Main.java", "javadoc", 4, 4, "Entry.", "Main"), ("main.go", "godoc", 9, 10, "Run starts\nit.", "Run"), ("lib.rs", "rustdoc", 5, 5, "Adds.", "add"),
]
#: path, unit type, name, start, end
UNITS = [
    ("app.py", "class", "App", 10, 15), ("app.py", "function", "go", 14, 15), ("ui.ts", "function", "lazy", 8, 10), ("Main.java", "class", "Main", 5, 8), ("Main.java", "function", "main", 6, 7), ("main.go", "function", "Run", 11, 13), ("lib.rs", "function", "add", 6, 8),
    ("t.rb", "class", "Shop", 1, 7), ("t.rb", "class", "Cart", 2, 6), ("t.rb", "function", "total", 3, 5), ("t.c", "class", "point", 2, 4), ("t.c", "function", "area", 5, 10), ("t.cpp", "class", "Box", 1, 3), ("t.cpp", "function", "Box::size", 4, 6),
    ("t.cs", "class", "Svc", 1, 5), ("t.cs", "function", "Get", 2, 4), ("t.sql", "class", "items", 1, 3), ("t.sql", "function", "total", 4, 4), ("t.php", "class", "Page", 2, 6), ("t.php", "function", "show", 3, 5),
    ("t.yaml", "config", "name", 1, 1), ("t.yaml", "config", "steps", 2, 5), ("t.yaml", "config", "last-key", 6, 6),
]


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    return ("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'") if isinstance(x, str) else str(x).lower()


def _sql(rows: list[tuple], columns: str) -> str:
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(VALUES {values}) AS v({columns})"


def _files(spark, sf):
    """path, language and content, a set of files for each nation."""
    files = spark.createDataFrame(FILES, "path string, language string, content string")
    key = F.col("n_nationkey").cast("string")
    return table(spark, sf, "nation").select(key.alias("k")).crossJoin(F.broadcast(files)).select(F.concat("k", F.lit("/"), "path").alias("path"), "language", F.replace("content", F.lit("@"), F.col("k")).alias("content"))


_PATH = "n_nationkey || '/' || path AS path"


def _at(column: str) -> str:
    return f"replace({column}, '@', CAST(n_nationkey AS VARCHAR)) AS {column}"


@query("A10 A15 P4", f"SELECT {_PATH}, {_at('module')}, {_at('items')}, type, CAST(line AS INTEGER) AS line, relative, alias FROM nation, {_sql(IMPORTS, 'path, module, items, type, line, relative, alias')}")
def import_statements(spark, sf):
    return S.import_details(_files(spark, sf)).select("path", "module", F.array_join("items", " ").alias("items"), "type", "line", "relative", "alias")


@query("A12 A13", f"SELECT {_PATH}, style, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", content, unit FROM nation, {_sql(DOCS, 'path, style, s, e, content, unit')}")
def docstring_extraction(spark, sf):
    """Documentation comments with the units they document."""
    files = _files(spark, sf)
    found = S.doc_comments(files)
    linked = K.linked_docstrings(found, K.code_units(files)).withColumnsRenamed({"path": "of", "doc_id": "of_id"})
    return found.join(linked, (F.col("path") == F.col("of")) & (F.col("doc_id") == F.col("of_id"))).select("path", "style", "start", "end", "content", "unit")


@query("P3 P4 P6 A3", f"SELECT {_PATH}, unit_type, name, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line FROM nation, {_sql(UNITS, 'path, unit_type, name, s, e')}")
def units_by_language(spark, sf):
    return K.code_units(_files(spark, sf)).select("path", "unit_type", "name", "start_line", "end_line")


@query("I8 I1 E46", f"""WITH e AS (SELECT DISTINCT {_PATH}, {_at('module')} FROM nation, {_sql(IMPORTS, 'path, module, items, type, line, relative, alias')}), o AS (SELECT path AS node, count(*) AS n FROM e GROUP BY 1), i AS (SELECT module AS node, count(*) AS n FROM e GROUP BY 1),
a AS (SELECT path AS node FROM e UNION SELECT module FROM e), d AS (SELECT node, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM a LEFT JOIN o USING (node) LEFT JOIN i USING (node)),
f AS (SELECT count(*) AS n_nodes, (SELECT count(*) FROM e) AS n_edges FROM a) SELECT 'all' AS figure, NULL AS node, n_nodes AS n, round(n_edges / n_nodes, 6) AS mean FROM f
UNION ALL (SELECT 'outgoing', node, outgoing, NULL FROM d ORDER BY outgoing DESC, node LIMIT 5) UNION ALL (SELECT 'incoming', node, incoming, NULL FROM d ORDER BY incoming DESC, node LIMIT 5)""")
def import_graph_statistics(spark, sf):
    """The graph of stored imports: nodes, mean degree, and the five nodes of most edges in each direction."""
    edges = S.import_details(_files(spark, sf)).select(F.col("path").alias("src"), F.col("module").alias("dst")).distinct()
    return R.statistics(edges, 5)
