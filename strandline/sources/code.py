"""Sources of code: files, units, imports, doc strings, ignore patterns, configuration keys."""

from __future__ import annotations

import ast
import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from strandline.functions.code import language_of

UNIT = ArrayType(StructType([StructField(n, IntegerType() if n.endswith("_line") else StringType()) for n in ("unit_type", "name", "signature", "start_line", "end_line", "content")]))
#: Starts of functions and classes in languages with braces: (unit type, pattern), the name in group 1.
_BRACE_UNITS = [
    ("function", re.compile(r"^\s*(?:export\s+)?(?:pub\s+)?(?:async\s+)?(?:func|fn|function)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", re.M)),
    ("function", re.compile(r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+([A-Za-z_]\w*)\s*\(", re.M)),
    ("class", re.compile(r"^\s*(?:export\s+)?(?:pub\s+)?(?:public\s+)?(?:class|struct|interface|enum|trait)\s+([A-Za-z_]\w*)", re.M)),
]
#: A definition of C or C++: a type, a name, parameters and an opening brace; what looks like one but isn't.
_C_FUNCTION = re.compile(r"^(?!\s*(?:else|return|typedef|#))[A-Za-z_][\w:<>,*&~ \t]*?[\s*&]([A-Za-z_~][\w:~]*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{", re.M)
_SQL_OBJECT = re.compile(r"^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(table|view|function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)", re.M | re.I)
_RUBY_UNIT = re.compile(r"^([ \t]*)(def|class|module)[ \t]+([\w.:?!=]+)", re.M)
_YAML_KEY = re.compile(r"^([A-Za-z_][\w .-]*?)[ \t]*:(?=\s|$)", re.M)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modified, content and language of the text files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"), language_of(F.col("path")).alias("language"))


def parse_units(source: str, language: str) -> list[dict]:
    """Functions and classes of a source text; a text that doesn't parse has none."""
    lines = source.split("\n")
    if language == "python":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        out = []
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                out.append({"unit_type": kind, "name": node.name, "signature": lines[node.lineno - 1].strip(), "start_line": node.lineno, "end_line": node.end_lineno, "content": "\n".join(lines[node.lineno - 1 : node.end_lineno])})
        return sorted(out, key=lambda u: u["start_line"])
    if language in ("json", "toml"):
        try:
            keys = list((json.loads if language == "json" else tomllib.loads)(source))
        except (ValueError, TypeError):
            return []
        at = {k: next((i + 1 for i, x in enumerate(lines) if re.search(rf"[\"\[]?{re.escape(str(k))}[\"\]]?\s*[:=\]]", x)), 1) for k in keys}
        return [{"unit_type": "config", "name": str(k), "signature": str(k), "start_line": at[k], "end_line": at[k], "content": lines[at[k] - 1]} for k in keys]
    out = []
    unit = lambda kind, name, start, end: {"unit_type": kind, "name": name, "signature": lines[start - 1].strip(), "start_line": start, "end_line": end, "content": "\n".join(lines[start - 1 : end])}
    at_line = lambda at: source.count("\n", 0, at) + 1
    if language == "yaml":
        found = [(m[1], at_line(m.start())) for m in _YAML_KEY.finditer(source)]
        last = max((i for i, x in enumerate(lines, start=1) if x.strip()), default=0)
        return [unit("config", name, start, (found[i + 1][1] - 1 if i + 1 < len(found) else last)) for i, (name, start) in enumerate(found)]
    if language == "ruby":
        for m in _RUBY_UNIT.finditer(source):
            start = at_line(m.start(2))
            end = next((i for i in range(start + 1, len(lines) + 1) if re.match(rf"{m[1]}end\b", lines[i - 1])), start)
            out.append(unit("function" if m[2] == "def" else "class", m[3], start, end))
        return out
    if language == "sql":
        for m in _SQL_OBJECT.finditer(source):
            stop = source.find(";", m.end())
            out.append(unit("function" if m[1].lower() in ("function", "procedure", "trigger") else "class", m[2], at_line(m.start(1)), at_line(stop if stop >= 0 else len(source))))
        return out
    patterns = [*_BRACE_UNITS[1:], ("function", _C_FUNCTION)] if language in ("c", "cpp") else _BRACE_UNITS
    for kind, pattern in patterns:
        for m in pattern.finditer(source):
            if m[1] in ("if", "for", "while", "switch", "catch"):
                continue
            start = source.count("\n", 0, m.start(1)) + 1
            depth, end, seen = 0, start, False
            for end in range(start, len(lines) + 1):
                depth += lines[end - 1].count("{") - lines[end - 1].count("}")
                seen |= "{" in lines[end - 1]
                if seen and depth <= 0:
                    break
            out.append({"unit_type": kind, "name": m[1], "signature": lines[start - 1].strip(), "start_line": start, "end_line": end, "content": "\n".join(lines[start - 1 : end])})
    return sorted(out, key=lambda u: (u["start_line"], u["name"]))


@F.pandas_udf(UNIT)
def units(content: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([parse_units(c or "", x or "") for c, x in zip(content, language, strict=True)])


def code_units(files: DataFrame) -> DataFrame:
    """A row for each unit of each file."""
    return files.withColumn("unit", F.explode(units("content", "language"))).select("path", "language", "unit.*")


def dependency_metadata(found: DataFrame) -> DataFrame:
    """path, modules (sorted, distinct), n_imports."""
    return found.groupBy("path").agg(F.sort_array(F.collect_set("module")).alias("modules"), F.count(F.lit(1)).alias("n_imports"))


def import_candidates(source: Column, module: Column) -> Column:
    """Paths that a relative module may mean, in the order they are tried."""
    folder = F.regexp_replace(source, r"/[^/]*$", "")
    base = F.concat(folder, F.lit("/"), F.regexp_replace(F.regexp_replace(module, r"^\./", ""), r"^\.+", ""))
    return F.array(*[F.concat(base, F.lit(x)) for x in (".py", ".js", ".ts", ".jsx", ".tsx", "/__init__.py", "/index.js", "/index.ts")])


def linked_docstrings(docs: DataFrame, code: DataFrame) -> DataFrame:
    """doc (path, doc_id, start, end) with the unit it documents, or null.

    In Python the first unit that holds the doc's start; elsewhere the first that starts within five
    lines behind its end. Both join on the path and compare lines within it.
    """
    near = F.when(F.col("d.language") == "python", (F.col("d.start") > F.col("u.start_line")) & (F.col("d.start") <= F.col("u.end_line"))).otherwise(F.col("u.start_line").between(F.col("d.end"), F.col("d.end") + 5))
    both = docs.alias("d").join(code.alias("u"), (F.col("d.path") == F.col("u.path")) & near, "left")
    return both.groupBy("d.path", "d.doc_id").agg(F.min(F.struct("u.start_line", "u.name")).alias("first")).select("path", "doc_id", F.col("first.name").alias("unit"))


def ignore_regex(pattern: str) -> str:
    """A regex for a gitignore-style pattern."""
    p = pattern.strip()
    anchored, folder = p.startswith("/"), p.endswith("/")
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p.strip("/").replace("**", "\0")).replace(re.escape("\0"), ".*").replace("\0", ".*")
    return ("^" if anchored else "(^|/)") + body + ("/" if folder else "($|/)")


def not_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether no pattern matches; blank lines, comments and negations are passed over."""
    used = [ignore_regex(p) for p in patterns if p.strip() and not p.startswith(("#", "!"))]
    return ~path.rlike("|".join(used)) if used else F.lit(True)


def merged_patterns(old: list[str], new: list[str]) -> list[str]:
    """Both lists' patterns, sorted, without those that a folder pattern of the lists covers."""
    every = sorted(set(old) | set(new))
    return [p for p in every if not any(q != p and q.endswith("/") and p.startswith(q) for q in every)]
