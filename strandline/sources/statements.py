"""What source texts declare: import statements and documentation comments, by language.

Python is parsed by its own grammar where it parses; the other languages, and Python that doesn't, are read by
patterns of their statements. Languages without rules have none.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

_TYPES = {"line": IntegerType(), "start_line": IntegerType(), "end_line": IntegerType(), "relative": BooleanType(), "items": ArrayType(StringType())}


def _rows_of(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, _TYPES.get(n, StringType())) for n in names]))


IMPORT_TYPE = _rows_of("module", "items", "type", "line", "relative", "alias", "statement")
DOC_TYPE = _rows_of("content", "style", "start_line", "end_line")
Import = dict[str, object]


def _line(source: str, at: int) -> int:
    return source.count("\n", 0, at) + 1


def _names(listed: str) -> list[str]:
    """The names of a comma-separated list, without what they are renamed to."""
    return [name for part in listed.replace("\n", " ").split(",") if (name := part.split(" as ")[0].strip(" \t()"))]


def _entry(source: str, at: int, statement: str, module: str, kind: str, items: list[str] | None = None, alias: str | None = None, relative: bool | None = None) -> Import:
    return {"module": module, "items": items or [], "type": kind, "line": _line(source, at), "relative": module.startswith(".") if relative is None else relative, "alias": alias, "statement": statement.strip()}


def _python(source: str) -> Iterator[Import]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        for m in re.finditer(r"^[ \t]*(?:import[ \t]+(?P<m>[\w.]+)(?:[ \t]+as[ \t]+(?P<a>\w+))?|from[ \t]+(?P<f>[\w.]+)[ \t]+import[ \t]+(?P<i>[^\n#]+))", source, re.M):
            yield _entry(source, m.start(m.lastgroup), m[0], m["m"] or m["f"], "import" if m["m"] else "from_import", _names(m["i"] or ""), m["a"])
        return
    lines = source.split("\n")
    for node in sorted((n for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom)), key=lambda n: (n.lineno, n.col_offset)):
        base = {"line": node.lineno, "statement": "\n".join(lines[node.lineno - 1 : node.end_lineno]).strip()}
        if isinstance(node, ast.Import):
            for name in node.names:
                yield base | {"module": name.name, "items": [], "type": "import", "relative": False, "alias": name.asname}
        else:
            yield base | {"module": "." * node.level + (node.module or ""), "items": [n.name for n in node.names], "type": "from_import", "relative": node.level > 0, "alias": None}


def _uncommented(source: str, line_mark: str) -> str:
    """The source with comments blanked out, line for line."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(rf"^[ \t]*{line_mark}[^\n]*", blank, re.sub(r"/\*.*?\*/", blank, source, flags=re.S), flags=re.M)


def _javascript(source: str) -> Iterator[Import]:
    code = _uncommented(source, "//")
    for m in re.finditer(r"^[ \t]*import\s+(?:type\s+)?(?:(?P<what>[^'\"();]+?)\s+from\s+)?(['\"])(?P<m>[^'\"]+)\2", code, re.M):
        what, items = (m["what"] or "").strip(), []
        if "{" in what:
            items = _names(what[what.index("{") + 1 : what.rindex("}")])
        if first := what.split("{")[0].strip(" ,\n\t"):
            items = (["*"] if first.startswith("*") else [first]) + items
        yield _entry(code, m.start(), m[0], m["m"], "import", items)
    for m in re.finditer(r"(?:const|let|var)\s[^=\n]*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", code):
        yield _entry(code, m.start(), m[0], m[1], "require")
    for m in re.finditer(r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)", code):
        yield _entry(code, m.start(), m[0], m[1], "dynamic_import")


def _java(source: str) -> Iterator[Import]:
    for m in re.finditer(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]*?)\.?(\w+|\*)[ \t]*;", _uncommented(source, "//"), re.M):
        yield _entry(source, m.start(), m[0], m[1], "import", [m[2]], relative=False)


def _go(source: str) -> Iterator[Import]:
    code = _uncommented(source, "//")
    path = r"(?:([\w.]+)[ \t]+)?\"([^\"\n]+)\""
    for m in re.finditer(rf"^[ \t]*import[ \t]+{path}", code, re.M):
        yield _entry(code, m.start(2), m[0], m[2], "import", alias=m[1])
    for block in re.finditer(r"^[ \t]*import\s*\(([^)]*)\)", code, re.M):
        for m in re.finditer(path, block[1]):
            yield _entry(code, block.start(1) + m.start(2), m[0], m[2], "import", alias=m[1])


def _rust(source: str) -> Iterator[Import]:
    code = _uncommented(source, "//")
    for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<path>[\w:]+?)(?:::\{(?P<list>[^}]*)\}|::(?P<all>\*))?(?:\s+as\s+(?P<alias>\w+))?\s*;", code, re.M):
        path = m["path"]
        items = _names(m["list"]) if m["list"] is not None else ["*"] if m["all"] else [path.split("::")[-1]]
        yield _entry(code, m.start("path"), m[0], path, "use", items, m["alias"], path.split("::")[0] in ("crate", "super", "self"))
    for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", code, re.M):
        yield _entry(code, m.start(1), m[0], m[1], "mod", relative=True)


READERS = {"python": _python, "javascript": _javascript, "typescript": _javascript, "java": _java, "go": _go, "rust": _rust}


def parse_imports(source: str, language: str) -> list[Import]:
    """module, items, type, line, relative, alias and statement of each import, by line."""
    reader = READERS.get(language.lower())
    return sorted(reader(source), key=lambda x: x["line"]) if reader else []


@F.pandas_udf(IMPORT_TYPE)
def imports(content: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([parse_imports(c or "", x or "") for c, x in zip(content, language, strict=True)])


def import_details(files: DataFrame) -> DataFrame:
    """path and what parse_imports() says, a row an import."""
    return files.select("path", F.explode(imports("content", "language")).alias("i")).select("path", "i.*")


def _commented_lines(source: str, marks: tuple[str, ...]) -> Iterator[tuple[int, int, list[str]]]:
    """First line, last line and texts of runs of lines that begin with the same mark."""
    run: list[str] = []
    mark, first = "", 0
    for n, line in enumerate([*source.split("\n"), ""], start=1):
        bare = line.strip()
        now = next((x for x in marks if bare.startswith(x)), "")
        if run and now != mark:
            yield first, n - 1, run
            run = []
        if now:
            first = first if run else n
            mark = now
            run.append(bare[len(now) :].strip())


def parse_docs(source: str, language: str) -> list[dict]:
    """content, style, start_line and end_line of documentation comments: triple-quoted strings that begin a line, /** blocks, // runs, /// runs."""
    language, out = language.lower(), []
    if language == "python":
        for m in re.finditer(r"^[ \t]*(\"\"\"|''')(.*?)\1", source, re.M | re.S):
            out.append((m[2].strip(), "python", _line(source, m.start(1)), _line(source, m.end())))
    elif language in ("javascript", "typescript", "java"):
        for m in re.finditer(r"/\*\*(.*?)\*/", source, re.S):
            lines = [x.strip().removeprefix("*").strip() for x in m[1].split("\n")]
            out.append(("\n".join(filter(None, lines)), "javadoc" if language == "java" else "jsdoc", _line(source, m.start()), _line(source, m.end())))
    elif language in ("go", "rust"):
        for first, last, texts in _commented_lines(source, ("//",) if language == "go" else ("///", "//!")):
            out.append(("\n".join(filter(None, texts)), f"{language}doc", first, last))
    return [dict(zip(("content", "style", "start_line", "end_line"), x, strict=True)) for x in out if x[0]]


@F.pandas_udf(DOC_TYPE)
def docs(content: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([parse_docs(c or "", x or "") for c, x in zip(content, language, strict=True)])


def doc_comments(files: DataFrame) -> DataFrame:
    """path, language, doc_id (its place in the file), content, style, start and end, a row a documentation comment."""
    found = files.select("path", "language", F.posexplode(docs("content", "language")).alias("doc_id", "d"))
    return found.select("path", "language", "doc_id", "d.content", "d.style", F.col("d.start_line").alias("start"), F.col("d.end_line").alias("end"))
