"""Code metrics as Column expressions over source text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.scores import clamp
from strandline.functions.text import ascii_bounds, hits

_C = [r"\bif\b", r"\belse if\b", r"\bfor\b", r"\bwhile\b", r"\bdo\b", r"\bcase\b", r"\bcatch\b", r"&&", r"\|\|", r"\?.*:"]
#: Decision points by language: fixed values that the complexity figures depend on.
DECISIONS = {
    "python": [r"\bif\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\band\b", r"\bor\b", r"\bexcept\b", r"\bcase\b"],
    "javascript": _C,
    "typescript": _C,
    "java": _C,
    "go": [r"\bif\b", r"\belse if\b", r"\bfor\b", r"\bselect\b", r"\bcase\b", r"&&", r"\|\|"],
    "rust": [r"\bif\b", r"\belse if\b", r"\bfor\b", r"\bwhile\b", r"\bloop\b", r"\bmatch\b", r"&&", r"\|\|"],
}
BRACES = ("javascript", "typescript", "java", "go", "rust")
INDENT = {"python": 4, "javascript": 2, "typescript": 2, "java": 4, "go": 1, "rust": 4}
MAX_CYCLOMATIC, MAX_LINES, MAX_NESTING, MAX_PARAMS = 20, 500, 5, 5
EXTENSIONS = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "sql": "sql", "php": "php", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml"}


def language_of(path: Column) -> Column:
    """The language of a file's extension, or null."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]


def _by_language(language: Column, values: dict[str, Column], default: str = "python") -> Column:
    out = None
    for name, value in values.items():
        out = F.when(F.lower(language) == name, value) if out is None else out.when(F.lower(language) == name, value)
    return out.otherwise(values[default])


def cyclomatic(content: Column, language: Column | None = None) -> Column:
    """1 and a point for each decision keyword, at most 40."""
    count = lambda name: sum((F.regexp_count(content, F.lit(ascii_bounds(p))) for p in DECISIONS[name]), F.lit(1))
    n = count("python") if language is None else _by_language(language, {k: count(k) for k in DECISIONS})
    return F.least(n, F.lit(2 * MAX_CYCLOMATIC))


def code_lines(content: Column) -> Column:
    """Lines that aren't blank and don't begin like a comment."""
    return F.size(F.filter(F.split(content, "\n"), lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s*(#|//|/\*|\*|\"\"\"|''')")))


def nesting(content: Column, language: Column | None = None) -> Column:
    """Deepest indentation in units of the language, with brace balance where it has braces; at most 10."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"\S"))

    def depth(unit: int, braces: bool) -> Column:
        def one(x: Column) -> Column:
            d = F.floor(F.length(F.regexp_extract(x, r"^(\s*)", 1)) / unit).cast("int")
            return d + F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}")) if braces else d

        return F.coalesce(F.array_max(F.transform(lines, one)), F.lit(0))

    d = depth(4, False) if language is None else _by_language(language, {k: depth(INDENT[k], k in BRACES) for k in DECISIONS})
    return F.least(F.greatest(d, F.lit(0)), F.lit(2 * MAX_NESTING))


def parameters(signature: Column) -> Column:
    """Comma-separated names in the first parentheses, without self, cls and this; at most 10."""
    inner = F.regexp_extract(signature, r"\(([^\n]*?)\)", 1)
    names = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & ~F.lower(x).isin("self", "cls", "this"))
    return F.least(F.size(names), F.lit(2 * MAX_PARAMS))


def documented(content: Column, language: Column | None = None) -> Column:
    """Whether a doc string or doc comment of over ten characters is there."""
    first = lambda p: F.length(F.regexp_extract(content, p, 0)) > 10
    python = first(r'(?s)""".*?"""') | first(r"(?s)'''.*?'''")
    if language is None:
        return python
    block, line = first(r"(?s)/\*\*.*?\*/"), first(r"//[^\n]*")
    return _by_language(language, {"python": python, "javascript": block | line, "typescript": block | line, "java": block, "go": line, "rust": first(r"//[/!][^\n]*")})


def complexity_score(cyc: Column, lines: Column, nest: Column, params: Column, docs: Column) -> Column:
    part = lambda x, most: F.least(x / most, F.lit(1.0))
    weighted = part(cyc, MAX_CYCLOMATIC) * 0.4 + part(lines, MAX_LINES) * 0.3 + part(nest, MAX_NESTING) * 0.2 + part(params, MAX_PARAMS) * 0.1
    return clamp(0.3 + weighted * 0.4 + F.when(docs, 0.05).otherwise(0.0), 0.3, 0.7)


def maintainability(cyc: Column, lines: Column, docs: Column) -> Column:
    base = (100 - 2 * cyc - lines / 10).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(95), base)) + F.when(docs, 5).otherwise(0)


def complexity_class(cyc: Column) -> Column:
    return F.when(cyc <= 5, "low").when(cyc <= 10, "medium").when(cyc <= 20, "high").otherwise("critical")


def maintainability_class(mi: Column) -> Column:
    return F.when(mi >= 85, "low").when(mi >= 65, "medium").when(mi >= 50, "high").otherwise("critical")


def quality_flags(cyc: Column, lines: Column, nest: Column, params: Column, docs: Column, duplication: Column) -> Column:
    return F.array_compact(F.array(F.when(cyc > 10, "high_complexity"), F.when(lines > 100, "long_function"), F.when(nest > 4, "deep_nesting"), F.when(params > 5, "many_parameters"), F.when(~docs, "missing_docs"), F.when(duplication >= 0.85, "duplicate")))


SECURITY = ["password", "secret", "token", "auth", "encrypt", "permission", "credential", "hash"]
DECORATORS = r"@(require|login|permission|csrf|admin|authenticated)"
ENTRY_NAMES = r"^(main|app|index|server|run|start|handler|init)"


def security_keywords(text: Column) -> Column:
    """Those of SECURITY that stand in the text as words. A pattern is compiled once, and sees only texts that hold its word."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(hits(low, rf"\b{k}\b"), k) for k in SECURITY]))


def decorated(text: Column) -> Column:
    return F.contains(text, F.lit("@")) & text.rlike(DECORATORS)


def handles_errors(text: Column) -> Column:
    words = [hits(text, rf"\b{k}\b") for k in ("try", "catch", "except", "rescue")]
    return reduce(or_, words, F.contains(text, F.lit("Result<")) | F.contains(text, F.lit("if err != nil")))


def proximity(path: Column, name: Column) -> Column:
    """1 for an entry point's name, less by depth of its path."""
    depth = F.size(F.split(path, "/"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.lower(name).rlike(ENTRY_NAMES), 0.5).otherwise(0.0) + 0.5 / depth))


def criticality(n_keywords: Column, errors: Column, decorated: Column, near: Column) -> Column:
    words = F.when(n_keywords >= 3, 0.10).when(n_keywords == 2, 0.06).when(n_keywords == 1, 0.02).otherwise(0.0)
    return F.least(F.lit(0.3), words + F.when(errors, 0.03).otherwise(0.0) + F.when(decorated, 0.05).otherwise(0.0) + near * 0.02)


def is_public(name: Column) -> Column:
    return ~name.startswith("_")


def usage_boost(callers: Column, public: Column, exported: Column, entry: Column, medium: int = 3, high: int = 10) -> Column:
    bands = F.when(callers >= high, 0.10).when(callers >= medium, 0.03 + (callers - medium) / (high - medium) * 0.07).when(callers > 0, callers / medium * 0.03).otherwise(0.0)
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.least(F.lit(0.2), bands + on(public, 0.03) + on(exported, 0.03) + on(entry, 0.04))


def importance(complexity: Column, used: Column, critical: Column, most: float = 1.2) -> Column:
    return clamp((complexity + used + critical) / most)
