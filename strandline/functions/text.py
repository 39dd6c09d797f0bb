"""Text functions as Column expressions: tokens, terms, patterns, clean-up."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9_]+"


#: A word boundary that knows ASCII word characters only, like \b of RE2; Java's own also looks at other letters.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_bounds(pattern: str) -> str:
    return pattern.replace(r"\b", BOUNDARY)


def literal_in(pattern: str) -> str:
    """The longest plain word that every match of a pattern holds, or ''."""
    if "|" in pattern or "(?i)" in pattern:
        return ""
    found = [m[1] for m in re.finditer(r"(?<![\\\[\w])([a-z]{2,}?)(?=$|[^a-z?*]|[a-z][?*])", re.sub(r"\\[a-zA-Z]", " ", pattern))]
    return max(found, key=len, default="")


def hits(text: Column, pattern: str) -> Column:
    """text.rlike(pattern) with ASCII word boundaries, after a cheap search for its literal."""
    literal, found = literal_in(pattern), text.rlike(ascii_bounds(pattern))
    return F.contains(text, F.lit(literal)) & found if literal else found


def tokens(text: Column) -> Column:
    """Lower-case ASCII tokens of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)


def query_tokens(text: str) -> list[str]:
    return [t for t in re.findall(TOKEN, text.lower()) if len(t) >= 2]


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


#: The search surface's regex presets, by name.
PRESETS = {
    "error_handlers": r"(try|catch|except|rescue)\s*[:\{]",
    "bare_except": r"except\s*:",
    "broad_catch": r"catch\s*\(\s*Exception",
    "empty_catch": r"catch\s*\([^)]+\)\s*\{\s*\}",
    "TODO_comments": r"(TODO|FIXME|HACK|XXX|NOTE)[:|\s]",
    "deprecated_markers": r"@deprecated|@Deprecated|DEPRECATED",
    "security_keywords": r"(password|secret|token|api[_-]?key|private[_-]?key)",
    "auth_patterns": r"(authenticate|authorize|permission|access[_-]?control)",
    "deprecated_apis": r"(deprecated\(|@Deprecated|__deprecated__|OBSOLETE)",
    "async_patterns": r"(async\s+def|await\s+|Promise\.|async\s+function)",
    "magic_numbers": r"\b\d{3,}\b",
    "long_lines": r"^.{120,}$",
    "multiple_returns": r"return\s+.*\n.*return\s+",
    "config_keys": r"(config\.|env\[|process\.env\.|getenv\()",
    "hardcoded_urls": r"https?://[^\s\"']+",
}
#: Patterns see whole texts: ^ and $ at each \n, and . also for line ends.
FLAGS = "(?dms)"


def preset(pattern: str) -> str:
    """A pattern, or the preset that '@preset:name' names, with FLAGS and ASCII word boundaries."""
    if not pattern.startswith("@preset:"):
        re.compile(pattern)
        return FLAGS + ascii_bounds(pattern)
    name = pattern.removeprefix("@preset:")
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    return FLAGS + ascii_bounds(PRESETS[name])


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(preset(pattern))


def find_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(preset(pattern)), F.lit(0))


def match_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(preset(pattern)))


def match_lines(text: Column, pattern: str) -> Column:
    """array<struct<line, column, match>>: the first match of each line that has one, from 1."""
    p = F.lit(preset(pattern))
    lines = F.split(text, "\n")
    found = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.regexp_instr(x, p).alias("column"), F.regexp_substr(x, p).alias("match")))
    return F.filter(found, lambda s: s["column"] > 0)


def pattern_score(text: Column, pattern: str) -> Column:
    """0.5 for a match, more for many, for one in the first two lines and for density; at most 1."""
    n = match_count(text, pattern)
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 2), "\n")
    density = n / F.greatest(F.size(F.split(text, "\n")), F.lit(1))
    score = 0.5 + F.least(F.lit(0.2), 0.05 * n) + F.when(head.rlike(preset(pattern)), 0.2).otherwise(0.0) + F.least(F.lit(0.1), density * 10)
    return F.when(n > 0, F.least(F.lit(1.0), score)).otherwise(F.lit(0.0))


#: Families of injection patterns, tried in order; the first that matches names the risk.
INJECTIONS = {
    "sql": r"(?i)(union\s+select|drop\s+table|or\s+1\s*=\s*1)",
    "prompt": r"(?i)(ignore\s+(all\s+)?previous|system\s+prompt)",
    "command": r"(;\s*rm\s|\$\(|&&\s*curl)",
    "path": r"(\.\./|/etc/passwd)",
}


def injection(text: Column) -> Column:
    """The first family of injection patterns that a text matches, or null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in INJECTIONS.items()])


def sanitized(text: Column, max_length: int | None = None) -> Column:
    """Without control characters but tab and line ends, cut to a length, trimmed."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.trim(F.substring(clean, 1, max_length) if max_length else clean)


STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "not", "you", "have", "has", "had", "but", "all", "can", "will", "what", "how", "where", "when"]


def key_terms(text: Column, min_length: int = 3) -> Column:
    """Sorted distinct lower-case terms without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))
    long = F.filter(words, lambda w: F.length(w) >= min_length)
    return F.array_sort(F.array_except(F.array_distinct(long), F.array(*[F.lit(w) for w in STOP_WORDS])))


#: Expansion dictionaries of our own, of the shape term -> terms.
SYNONYMS = {
    "auth": ["authentication", "authorization", "login"],
    "bug": ["defect", "error", "fault"],
    "config": ["configuration", "options", "settings"],
    "db": ["database", "storage", "store"],
    "delete": ["drop", "erase", "remove"],
    "error": ["exception", "failure", "fault"],
    "fetch": ["get", "load", "retrieve"],
    "function": ["callable", "method", "procedure"],
    "test": ["check", "spec", "verify"],
    "user": ["account", "member", "person"],
}
CODE_CONTEXT = {
    "auth": ["credential", "jwt", "password", "session", "token"],
    "db": ["connection", "query", "schema", "sql", "transaction"],
    "api": ["endpoint", "request", "response", "rest", "route"],
    "test": ["assert", "fixture", "mock"],
    "error": ["catch", "raise", "retry", "traceback", "try"],
}


def expanded(query: str, dictionary: dict[str, list[str]], per_term: int) -> str:
    """The query with up to per_term sorted related terms for each of its words, none twice."""
    words = query.split()
    have, extra = {w.lower() for w in words}, []
    for w in list(dict.fromkeys(x.lower() for x in words)):
        new = [t for t in sorted(dictionary.get(w, [])) if t not in have][:per_term]
        have.update(new)
        extra += new
    return " ".join([*words, *extra])


def expanded_full(query: str, synonyms: int = 2, context: int = 3) -> str:
    return expanded(expanded(query, SYNONYMS, synonyms), CODE_CONTEXT, context)


def _bound(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def expanded_column(text: Column, dictionary: dict[str, list[str]], per_term: int) -> Column:
    """The same for a column of queries."""
    table = F.create_map(*[c for k in sorted(dictionary) for c in (F.lit(k), F.array(*[F.lit(t) for t in sorted(dictionary[k])]))])

    def related(words: Column) -> Column:
        new = lambda w: F.slice(F.array_except(F.coalesce(table[w], F.array().cast("array<string>")), words), 1, per_term)
        return F.array_distinct(F.flatten(F.transform(F.array_distinct(words), new)))

    whole = lambda t: F.array_join(F.concat(F.split(t, r"\s+"), _bound(F.split(F.lower(t), r"\s+"), related)), " ")
    return _bound(F.regexp_replace(text, r"^\s+|\s+$", ""), whole)


def expanded_full_column(text: Column, synonyms: int = 2, context: int = 3) -> Column:
    return expanded_column(expanded_column(text, SYNONYMS, synonyms), CODE_CONTEXT, context)


TYPOS = {"fucntion": "function", "retrun": "return", "authentcation": "authentication", "databse": "database", "conifg": "config", "improt": "import"}


def spelling_candidates(term: Column, vocabulary: list[str], max_distance: int = 2, limit: int = 3) -> Column:
    """Nearest vocabulary words within an edit distance, by distance and then alphabet; typos first."""
    known = F.create_map(*[F.lit(x) for kv in sorted(TYPOS.items()) for x in kv])
    near = F.filter(F.array(*[F.struct(F.levenshtein(term, F.lit(v)).alias("d"), F.lit(v).alias("w")) for v in vocabulary]), lambda s: (s["d"] <= max_distance) & (s["d"] > 0))
    words = F.transform(F.array_sort(near), lambda s: s["w"])
    return F.slice(F.array_distinct(F.concat(F.when(known[term].isNotNull(), F.array(known[term])).otherwise(F.array().cast("array<string>")), words)), 1, limit)


def summary(text: Column, max_length: int = 200) -> Column:
    """The first sentence, at most max_length characters."""
    first = F.regexp_extract(F.trim(text), r"(?s)^(.*?[.!?])(\s|$)", 1)
    return F.substring(F.when(F.length(first) > 0, first).otherwise(F.trim(text)), 1, max_length)


def glob_regex(pattern: str) -> str:
    """An anchored regex for a shell pattern; * and ? also cross slashes."""
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"^{out}$"
