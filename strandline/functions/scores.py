"""Scores and labels as Column expressions: trust, confidence, utility, classifiers, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import ascii_bounds, hits

#: How reliable a source is.
SOURCE_CONFIDENCE = {"user_explicit": 0.9, "documentation": 0.85, "code_indexed": 0.8, "inferred": 0.7, "auto_classified": 0.6, "imported": 0.5, "legacy": 0.5}
#: What a project's or row's state weighs in a search.
STATE_WEIGHT = {"ACTIVE": 1.0, "PAUSED": 0.5, "ARCHIVED": 0.1, "DELETED": 0.0}
LIFECYCLE_WEIGHT = {"ACTIVE": 1.0, "RECENT": 0.7, "ARCHIVED": 0.3, "STALE": 0.1}


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def source_confidence(source: Column) -> Column:
    return lookup(SOURCE_CONFIDENCE, source, 0.5)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def rounded(x: Column, digits: int) -> Column:
    """x in so many digits, by rounding the scaled number in doubles, as SQL engines do; Spark's round() goes by its shortest decimal form.

    They differ at halves, which a weighted sum of rounded figures meets often.
    """
    return F.round(x * float(10**digits), 0) / float(10**digits)


def age_days(since: Column, now: Column) -> Column:
    """Whole days."""
    return F.floor(F.timestamp_diff("SECOND", since, now) / 86400)


def trust(confidence: Column, verified: Column, accesses: Column, age: Column, confirmed_age: Column) -> Column:
    """0.3 source, 0.25 or 0.1 verification, up to 0.2 access and 0.15 age, and 0.1."""
    access = F.when(accesses >= 20, 0.2).when(accesses >= 10, 0.15).when(accesses >= 5, 0.1).otherwise(0.05)
    fresh = F.when(age < 30, 0.15).when(age < 90, 0.12).when(age < 180, 0.08).otherwise(0.05)
    fresh = F.when(confirmed_age < 30, F.least(F.lit(0.15), fresh + 0.05)).otherwise(fresh)
    return clamp(confidence * 0.3 + F.when(verified, 0.25).otherwise(0.1) + access + fresh + 0.1)


def confidence(base: Column, verified: Column, accesses: Column, age: Column, confirmed_age: Column) -> Column:
    """The source's confidence, less with age, more with verification, confirmation and access."""
    c = F.when(age > 365, base * 0.8).when(age > 180, base * 0.9).otherwise(base)
    c = F.when(verified, F.least(F.lit(1.0), c + 0.15)).otherwise(c)
    c = F.when(confirmed_age < 30, F.least(F.lit(1.0), c + 0.1)).otherwise(c)
    c = F.when(accesses > 10, F.least(F.lit(1.0), c + 0.05)).otherwise(c)
    return clamp(c)


def explanation(verified: Column, accesses: Column, age: Column, similarity: Column) -> Column:
    """Reasons in order, as one array of strings."""
    relative = F.when(age < 1, "today").when(age < 7, F.format_string("%d days ago", age)).when(age < 30, F.format_string("%d weeks ago", F.floor(age / 7))).otherwise(F.format_string("%d months ago", F.floor(age / 30)))
    return F.array_compact(F.array(F.when(similarity >= 0.8, "strong match"), F.when(verified, "verified"), F.when(accesses >= 10, F.format_string("used %d times", accesses)), F.concat(F.lit("created "), relative)))


def stepped_recency(age: Column) -> Column:
    return F.when(age <= 7, 1.0).when(age <= 30, 0.8).when(age <= 90, 0.5).when(age <= 180, 0.3).otherwise(0.1)


def suggestion_confidence(similarity: Column, recent: Column, importance: Column, context: Column) -> Column:
    # a division of the doubled figure gives 0.16 for 0.8; a product with 0.2 gives a little more
    return clamp(0.5 * similarity + 2 * recent / 10 + 0.2 * importance + 0.1 * context)


def confidence_label(score: Column) -> Column:
    return F.when(score > 0.8, "excellent").when(score >= 0.6, "good").otherwise("weak")


def similarity_band(score: Column) -> Column:
    return F.when(score >= 0.95, "high").when(score >= 0.85, "medium").when(score >= 0.75, "low").otherwise("none")


def severity(degradation: Column) -> Column:
    d = F.abs(degradation)
    return F.when(d >= 0.6, "CRITICAL").when(d >= 0.4, "SEVERE").when(d >= 0.25, "MODERATE").when(d >= 0.1, "MINOR").otherwise("NONE")


TALK = r"^(ok|okay|thanks|thank you|cool|got it|hello|hi|yes|no)\b"
WANT = r"\b(how|what|where|show|find|search|explain|que|wie)\b"
TECHNICAL = ["error", "function", "class", "api", "database", "token", "config", "server"]


def retrieval_utility(text: Column) -> Column:
    """How useful a search would be for a message, from 0 to 1."""
    low, n = F.lower(text), F.length(text)
    talk, want = low.rlike(ascii_bounds(TALK)), low.rlike(ascii_bounds(WANT))
    tech = F.size(F.filter(F.array(*[F.lit(k) for k in TECHNICAL]), lambda k: F.contains(low, k)))
    code = text.rlike(r"\(\)|\{\}|\[\]|->|=>|::")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    score = 0.5 + on(want, 0.3) + on(tech > 0, 0.2) + on(F.contains(text, F.lit("?")), 0.15) + on(code, 0.15) + on(words >= 4, 0.1) + on(n > 50, 0.1) + on(tech >= 3, 0.1)
    score = score - on(talk & ~want, 0.3) - on((words <= 2) & ~code, 0.2)
    return F.when((n < 10) & talk, 0.0).when((n <= 30) & talk & ~want, 0.1).otherwise(clamp(score))


#: Regex families of the context-level classifier.
LEVEL_PATTERNS = {
    "USER_PREFERENCE": [r"\bprefer", r"\balways\b", r"\bnever\b", r"\blike\b"],
    "PROJECT_CONTEXT": [r"\bproject\b", r"\barchitecture\b", r"\buses?\b", r"\bdatabase\b", r"\bthis\b"],
    "SESSION_STATE": [r"\bcurrent", r"\bnow\b", r"\btoday\b", r"\bworking\b"],
}


def level_scores(text: Column) -> Column:
    """map<level, score>: hits over 0.3 times the family's size, at most 1."""
    low = F.lower(text)
    entries = []
    for level, patterns in LEVEL_PATTERNS.items():
        n = sum((F.when(hits(low, p), 1).otherwise(0) for p in patterns), F.lit(0))
        entries += [F.lit(level), F.least(F.lit(1.0), n / max(1.0, 0.3 * len(patterns)))]
    return F.create_map(*entries)


def classified_level(scores: Column, default: str = "PROJECT_CONTEXT") -> Column:
    """The best level of level_scores(), the earlier one in a tie; the default below 0.3."""
    best = F.array_max(F.array(*[F.struct(scores[level].alias("s"), F.lit(-i).alias("i"), F.lit(level).alias("level")) for i, level in enumerate(LEVEL_PATTERNS)]))
    return F.when(best["s"] >= 0.3, best["level"]).otherwise(default)


#: Conversation triggers: kind -> (patterns, base confidence, boost).
TRIGGERS = {
    "question": ([r"\?", r"\b(how|what|why|where)\b"], 0.7, 0.1),
    "debugging": ([r"\b(error|exception|bug|fail)", r"\bnot work"], 0.8, 0.1),
    "implementation": ([r"\b(implement|add|create|build)\b", r"\bneed to\b"], 0.75, 0.1),
    "refactoring": ([r"\b(refactor|clean|improve|rename)\b"], 0.7, 0.1),
}


def detected_patterns(text: Column) -> Column:
    """array<struct<confidence, kind>>, most confident first: base and a boost for each further hit, at most 0.99."""
    low, found = F.lower(text), []
    for kind, (patterns, base, boost) in TRIGGERS.items():
        n = sum((F.regexp_count(low, F.lit(ascii_bounds(p))) for p in patterns), F.lit(0))
        found.append(F.when(n > 0, F.struct((-F.least(F.lit(0.99), base + boost * (n - 1))).alias("c"), F.lit(kind).alias("kind"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda s: F.struct((-s["c"]).alias("confidence"), s["kind"].alias("kind")))


def entities(text: Column, limit: int = 10) -> Column:
    """Distinct identifiers and capitalised names in order of patterns and places."""
    snake = F.regexp_extract_all(text, F.lit(ascii_bounds(r"\b[a-z]+_[a-z_]+\b")), F.lit(0))
    camel = F.regexp_extract_all(text, F.lit(ascii_bounds(r"\b[A-Z][a-z]+[A-Z][A-Za-z]*\b")), F.lit(0))
    calls = F.regexp_extract_all(text, F.lit(ascii_bounds(r"\b[a-z]+\(\)")), F.lit(0))
    return F.slice(F.array_distinct(F.concat(snake, camel, calls)), 1, limit)


INTENTS = {"debugging": r"\b(error|bug|fix|fail|exception)\b", "learning": r"\b(how|what|explain|understand|que)\b", "implementation": r"\b(add|create|implement|build)\b", "exploration": r"\b(find|where|show|list|der)\b"}


def _like(pattern: str):
    return lambda t: F.lower(t).rlike(ascii_bounds(pattern))


def intent(texts: Column) -> Column:
    """struct<intent, confidence> of a session's recent queries: hits over queries; 'general' without any."""
    n = F.size(texts)
    scored = [F.struct((F.size(F.filter(texts, _like(p))) / n).alias("confidence"), F.lit(-i).alias("i"), F.lit(k).alias("intent")) for i, (k, p) in enumerate(INTENTS.items())]
    best = F.array_max(F.array(*scored))
    return F.when((n > 0) & (best["confidence"] > 0), F.struct(best["intent"].alias("intent"), best["confidence"].alias("confidence"))).otherwise(F.struct(F.lit("general").alias("intent"), F.lit(0.0).alias("confidence")))


def human_time(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def cache_key(text: Column, model: str) -> Column:
    return F.concat(F.sha2(text, 256), F.lit(":"), F.lit(model))


def health_score(latency_ms: Column, error_rate: Column, hit_rate: Column) -> Column:
    """100 less penalties for slow answers, errors and cache misses."""
    slow = F.when(latency_ms > 100, 30).when(latency_ms > 50, 15).otherwise(0)
    errors = F.when(error_rate > 0.1, 40).when(error_rate > 0.02, 20).otherwise(0)
    misses = F.when(hit_rate < 0.5, 20).when(hit_rate < 0.8, 10).otherwise(0)
    return F.greatest(F.lit(0), 100 - slow - errors - misses)
