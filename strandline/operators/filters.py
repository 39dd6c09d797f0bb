"""Filters: a dataclass of conditions compiled to one Column, and a query language on top of it."""

from __future__ import annotations

import datetime as dt
import re
import shlex
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import glob_regex

#: Fields that rows may be sorted by.
SORTABLE = ("created_at", "updated_at", "importance")
FIELDS = ("category", "context_level", "scope", "project_name", "lifecycle_state", "provenance_source")


def one_condition(name: str, value, at_least: bool = False) -> Column | None:
    """name == value, or name >= value; no condition for None, nor for a lower bound of 0."""
    if value is None or (at_least and value <= 0):
        return None
    return F.col(name) >= F.lit(value) if at_least else F.col(name) == F.lit(value)


@dataclass
class MemoryFilter:
    """All conditions that are set hold together; tags come as all, any and none of a list."""

    category: str | None = None
    context_level: str | None = None
    scope: str | None = None
    project_name: str | None = None
    min_importance: float = 0.0
    max_importance: float = 1.0
    tags_all: list[str] = field(default_factory=list)
    tags_any: list[str] = field(default_factory=list)
    tags_none: list[str] = field(default_factory=list)
    created_after: str | None = None
    created_before: str | None = None
    accessed_after: str | None = None
    accessed_before: str | None = None
    lifecycle_states: list[str] = field(default_factory=list)
    exclude_categories: list[str] = field(default_factory=list)
    exclude_projects: list[str] = field(default_factory=list)
    provenance_source: str | None = None
    file_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    path: str = "project_name"

    def __post_init__(self) -> None:
        for lo, hi in ((self.created_after, self.created_before), (self.accessed_after, self.accessed_before)):
            if lo and hi and parse_date(lo) > parse_date(hi):
                raise ValueError("a range starts after its end")
        if not 0 <= self.min_importance <= self.max_importance <= 1:
            raise ValueError("importance bounds must be ordered and in [0, 1]")

    def column(self) -> Column:
        """One conjunction, of which the scan can push down what compares columns with literals."""
        parts = [one_condition(n, getattr(self, n)) for n in ("category", "context_level", "scope", "project_name", "provenance_source")]
        parts.append(one_condition("importance", self.min_importance, at_least=True))
        if self.max_importance < 1:
            parts.append(F.col("importance") <= self.max_importance)
        parts += [F.array_contains("tags", t) for t in self.tags_all]
        strings = lambda xs: F.array(*[F.lit(x) for x in xs])
        if self.tags_any:
            parts.append(F.arrays_overlap("tags", strings(self.tags_any)))
        if self.tags_none:
            parts.append(~F.arrays_overlap("tags", strings(self.tags_none)))
        for name, lo, hi in (("created_at", self.created_after, self.created_before), ("last_accessed", self.accessed_after, self.accessed_before)):
            if lo:
                parts.append(F.col(name) >= _stamp(lo))
            if hi:
                parts.append(F.col(name) <= _stamp(hi))
        if self.lifecycle_states:
            parts.append(F.col("lifecycle_state").isin(self.lifecycle_states))
        if self.exclude_categories:
            parts.append(~F.col("category").isin(self.exclude_categories))
        if self.exclude_projects:
            parts.append(~F.col("project_name").isin(self.exclude_projects))
        if self.file_patterns:
            parts.append(F.col(self.path).rlike("|".join(glob_regex(p) for p in self.file_patterns)))
        if self.exclude_patterns:
            parts.append(~F.col(self.path).rlike("|".join(glob_regex(p) for p in self.exclude_patterns)))
        out = F.lit(True)
        for p in parts:
            if p is not None:
                out = out & p
        return out


def validated_sort(name: str) -> str:
    if name not in SORTABLE:
        raise ValueError(f"can't sort by {name!r}")
    return name


def _stamp(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{parse_date(text):%Y-%m-%d %H:%M:%S}'")


_UNITS = {"minute": dt.timedelta(minutes=1), "hour": dt.timedelta(hours=1), "day": dt.timedelta(days=1), "week": dt.timedelta(weeks=1), "month": dt.timedelta(days=30), "year": dt.timedelta(days=365)}


def parse_date(text: str, now: dt.datetime | None = None) -> dt.datetime:
    """ISO dates and times, or today, yesterday, last week/month/year, and 'N units ago'.

    A month is 30 days and a year 365. now is required for what is relative.
    """
    t = text.strip().lower()
    relative = {"today": 0, "yesterday": 1, "last week": 7, "last month": 30, "last year": 365}
    ago = re.fullmatch(r"(\d+)\s+(minute|hour|day|week|month|year)s?\s+ago", t)
    if t in relative or ago:
        if now is None:
            raise ValueError("a relative date needs a time to count from")
        if ago:
            return now - int(ago[1]) * _UNITS[ago[2]]
        return now.replace(hour=0, minute=0, second=0, microsecond=0) - dt.timedelta(days=relative[t])
    return dt.datetime.fromisoformat(text.strip().replace("Z", "")).replace(tzinfo=None)


#: Keys of the query language and the columns they mean.
KEYS = {"language": "category", "lang": "category", "project": "project_name", "proj": "project_name", "category": "category", "cat": "category", "scope": "scope", "level": "context_level", "file": "project_name", "path": "project_name"}
DATE_KEYS = {"created": "created_at", "modified": "last_accessed", "accessed": "last_accessed"}


@dataclass
class ParsedQuery:
    text: str
    conditions: list[Column]
    shown: list[str]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c
        return out


def date_condition(name: str, value: str) -> tuple[Column, str]:
    """A condition from '>=2024-01-01', '<…', '2024-01-01' (that day) or 'a..b' (whole days)."""
    if ".." in value:
        lo, hi = value.split("..", 1)
        if parse_date(lo) > parse_date(hi):
            raise ValueError(f"{value!r} starts after its end")
        end = parse_date(hi) + dt.timedelta(days=1)
        return (F.col(name) >= _stamp(lo)) & (F.col(name) < _stamp(end.isoformat())), f"{name} in {value}"
    found = re.fullmatch(r"(>=|<=|>|<|=)?(.+)", value)
    op, day = found[1] or "=", _stamp(found[2])
    c = F.col(name)
    if op == "=":
        return (c >= day) & (c < _stamp((parse_date(found[2]) + dt.timedelta(days=1)).isoformat())), f"{name} on {found[2]}"
    return {">": c > day, ">=": c >= day, "<": c < day, "<=": c <= day}[op], f"{name} {op} {found[2]}"


def parse_query(text: str) -> ParsedQuery:
    """Free text, key:value pairs and -file: exclusions; unknown keys stay in the free text."""
    free, conditions, shown = [], [], []
    try:
        words = shlex.split(text)
    except ValueError:
        words = text.split()
    for word in words:
        key, colon, value = word.partition(":")
        without = key.startswith("-")
        key = key.lstrip("-").lower()
        if colon and value and key in KEYS:
            name = KEYS[key]
            glob = key in ("file", "path")
            found = F.col(name).rlike(glob_regex(value) if "*" in value else re.escape(value)) if glob else F.col(name) == value
            conditions.append(~found if without else found)
            shown.append(("not " if without else "") + f"{name}={value}")
        elif colon and value and key in DATE_KEYS:
            c, s = date_condition(DATE_KEYS[key], value)
            conditions.append(~c if without else c)
            shown.append(("not " if without else "") + s)
        else:
            free.append(word)
    return ParsedQuery(" ".join(free), conditions, shown)
