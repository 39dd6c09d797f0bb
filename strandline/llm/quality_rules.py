"""Operator 4: quality rules as a short-circuit cascade.

Every document gets its base counts. Documents that pass the base rule run through further
rules, any of which rejects. Their order is set beforehand: on a sample, each rule's time and
share of rejections are measured on the executors, and rules run by rejections per cost, so that
most rejected documents meet their rejecting rule early. The order changes the work only:
a verdict is the conjunction of all rules.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are each
judged; an empty table gives no rows; further columns are not read. Memory is bounded by an
Arrow batch and one text's words.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import arrow_map, doc_bytes

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(0x80, 0x100))
#: Texts of more words count their windows in numpy rather than in a dictionary.
MANY_WORDS = 200_000


@dataclass
class Doc:
    """A text and the base counts of the contract."""

    body: bytes
    words: list[bytes] = field(init=False)
    n_words: int = field(init=False)
    word_chars: int = field(init=False)
    n_symbols: int = field(init=False)
    n_lines: int = field(init=False)
    n_dup_lines: int = field(init=False)
    n_repeat_words: int = field(init=False)

    def __post_init__(self) -> None:
        body = self.body
        self.words = body.split()
        self.n_words = len(self.words)
        self.word_chars = len(body.translate(None, CONTINUATION + SPACE))
        self.n_symbols = len(body) - len(body.translate(None, SYMBOLS))
        lines = [x for x in body.split(b"\n") if x.strip()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeat_words(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    if n <= MANY_WORDS:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        often = np.fromiter(map(counts.__getitem__, windows), dtype=np.int64, count=len(windows)) > 1
    else:
        numbers: dict[bytes, int] = {}
        codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
        _, pairs = np.unique(codes[:-2] * len(numbers) + codes[1:-1], return_inverse=True)
        _, which, counted = np.unique(pairs.astype(np.int64) * len(numbers) + codes[2:], return_inverse=True, return_counts=True)
        often = counted[which] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(often)] |= often
    return int(covered.sum())


Rule = Callable[[Doc], bool]


def symbol_heavy(d: Doc) -> bool:
    return 10 * d.n_symbols > d.n_words


def odd_word_length(d: Doc) -> bool:
    return not 2 * d.n_words <= d.word_chars <= 15 * d.n_words


def repeated_lines(d: Doc) -> bool:
    return d.n_dup_lines >= 3 and 10 * d.n_dup_lines > 3 * d.n_lines


def few_lettered_words(d: Doc) -> bool:
    """Under four fifths of the words hold a letter (any byte beyond ASCII counts as one)."""
    bare = sum(1 for w in d.words if not w.strip(b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    return 5 * bare > d.n_words


def shouting(d: Doc) -> bool:
    """Over 30 % of the ASCII letters are capitals."""
    small = d.body.translate(None, UPPER)
    capitals = len(d.body) - len(small)
    ascii_letters = capitals + len(small) - len(small.translate(None, bytes(range(97, 123))))
    return 10 * capitals > 3 * max(ascii_letters, 1)


def exclaiming(d: Doc) -> bool:
    return 10 * d.body.count(b"!") > 3 * d.n_words


#: The production rules, in no particular order.
RULES: dict[str, Rule] = {f.__name__: f for f in (symbol_heavy, odd_word_length, repeated_lines, few_lettered_words, shouting, exclaiming)}


def order_rules(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = 2000) -> list[str]:
    """Rule names by rejections per second, as measured on about sample_rows documents.

    The sample is every document whose id hashes below a threshold, so it's spread over all
    partitions, and only one row of sums a batch reaches the driver.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.where((F.xxhash64("doc_id", "text") / 2.0**64 + 0.5) < share)
    names = list(rules)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        spent, rejected = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0)
        for body in batch.column("body").to_pylist():
            d = Doc(body)
            if d.base_failed:
                continue
            for name in names:
                began = time.perf_counter()
                rejected[name] += rules[name](d)
                spent[name] += time.perf_counter() - began
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([spent[n] for n in names]), pa.array([rejected[n] for n in names], type=pa.int64())], names=["rule", "spent", "rejected"])

    sums = arrow_map(doc_bytes(sample).select("body"), measure, "rule string, spent double, rejected long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"))
    found = {r["rule"]: (r["spent"], r["rejected"]) for r in sums.collect()}
    return sorted(names, key=lambda n: (-found.get(n, (1.0, 0))[1] / max(found.get(n, (1.0, 0))[0], 1e-9), n))


def quality_rules(docs: DataFrame, rules: dict[str, Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of docs."""
    order = order_rules(docs, rules) if order is None else order
    cascade = [rules[name] for name in order]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {name: [] for name in (*counts, "base_failed", "kept")}
        for body in batch.column("body"):
            d = Doc(body.as_py())
            for name in counts:
                out[name].append(getattr(d, name))
            out["base_failed"].append(failed := d.base_failed)
            out["kept"].append(not failed and not any(rule(d) for rule in cascade))
        arrays = [batch.column("doc_id"), *(pa.array(v, type=pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, v in out.items())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *out])

    return arrow_map(doc_bytes(docs), judge, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
c AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '^[!-@\[-`{-~]+$'))) AS bare,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters, length(t) - length(replace(t, '!', '')) AS bangs
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words) OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
    OR 5 * bare > n_words OR 10 * capitals > 3 * greatest(letters, 1) OR 10 * bangs > 3 * n_words) AS kept FROM b
"""
