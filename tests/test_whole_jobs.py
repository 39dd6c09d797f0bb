"""Operators over every row of their tables, against brute force."""

import re

from pyspark.sql import functions as F

from strandline.functions import scores as X
from strandline.functions import text as T
from strandline.operators import dedup as D
from strandline.plans import retrieval, structure  # noqa: F401  they fill the registry
from strandline.plans.registry import REGISTRY
from strandline.sources.tables import table


def test_query_expansion_of_all_rows(spark, sf):
    rows = REGISTRY["query_expansion"].run(spark, sf).collect()
    assert len(rows) == table(spark, sf, "conversations").count()
    for r in rows:
        assert (r.synonyms, r.context, r.expanded) == (T.expanded(r["query"], T.SYNONYMS, 3), T.expanded(r["query"], T.CODE_CONTEXT, 5), T.expanded_full(r["query"]))
    odd = [" \n auth  db\tuser ", "bug error", "Test api config", "", "\n"]
    df = spark.createDataFrame([(x,) for x in odd], "q string")
    assert [r[0] for r in df.select(T.expanded_column(F.col("q"), T.SYNONYMS, 3)).collect()] == [T.expanded(x, T.SYNONYMS, 3) for x in odd]


def test_entities_of_all_documents(spark, sf):
    patterns = [re.compile(p, re.ASCII) for p in (r"\b[a-z]+_[a-z_]+\b", r"\b[A-Z][a-z]+[A-Z][A-Za-z]*\b", r"\b[a-z]+\(\)")]
    brute = lambda t: None if t is None else list(dict.fromkeys(m for p in patterns for m in p.findall(t)))[:10]
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r.entities for r in REGISTRY["entities"].run(spark, sf).collect()}
    assert got == {d: None if t is None else " ".join(brute(t)) for d, t in texts.items()} and any(not t.isascii() for t in texts.values())
    odd = ["été_ab naïve_x éAbCd", "snake_case CamelCase über call()"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    assert [r[0] for r in df.select(X.entities(F.col("t"))).collect()] == [brute(x) for x in odd]


def test_lsh_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    exact = {(r.a, r.b) for r in D.similar_pairs(table(spark, sf, "embeddings"), 0.4, id_="vec_id").collect()}
    found = {(r.a, r.b) for r in REGISTRY["lsh_pairs"].run(spark, sf).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)
    print("lsh recall", len(found), len(exact))


def test_mmr_of_the_registered_query(spark):
    """Diversity penalty and greedy choice, done again in plain Python over the fifty best rows."""
    from strandline.operators import keyword_index as N
    from strandline.operators import search as S

    sf = "/root/testdata/sf0.01"
    best = S.top(N.index_scores(spark, retrieval.keyword_index(spark, sf), retrieval.QUERY), "bm25", 50).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").where(F.col("doc_id").isin([r.id for r in best])).collect()}
    low, high = min(r.bm25 for r in best), max(r.bm25 for r in best)
    score = {r.id: (r.bm25 - low) / (high - low) for r in best}
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    words = lambda t: set(t.lower().split())
    order, seen = sorted(score, key=lambda i: (-score[i], i)), []
    for i in order:
        head = words(texts[i][:100])
        lowered = score[i] - 0.1 * any(share(head, x) > 0.8 for x in seen)
        seen.append(head)
        score[i] = lowered
    picked = []
    while len(picked) < 10:
        left = [i for i in score if i not in picked]
        picked.append(max(left, key=lambda i: (0.7 * score[i] - 0.3 * max([share(words(texts[i]), words(texts[j])) for j in picked], default=0.0), score[i], -i)))
    got = sorted(REGISTRY["mmr_rerank"].run(spark, sf).collect(), key=lambda r: r.position)
    assert [r.id for r in got] == picked
