import random

import pytest

#: Further columns whose names the operators use inside.
CLASHING = ["body", "score", "fp", "seed", "doc", "rep", "copies", "unit", "part", "target", "size", "content", "shard", "h", "version", "source_size", "mix_copies", "chosen", "cut_spans", "ids", "n", "label"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing columns."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "délta", "über", "the", "of", "and", "naïve", "zeta,", "Eta.", "42"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    shared = prose(80)
    rows = [
        (1, prose(120), "en", "a"), (2, prose(120), "en", "b"), (2, prose(120), "en", "b"), (3, "", "en", "a"), (4, None, None, None), (None, prose(70), "de", "a"),
        (5, "x" * 300_000, "en", "a"), (6, "\n".join(["same line here"] * 4000), "en", "c"), (7, " \t\n\x0b\x0c\r ", "en", None),
        (8, f"{prose(40)} {shared} {prose(30)}", "en", "a"), (9, f"{prose(60)}\n{shared}\n{prose(20)}", "fr", "b"), (9, f"{prose(60)}\n{shared}\n{prose(20)}", "fr", "b"),
        (10, "é🙂 中文▁ <|im_start|> \x00", "zh", "d"), (11, prose(60_000), "en", "a"),
    ]
    rows += [(12, rows[0][1], "en", "a"), (12, rows[0][1], "en", "a")]
    data = [(i, t, lang, s, len(t) if t else None, *[f"extra {k}" if k % 2 else None for k in range(len(CLASHING))]) for i, t, lang, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(5)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
