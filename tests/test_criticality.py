"""Security words and error handling: patterns only see texts that hold their word, with the results of plain regexes."""

import re

from pyspark.sql import functions as F

from strandline.functions import code as C

TEXTS = [None, "", "password", "passwords secret_ token", "Token;AUTH", "x-hash-é", "éhashé", "auth\nencrypt", "permission credential's", "retry", "try:", "a catch", "exceptional", "rescue", "Result<T>", "if err != nil {", "@login", "@ login", "login @csrf", "@Admin"]


def test_criticality_functions(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    t = F.col("text")
    got = {r.i: r for r in d.select("i", C.security_keywords(t).alias("words"), C.handles_errors(t).alias("errors"), C.decorated(t).alias("decorated")).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i].words == [k for k in C.SECURITY if re.search(rf"(?a)\b{k}\b", (text or "").lower())]
        assert got[i].errors == (None if text is None else bool(re.search(r"(?a)\b(try|catch|except|rescue)\b|Result<|if err != nil", text)))
        assert got[i].decorated == (None if text is None else bool(re.search(C.DECORATORS, text)))


def test_patterns_of_keywords_are_constants(spark):
    """A pattern that is no constant is compiled again for each row and word."""
    d = spark.createDataFrame([(1, "a token")], "i int, text string")
    plan = d.select(C.security_keywords(F.col("text")).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "concat" not in plan.lower()
