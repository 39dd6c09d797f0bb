import random


def test_texts_that_share_an_id(spark):
    import corpus_pipeline as C

    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = prose(60)
    rows = [(1, f"{prose(30)} {shared}"), (2, f"{shared} {prose(40)}"), (2, prose(120)), (2, prose(30)), (3, prose(80))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.text for r in C.near_duplicates(spark, df.union(df), "").collect()}
    assert kept == {t for _, t in rows}
    left = [r.text for r in C.repeated_text(spark, df, "").collect()]
    assert {rows[0][1], *(t for _, t in rows[2:])} <= set(left) and len(left) == len(rows)
