from collections import Counter

from pyspark.sql import functions as F

from jobloom.functions.text import space_tokens
from jobloom.operators import terms


def counted(rows):
    found = Counter()
    for d, t in rows:
        for w in (t or "").split():
            found[d, w] += 1
    return found


def test_rows_of_one_id_add_up(spark):
    for rows in (
        [(1, "b a b"), (2, "a"), (3, None), (4, ""), (None, "c c c")],
        [(1, "b a b"), (2, "a"), (1, "a c"), (None, "c c"), (None, "c"), (3, "b b")],
    ):
        df = spark.createDataFrame(rows, "d int, t string")
        got = terms.term_counts(df, "d", "t", space_tokens).where("term <> 'a'").collect()
        want = {k: n for k, n in counted(rows).items() if k[1] != "a"}
        assert {(r["d"], r["term"]): r["tf"] for r in got} == want and len(got) == len(want)


def test_terms_are_not_moved_once_per_document(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(300).select(F.col("id").alias("d"), F.concat(F.lit("x y"), F.col("id") % 7, F.lit(" z x")).alias("t"))
        counts = terms.term_counts(docs, "d", "t", space_tokens)
        out = terms.tfidf(counts, "d", F.lit(300), min_df=2)
        assert out.count() == 900
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "hashpartitioning(term" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_terms_beyond_the_lookup(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(9) if i % (j + 1) == 0)) for i in range(60)]
    counts = terms.term_counts(spark.createDataFrame(rows, "d int, t string"), "d", "t", space_tokens)
    want = {tuple(r) for r in terms.tfidf(counts, "d", F.lit(60), 2, 0.9).select("d", "term", F.round("tfidf", 9)).collect()}
    monkeypatch.setattr(terms, "LOOKUP_TERMS", 3)
    few = terms.tfidf(counts, "d", F.lit(60), 2, 0.9).select("d", "term", F.round("tfidf", 9)).collect()
    assert len(few) == len(want) and {tuple(r) for r in few} == want
