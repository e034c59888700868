"""Ranks in slices: results on odd rows, and how often rows are shuffled."""

import hashlib
import re

from pyspark.sql import functions as F

from jobloom.operators import ranking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_shuffled_once_for_their_rank(spark):
    """Numbering and merging in the offsets share a shuffle."""
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), "id", F.col("id").cast("string").alias("text"))
    ranked = plan(ranking.hash_rank(df, ["g"], "id", "7"))
    shuffles = re.findall(r"Exchange hashpartitioning\(([^\n]*)", ranked)
    assert len(shuffles) == 4  # rows; counts of slices, by slice and by group; offsets
    assert "Exchange hashpartitioning(coalesce" not in ranked


def test_ranks_of_odd_rows(spark):
    rows = [(g, k, f"{g}{k}") for g in ("a", None, "b") for k in [*range(300), None]] + [("c", None, "x")]
    df = spark.createDataFrame(rows, "g string, k int, text string")
    got = ranking.hash_rank(df, ["g"], "k", "3")
    assert got.columns == ["g", "k", "text", "rank"]
    want = []
    for g in ("a", None, "b", "c"):
        group = [r for r in rows if r[0] == g]
        group.sort(key=lambda r: ("" if r[1] is None else hashlib.md5(f"3{r[1]}".encode()).hexdigest(), r[1] or 0))
        want += [(*r, i) for i, r in enumerate(group, 1)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    # A position in slices, an order that names a key, and a name that is taken.
    df = spark.createDataFrame([("a", i % 5, i) for i in range(40)], "g string, rank int, at int")
    sliced = ranking.sliced_rank(df, ["g"], [F.col("g"), F.col("at")], F.floor(F.col("at") / 8))
    assert sliced.columns == ["g", "rank", "at"]
    assert sorted(map(tuple, sliced.collect())) == [("a", i + 1, i) for i in range(40)]
