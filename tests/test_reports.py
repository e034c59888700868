"""The report of class scores: results on odd rows, and that it keeps no table of documents."""

import math
import re

from pyspark.sql import functions as F

from jobloom.operators import scores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_is_one_sorted_aggregate(spark):
    """Neither a table of all documents nor a second pass over the scores."""
    df = spark.range(0, 100).select((F.col("id") * 7 % 31).alias("doc_id"), F.lit("11").alias("code"), F.rand(1).alias("score"))
    shown = plan(scores.predictions_report(scores.normalize_scores(df), ["11", "12"]))
    assert "SortAggregate" in shown and "HashAggregate" not in shown and "Join" not in shown
    assert len(re.findall(r"\bSort \[", shown)) == 1


def test_report_of_odd_rows(spark):
    nan = math.nan
    rows = [
        (1, "b", 0.5), (1, "a", 0.5), (2, "a", None), (2, "b", -1.0), (3, "z", 0.9), (4, "a", 0.2), (4, "a", 0.3),
        (None, "a", 1.0), (5, "a", 9.0), (5, "b", nan), (6, "a", None), (7, None, 0.4), (7, "a", 0.4), (8, "a", 0.0),
    ]
    df = spark.createDataFrame(rows, "doc_id int, code string, p double")
    got = scores.predictions_report(df, ["a", "b"])
    assert got.columns == ["doc_id", "top_class", "p_a", "p_b"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (1, "a", 0.5, 0.5), (2, "b", 0.0, -1.0), (3, "z", 0.0, 0.0), (4, "a", 0.5, 0.0),
        (5, "b", 9.0, nan), (6, "a", 0.0, 0.0), (7, None, 0.4, 0.0), (8, "a", 0.0, 0.0),
    ]))
