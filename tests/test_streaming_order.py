"""The newest posting by time, whatever the length of its stamp."""

from pyspark.sql import functions as F

from jobloom.operators import matching, models
from jobloom.streaming import ingest


def test_stamps_of_unequal_length(spark):
    stamps = ["9", "10", "2024-01-02T03:04:05", "2024-01-02", "soon", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, stamp string")
    got = {r["i"]: r["m"] for r in df.select("i", ingest.moment("stamp").alias("m")).collect()}
    assert got[0] < got[1] < got[3] < got[2] and got[4] is None and got[5] is None


def test_titles_that_end_in_marks_match_no_empty_title(spark):
    lookup = spark.createDataFrame([("", "0-0", 1), ("clerk", "1-1", 2)], "title string, code string, ord int")
    titles = spark.createDataFrame([("clerk, ",), (" - ",)], "title string")
    got = titles.transform(matching.segment_matcher(lookup)).select("title", "code").collect()
    assert [tuple(r) for r in got] == [("clerk, ", "1-1")]


def test_layers_keep_linear_plans(spark):
    lookup = spark.createDataFrame([("a b", "1-1", 1), ("c", "2-2", 2)], "title string, code string, ord int")
    rows = spark.createDataFrame([(1, "a b"), (2, "x - c"), (3, "none")], "post_id int, title string")
    layers = [matching.exact_matcher(lookup), matching.segment_matcher(lookup), matching.segment_matcher(lookup), matching.segment_matcher(lookup)]

    def scans(n):
        df = rows.transform(matching.layered_matcher(layers[:n], "post_id"))
        return df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")

    assert scans(4) - scans(3) <= scans(3) - scans(2)
    got = rows.transform(matching.layered_matcher(layers, "post_id")).select("post_id", "code", "layer").orderBy("post_id").collect()
    assert [tuple(r) for r in got] == [(1, "1-1", 1), (2, "2-2", 2)]


def test_classifier_leaves_out_rows_without_a_label(spark):
    rows = [(i, [float(i % 2), 1.0 - i % 2], ["11-1", "22-2"][i % 2]) for i in range(20)] + [(99, [0.5, 0.5], None)]
    data = models.with_features(spark.createDataFrame(rows, "i int, vec array<double>, code string"), "vec")
    model = models.fit_classifier(data, "code", C=10.0)
    regression = model.stages[-1]
    assert regression.summary.totalIterations >= 0 and abs(regression.getRegParam() - 1 / (10.0 * 20)) < 1e-12
