import math
import random

from pyspark.sql import functions as F

from jobloom.operators import metrics, ranking, scores, shares, tables, worklists


def test_unambiguous_counts_case_variants(spark, rows):
    titles = spark.createDataFrame(
        [("Cook", "1", 0), ("cook", "1", 1), ("Baker", "2", 2), ("Baker", "2", 3), ("Nurse", "3", 4), ("nurse", None, 5)],
        "title string, code string, ord int",
    )
    got = tables.unambiguous_titles(titles, order=[F.col("ord")]).select("title", "code", "ord")
    assert rows(got, "ord") == [("baker", "2", 2), ("nurse", "3", 4), ("nurse", None, 5)]


def test_describe_falls_through(spark, rows):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "code string")
    names = spark.createDataFrame([("a", "Alpha")], "code string, d string")
    got = tables.describe(df, names, "code", "d", "name")
    assert rows(got, F.col("code").asc_nulls_first()) == [(None, None), ("a", "Alpha"), ("z", "z")]


def test_translate_takes_first_row(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "w")], "id int, code string")
    cross = spark.createDataFrame([("x", "n1", 2), ("x", "n0", 1), ("y", None, 1), ("y", "n9", 2)], "s string, t string, o int")
    got = tables.translate_codes(df, cross, "code", "s", "t", [F.col("o")])
    assert rows(got.select("id", "code"), "id") == [(1, "n0")]


def test_first_values_per_column(spark, rows):
    df = spark.createDataFrame([("k", 1, None, "b"), ("k", 2, "a", "c")], "k string, o int, x string, y string")
    assert rows(ranking.first_values(df, ["k"], ["x", "y"], [F.col("o")])) == [("k", "a", "b")]


def test_mutual_support_is_the_four_passes(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(12), rng.choice([None, *range(9)])) for i in range(900)]
    passes = ((60, 5), (70, 6), (55, 5), (60, 4))

    def keep(rows, key, other, least, partners):
        groups = {}
        for r in rows:
            groups.setdefault(r[key], []).append(r)
        return [
            r for k, g in groups.items() if k is not None and len(g) > least and len({x[other] for x in g}) > partners
            for r in g
        ]

    want = data
    for i, (least, partners) in enumerate(passes):
        want = keep(want, *((1, 2) if i % 2 == 0 else (2, 1)), least, partners)
    df = spark.createDataFrame(data, "id int, a int, b int")
    got = tables.mutual_support(df, "a", "b", passes)
    assert sorted(r["id"] for r in got.collect()) == sorted(r[0] for r in want)
    assert 0 < len(want) < len(data)


def test_sliced_rank_equals_row_number(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 8 + ["cold", None]), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, id int")
    got = ranking.hash_rank(df, ["k"], "id", "s")
    want = {}
    for k, i in data:
        want.setdefault(k, []).append(i)
    import hashlib

    order = {
        i: n for ids in want.values()
        for n, i in enumerate(sorted(ids, key=lambda i: (hashlib.md5(f"s{i}".encode()).hexdigest(), i)), 1)
    }
    assert {r["id"]: r["rank"] for r in got.collect()} == order


def test_dense_index(spark):
    df = spark.createDataFrame([(f"v{i % 37:02d}",) for i in range(300)] + [(None,)], "v string")
    got = {r["v"]: r["i"] for r in ranking.dense_index(df, "v", "i").collect()}
    assert got == {f"v{i:02d}": i for i in range(37)}


def test_nested_local_id_in_slices(spark):
    data = [("d", f"s{p % 40}", p) for p in range(200)]
    df = spark.createDataFrame(data, "d string, s string, p int")
    got = ranking.nested_local_id(df, "d", "s", "p", "n", slice_rows=7)
    assert {(r["s"], r["n"]) for r in got.collect()} == {(f"s{i}", i + 1) for i in range(40)}


def test_stratified_sample_drops_small_strata(spark):
    data = [(i, "big") for i in range(20)] + [(i, "even") for i in range(20, 25)]
    got = ranking.stratified_sample(spark.createDataFrame(data, "id int, c string"), ["c"], "id", 5).collect()
    assert len(got) == 5 and {r["c"] for r in got} == {"big"}


def test_sample_cuts_groups_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("c", F.col("id") % 3)
    plan = ranking.top_per_group(df, ["c"], [F.col("id")], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_work_list_recycles_from_the_end(spark):
    a = spark.createDataFrame([(i,) for i in range(4)], "p long")
    b = spark.createDataFrame([(i,) for i in range(100, 103)], "p long")
    pattern = [0, 0, 1, 0]
    got = ranking.assign_slots({0: a, 1: b}, "p", 5, pattern, seed="9")
    import hashlib

    def order(ids):
        return sorted(ids, key=lambda i: hashlib.md5(f"9{i}".encode()).hexdigest())

    pools = [order(range(4)), order(range(100, 103))]
    left = [list(p) for p in pools]
    want = []
    for w in range(1, 6):
        for s, g in enumerate(pattern):
            if not left[g]:
                left[g] = list(pools[g])
            want.append((w, s, left[g].pop()))
    assert sorted(tuple(r) for r in got.select("worker_id", "slot", "p").collect()) == sorted(want)


def test_sampled_texts_parts(spark):
    df = spark.createDataFrame([("k", i, f"<{i}>") for i in range(30)], "k string, i int, t string")
    got = worklists.sampled_texts(df, "k", "i", "t", share=0.33, replicates=2, part_rows=4).collect()
    for r in (0, 1):
        parts = sorted((x["part"], x["content"]) for x in got if x["replicate"] == r)
        assert [p for p, _ in parts] == [0, 1, 2]
        assert "".join(c for _, c in parts).count("<") == 10
    whole = worklists.sampled_texts(df, "k", "i", "t", share=0.33, replicates=1).collect()
    assert whole[0]["content"] == "".join(
        c for _, c in sorted((x["part"], x["content"]) for x in got if x["replicate"] == 0)
    )


def test_bubble_up_keeps_totals_and_breaks_ties(spark, rows):
    df = spark.createDataFrame(
        [(1, "11-1011", 0.25), (1, "11-2011", 0.25), (1, "10-1011", 0.5), (2, "15-1111", 1.0)],
        "doc_id int, code string, p double",
    )
    rolled = scores.bubble_up(df, 2)
    assert rows(rolled) == [(1, "10", 0.5), (1, "11", 0.5), (2, "15", 1.0)]
    assert rows(scores.best_class(rolled).select("doc_id", "code")) == [(1, "10"), (2, "15")]


def test_class_correlation_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.random((40, 4)) * (rng.random((40, 4)) > 0.3)
    m[:, 0] += 0.1
    data = [(d, f"c{c}", float(m[d, c])) for d in range(40) for c in range(4) if m[d, c] > 0]
    df = spark.createDataFrame(data, "doc_id int, code string, p double")
    got = {(r["class_a"], r["class_b"]): r["corr"] for r in scores.class_correlation(df, ["c0", "c1", "c2", "c3"]).collect()}
    want = np.corrcoef(m.T)
    assert len(got) == 6
    assert all(abs(v - want[int(a[1]), int(b[1])]) < 1e-9 for (a, b), v in got.items())


def test_metrics_agree_with_spark(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    rng = random.Random(2)
    data = [(float(t), float(t if rng.random() < 0.6 else rng.randrange(5))) for t in (rng.randrange(5) for _ in range(400))]
    df = spark.createDataFrame(data, "label double, prediction double")
    text = df.select(F.col("label").cast("string").alias("truth"), F.col("prediction").cast("string").alias("pred"))
    labels = text.select(F.col("truth").alias("label")).union(text.select("pred")).distinct()
    cells = metrics.confusion(text, labels)
    assert cells.agg(F.sum("n")).first()[0] == 400
    got = metrics.classification_summary(cells).first()
    ev = lambda m: MulticlassClassificationEvaluator(metricName=m).evaluate(df)
    assert abs(got["accuracy"] - ev("accuracy")) < 1e-9
    assert abs(got["f1_weighted"] - ev("f1")) < 1e-9
    avg = {r["mode"]: r for r in metrics.averaged_scores(cells).collect()}
    assert abs(avg["weighted"]["precision"] - ev("weightedPrecision")) < 1e-9
    assert abs(avg["weighted"]["recall"] - ev("weightedRecall")) < 1e-9


def test_classes_without_true_rows(spark):
    cells = spark.createDataFrame(
        [("a", "a", 3), ("a", "b", 1), ("b", "a", 0), ("b", "b", 0)], "truth string, pred string, n long"
    )
    got = {r["mode"]: r for r in metrics.averaged_scores(cells).collect()}
    assert got["macro"]["recall"] == 0.75 and got["macro"]["precision"] == 1.0
    assert got["micro"]["precision"] == 0.75


def test_relative_entropy(spark):
    p = spark.createDataFrame([("a", 2.0), ("b", 6.0)], "k string, share double")
    q = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, share double")
    kl = lambda x, y: shares.relative_entropy(x, y, "k").first()["kl"]
    assert abs(kl(p, p)) < 1e-12
    assert abs(kl(p, q) - (0.25 * math.log(0.5) + 0.75 * math.log(1.5))) < 1e-12
    assert kl(p, q.where("k = 'a'")) == math.inf
    assert abs(kl(q.where("k = 'a'"), p) + math.log(0.25)) < 1e-12


def test_shares_sum_to_one(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("v"))
    assert abs(shares.value_shares(df, "v").agg(F.sum("share")).first()[0] - 1) < 1e-12


def test_slice_offsets_are_not_sent_to_every_task(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), "id")
    ranked = ranking.hash_rank(df, ["k"], "id")
    ranks = sorted((r["k"], r["rank"]) for r in ranked.collect())
    assert ranks == [(k, i) for k in range(3) for i in range(1, 2000 // 3 + (k < 2000 % 3) + 1)]
    plan = ranked._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
