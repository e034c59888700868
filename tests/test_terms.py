import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from jobloom.functions.text import space_tokens
from jobloom.operators import clusters, embeddings, models, pieces, terms


def learn_by_hand(counts, merges, least):
    words = {w: ["▁", *w] for w in counts}
    out = []
    while len(out) < merges:
        pairs = Counter()
        for w, n in counts.items():
            for p in zip(words[w], words[w][1:]):
                pairs[p] += n
        pairs = {p: n for p, n in pairs.items() if n >= least}
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        out.append((len(out) + 1, a, b, a + b, n))
        for w, parts in words.items():
            merged, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == [a, b]:
                    merged.append(a + b)
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            words[w] = merged
    return out


def test_word_pieces_in_exact_order(spark):
    rng = random.Random(8)
    counts = {"".join(rng.choice("aabcde") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 60) for _ in range(90)}
    counts["aaaaa"] = 31
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = pieces.learn_pieces(df, merges=45, min_count=3, candidates=16)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == learn_by_hand(counts, 45, 3)


def test_word_pieces_to_the_end_in_small_rounds(spark):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6))) for _ in range(40)]
    counts = {"".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))): rng.randrange(1, 30) for _ in range(300)}
    counts |= {"": 9, "aaaaaaa": 40, "b b": 7}
    rows = [*counts.items(), (None, 50), ("zzz", None)]
    df = spark.createDataFrame(rows, "word string, n long")
    want = learn_by_hand(counts, 10**6, 5)
    for bounds in ({}, {"candidates": 60, "run_pieces": 600}):
        got = pieces.learn_pieces(df, **bounds)
        assert [tuple(r) for r in got.orderBy("rank").collect()] == want
    known = {c for w in counts for c in w} | {"▁", "z"}
    got = [tuple(r) for r in pieces.learn_pieces(df, vocab_size=len(known) + 50).orderBy("rank").collect()]
    assert got == want[:50]


def test_word_pieces_of_nothing(spark):
    assert pieces.learn_pieces(spark.createDataFrame([], "word string, n long")).count() == 0


def test_document_vectors(spark):
    vectors = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 4.0])], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, "a b zz"), (2, "a a"), (3, "zz"), (4, "")], "d int, t string")
    got = {r["d"]: r["vec"] for r in embeddings.embed_documents(docs, vectors, "d", "t", 2).collect()}
    assert got == {1: [0.6, 0.8], 2: [1.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}
    sent = {r["d"]: r["vec"] for r in embeddings.embed_sentences(docs, vectors, ["d"], "t", 2).collect()}
    assert set(sent) == {1, 2}
    assert np.allclose(sent[2], np.array([6.0, 0.0]) / math.sqrt(18))


def test_unseen_texts_once(spark):
    vectors = spark.createDataFrame([("a", [1.0])], "word string, vec array<double>")
    docs = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    store = docs.where("t = 'b'").select(F.md5("t").alias("key"))
    got = embeddings.embed_unseen(docs, store, vectors, "t", 1).collect()
    assert [r["vec"] for r in got] == [[1.0]]


def test_tfidf_formula(spark):
    docs = spark.createDataFrame([(0, "x x y"), (1, "y z"), (2, "y")], "d int, t string")
    counts = terms.term_counts(docs, "d", "t", space_tokens)
    got = {(r["d"], r["term"]): r["tfidf"] for r in terms.tfidf(counts, "d", F.lit(3)).collect()}
    idf = {w: math.log(4 / (1 + n)) + 1 for w, n in {"x": 1, "y": 3, "z": 1}.items()}
    size = math.hypot(2 * idf["x"], idf["y"])
    assert abs(got[(0, "x")] - 2 * idf["x"] / size) < 1e-12
    assert abs(got[(2, "y")] - 1) < 1e-12
    rare = terms.tfidf(counts, "d", F.lit(3), min_df=2, max_df=1.0).select("term").distinct().collect()
    assert [r[0] for r in rare] == ["y"]


def test_term_effects_match_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 60
    x = rng.random((n, 3)) * (rng.random((n, 3)) > 0.4)
    y = rng.integers(0, 3, n)
    values = [(d, f"t{j}", float(x[d, j])) for d in range(n) for j in range(3) if x[d, j] > 0]
    got = terms.term_effects(
        spark.createDataFrame(values, "d int, term string, tfidf double"),
        spark.createDataFrame([(i, f"c{c}") for i, c in enumerate(y)], "d int, c string"),
        ["c0", "c1", "c2"], "d", "c",
    ).collect()
    assert len(got) == 9
    for r in got:
        xs, ys = x[:, int(r["term"][1])], (y == int(r["class"][1])).astype(float)
        design = np.column_stack([np.ones(n), xs])
        beta, res, *_ = np.linalg.lstsq(design, ys, rcond=None)
        se = math.sqrt(res[0] / (n - 2) * np.linalg.inv(design.T @ design)[1, 1])
        assert abs(r["slope"] - beta[1]) < 1e-9 and abs(r["t"] - beta[1] / se) < 1e-6


def test_concentration(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 5)], "g string, v int")
    got = {r["g"]: r["hh"] for r in clusters.concentration(df, "g", "v").collect()}
    assert abs(got["a"] - 5 / 9) < 1e-12 and got["b"] == 1.0


def test_incidence_is_capped_at_one(spark, rows):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 3)], "k int, c int")
    assert rows(clusters.incidence_wide(df, "k", "c", [0, 3])) == [(1, 1, 0), (2, 0, 1)]


def test_classifier_beats_the_majority_class(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 200)
    x = np.eye(3)[y] + rng.normal(scale=0.4, size=(200, 3))
    df = spark.createDataFrame(
        [(i, f"1{c}-1111", [float(v) for v in row]) for i, (c, row) in enumerate(zip(y, x))],
        "doc_id int, code string, vec array<double>",
    )
    data = models.with_features(df, "vec")
    model = models.fit_classifier(data, "code", C=5.0, balanced=True)
    long = models.predict_scores(model, data, "doc_id")
    assert abs(long.agg(F.sum("p")).first()[0] - 200) < 1e-6
    from jobloom.operators.scores import bubble_up_accuracy

    assert bubble_up_accuracy(long, df, 2).first()["accuracy"] > 0.8


def test_lasso_keeps_the_real_effect(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2, (120, 4))
    y = 5.0 * x[:, 2] + rng.normal(scale=0.3, size=120)
    df = spark.createDataFrame(
        [(i, *map(int, row), float(v)) for i, (row, v) in enumerate(zip(x, y))], "id int, a int, b int, c int, d int, y double"
    )
    _, coefs, scored = models.wage_regression(df, ["a", "b", "c", "d"], "y", "id", [0.05, 5.0])
    best = {r["feature"]: r["coef"] for r in coefs.collect()}
    row = scored.first()
    assert row["alpha"] == 0.05 and row["r2_out"] > 0.9 and row["r2_in"] >= row["r2_out"]
    assert max(best, key=best.get) == "c" and best["c"] > 4
