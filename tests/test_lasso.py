import numpy as np
import pytest

from jobloom.operators import lasso

ALPHAS = [0.02, 0.3, 2.0]


def by_hand(x, y, alpha):
    """Coordinate descent on the rows themselves."""
    mx, my = x.mean(axis=0), y.mean()
    xc, yc = x - mx, y - my
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        before = w.copy()
        for j in range(len(w)):
            spread = (xc[:, j] ** 2).mean()
            if spread > 1e-12:
                rest = yc - xc @ w + xc[:, j] * w[j]
                rho = (xc[:, j] * rest).mean()
                w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / spread
        if np.abs(w - before).max() < 1e-12:
            break
    return my - w @ mx, w


@pytest.fixture(scope="module")
def jobs():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (40, 6)).astype(float)
    x[:, 5] = x[:, 4]  # two clusters with the same members
    x[3] = 0
    y = 10 + 4 * x[:, 1] - 2 * x[:, 4] + rng.normal(scale=0.5, size=40)
    return x, y


def long_frame(spark, x, y):
    rows = [(i, j, float(y[i])) for i in range(len(x)) for j in np.flatnonzero(x[i]).tolist() + [None]]
    return spark.createDataFrame(rows + rows[:7], "occ int, cluster int, wage double")


def moments(x, y):
    z = np.column_stack([np.ones(len(x)), x, y])
    return z.T @ z, z


@pytest.mark.parametrize("alpha", ALPHAS)
def test_solutions_from_moments_equal_those_from_rows(jobs, alpha):
    x, y = jobs
    m, z = moments(x, y)
    got = lasso.solve(m, alpha)
    b, w = by_hand(x, y, alpha)
    assert np.allclose(got[0] + x @ got[1:], b + x @ w, atol=1e-6)
    out = lasso.solve_without(m, z, alpha, got)
    for i in range(len(x)):
        keep = np.arange(len(x)) != i
        b, w = by_hand(x[keep], y[keep], alpha)
        assert abs(out[i, 0] + x[i] @ out[i, 1:] - (b + x[i] @ w)) < 1e-6


def test_largest_penalty_leaves_no_weight(jobs):
    m, _ = moments(*jobs)
    path = lasso.penalties(m, 10)
    assert np.abs(lasso.solve(m, path[0] * 1.0001)[1:]).max() == 0
    assert np.abs(lasso.solve(m, path[1])[1:]).max() > 0


@pytest.mark.parametrize("folds", [None, 3])
def test_whole_regression_equals_refits(spark, jobs, folds):
    x, y = jobs
    predictions, coefs, scores = lasso.wage_lasso(long_frame(spark, x, y), "occ", "cluster", "wage", ALPHAS, folds=folds)
    got = {r["occ"]: r for r in predictions.collect()}
    assert len(got) == 40
    if folds:
        data = spark.range(40).withColumn("f", lasso.hash_fold("id", folds))
        fold = [r["f"] for r in data.orderBy("id").collect()]
    else:
        fold = list(range(40))
    out = {}
    for alpha in ALPHAS:
        p = np.zeros(40)
        for f in set(fold):
            test = np.array(fold) == f
            b, w = by_hand(x[~test], y[~test], alpha)
            p[test] = b + x[test] @ w
        out[alpha] = p
    best = min(ALPHAS, key=lambda a: ((out[a] - y) ** 2).sum())
    b, w = by_hand(x, y, best)
    for i in range(40):
        assert abs(got[i]["actual"] - y[i]) < 1e-12
        assert abs(got[i]["prediction_out"] - out[best][i]) < 1e-5
        assert abs(got[i]["prediction"] - (b + x[i] @ w)) < 1e-5
    row = scores.first()
    assert row["alpha"] == best
    assert abs(row["r2_in"] - (1 - ((b + x @ w - y) ** 2).mean() / y.var())) < 1e-6
    assert abs(row["r2_out"] - (1 - ((out[best] - y) ** 2).mean() / y.var())) < 1e-6
    # Twin columns may share their weight in any way; the others are unique.
    weights = {r["feature"]: r["coef"] for r in coefs.collect()}
    assert abs(weights.get("c_1", 0.0) - w[1]) < 1e-5


def test_rows_without_wage_and_empty_tables(spark, jobs):
    x, y = jobs
    df = long_frame(spark, x, y)
    extra = spark.createDataFrame([(90, 1, None), (None, 2, 3.0), (91, None, 9.0)], df.schema)
    got = lasso.wage_lasso(df.unionByName(extra), "occ", "cluster", "wage", [0.3])[0]
    assert {r["occ"] for r in got.collect()} == set(range(40)) | {91}
    with pytest.raises(ValueError):
        lasso.wage_lasso(df.where("wage < 0 AND wage > 0"), "occ", "cluster", "wage", [0.3])
