"""Lasso of wages on cluster indicators, from moments that Spark adds up once.

Every fit, on all rows, without a fold or without one row, is coordinate descent on a moment matrix:
the products of (1, features, wage) summed over its rows. Tasks add the products of their rows by
fold, the sums are added per matrix row, and the rest of the table is not read again until it is
predicted. A fold's held-out error comes from its own moments; leaving one row out subtracts that
row's products.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.operators.ranking import hash_fold
from jobloom.session import cut_lineage

MAX_FEATURES = 2048  # the driver and each task hold one matrix of this many rows and columns per fold
PATH_POINTS, PATH_SPAN = 100, 1e-3  # fixed values: penalties tried by default, the smallest relative to the largest
SWEEPS, TOLERANCE = 10_000, 1e-10
STEP_ENTRIES = 1 << 21  # numbers of the rows' matrix a task works on at once

Dense = Callable[[pd.DataFrame], np.ndarray]


def _soft(value, by: float):
    return np.sign(value) * np.maximum(np.abs(value) - by, 0.0)


def _centered(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covariances of the features, and of the features with the wage."""
    n, sums = moments[0, 0], moments[0, 1:]
    centered = moments[1:, 1:] / n - np.outer(sums, sums) / n**2
    return centered[:-1, :-1], centered[:-1, -1]


def solve(moments: np.ndarray, alpha: float, start: np.ndarray | None = None) -> np.ndarray:
    """Intercept and weights that minimise `RSS / 2n + alpha · Σ|w|` over the rows of `moments`."""
    gram, target = _centered(moments)
    w = np.zeros(len(target)) if start is None else start[1:].copy()
    slope = target - gram @ w
    spread = np.diag(gram)
    scale = max(float(np.abs(target).max(initial=0.0)), 1e-300)
    for _ in range(SWEEPS):
        moved = 0.0
        for j in np.flatnonzero(spread > 1e-12):
            new = _soft(slope[j] + spread[j] * w[j], alpha) / spread[j]
            if new != w[j]:
                slope -= gram[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * spread[j])
                w[j] = new
        if moved <= TOLERANCE * scale:
            break
    means = moments[0, 1:] / moments[0, 0]
    return np.concatenate([[means[-1] - w @ means[:-1]], w])


def solve_without(moments: np.ndarray, rows: np.ndarray, alpha: float, start: np.ndarray) -> np.ndarray:
    """Per row of `rows (1, features, wage)` the solution on all rows of `moments` but that one, as one batch."""
    n = moments[0, 0] - 1
    sums = moments[0, 1:][None, :] - rows[:, 1:]
    means = sums / n
    x, y, mx, my = rows[:, 1:-1], rows[:, -1], means[:, :-1], means[:, -1]
    gram, cross = moments[1:-1, 1:-1], moments[1:-1, -1]
    w = np.repeat(start[None, 1:], len(rows), axis=0)
    # The centred Gram matrix without a row is (gram - x xᵀ) / n - m mᵀ; only its columns are ever built.
    slope = (cross - x * y[:, None]) / n - mx * my[:, None]
    slope -= (w @ gram - x * (w * x).sum(axis=1)[:, None]) / n - mx * (w * mx).sum(axis=1)[:, None]
    spread = (np.diag(gram) - x**2) / n - mx**2
    scale = max(float(np.abs(slope).max(initial=0.0)), float(np.abs(cross).max(initial=0.0)) / n, 1e-300)
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(x.shape[1]):
            s = spread[:, j]
            new = np.where(s > 1e-12, _soft(slope[:, j] + s * w[:, j], alpha) / np.where(s > 1e-12, s, 1.0), w[:, j])
            step = new - w[:, j]
            if step.any():
                slope -= step[:, None] * ((gram[j][None, :] - x[:, j : j + 1] * x) / n - mx[:, j : j + 1] * mx)
                moved = max(moved, float(np.abs(step * s).max()))
                w[:, j] = new
        if moved <= TOLERANCE * scale:
            break
    return np.hstack([(my - (w * mx).sum(axis=1))[:, None], w])


def penalties(moments: np.ndarray, points: int = PATH_POINTS, span: float = PATH_SPAN) -> list[float]:
    """Penalties evenly spaced in logarithm, from the least that leaves no weight downwards."""
    most = float(np.abs(_centered(moments)[1]).max(initial=0.0))
    return [float(a) for a in np.geomspace(most, most * span, points)] if most > 0 else [1.0]


def _rows(pdf: pd.DataFrame, dense: Dense) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), dense(pdf), pdf["label"].to_numpy(dtype="float64")])


def _steps(pdf: pd.DataFrame, width: int):
    size = max(1, STEP_ENTRIES // width)
    for start in range(0, len(pdf), size):
        yield pdf.iloc[start : start + size]


def fold_moments(data: DataFrame, dense: Dense, width: int) -> dict[int, np.ndarray]:
    """Per fold the moment matrix of its rows; `width` counts one, the features and the wage."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in (part for batch in batches for part in _steps(batch, width)):
            for fold, rows in pdf.groupby("fold"):
                z = _rows(rows, dense)
                sums[fold] = sums.get(fold, 0.0) + z.T @ z
        for fold, m in sums.items():
            yield pd.DataFrame({"fold": fold, "i": np.arange(width), "m": list(m)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "i": [pdf["i"].iloc[0]], "m": [np.sum(np.stack(pdf["m"]), axis=0)]})

    schema = "fold int, i int, m array<double>"
    parts = data.select("fold", "label", "x").mapInPandas(add, schema)
    summed = parts.groupBy("fold", "i").applyInPandas(total, schema).toPandas()
    return {int(f): np.stack(rows.sort_values("i")["m"].to_list()) for f, rows in summed.groupby("fold")}


def _path(moments: np.ndarray, alphas: Sequence[float]) -> dict[float, np.ndarray]:
    """Solutions of all penalties, each started from the next larger one's."""
    out, last = {}, None
    for alpha in sorted(alphas, reverse=True):
        out[alpha] = last = solve(moments, alpha, last)
    return out


def _error(moments: np.ndarray, solution: np.ndarray) -> float:
    v = np.concatenate([-solution, [1.0]])
    return float(v @ moments @ v)


def fit_lasso(
    data: DataFrame,
    names: Sequence[str],
    dense: Dense,
    row_id: str,
    alphas: Sequence[float] | None,
    folds: int | None,
    threshold: float,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, coefficients and scores of `data (row_id, label, x)`; see `wage_lasso`."""
    from jobloom.operators.clusters import explained_variance

    if len(names) > MAX_FEATURES:
        raise ValueError(f"{len(names)} features, at most {MAX_FEATURES}")
    spark, width = data.sparkSession, len(names) + 2
    fold = hash_fold(row_id, folds) if folds else F.lit(0)
    data = cut_lineage(data.withColumn("fold", fold.cast("int")))
    parts = fold_moments(data, dense, width)
    if not parts:
        raise ValueError("no rows with a wage")
    moments = sum(parts.values())
    alphas = list(alphas) if alphas is not None else penalties(moments)
    whole = _path(moments, alphas)

    def without(pdf: pd.DataFrame, alpha: float) -> np.ndarray:
        z = _rows(pdf, dense)
        w = solve_without(moments, z, alpha, whole[alpha])
        return w[:, 0] + (w[:, 1:] * z[:, 1:-1]).sum(axis=1)

    if folds:
        held_out = {f: _path(moments - m, alphas) if moments[0, 0] > m[0, 0] else whole for f, m in parts.items()}
        errors = {a: sum(_error(m, held_out[f][a]) for f, m in parts.items()) for a in alphas}
    else:

        def tried(batches):
            total = np.zeros(len(alphas))
            for pdf in (part for batch in batches for part in _steps(batch, width)):
                for k, a in enumerate(alphas):
                    total[k] += ((without(pdf, a) - pdf["label"].to_numpy()) ** 2).sum()
            yield pd.DataFrame({"k": np.arange(len(alphas)), "e": total})

        summed = data.mapInPandas(tried, "k int, e double").groupBy("k").agg(F.sum("e").alias("e")).collect()
        errors = {alphas[r["k"]]: r["e"] for r in summed}
    best = min(errors, key=lambda a: (errors[a], a))
    inside = whole[best]
    outside = {f: path[best] for f, path in held_out.items()} if folds else {}

    def predict(batches):
        for pdf in (part for batch in batches for part in _steps(batch, width)):
            z = _rows(pdf, dense)[:, :-1]
            if folds:
                out = (z * np.stack([outside[f] for f in pdf["fold"]])).sum(axis=1)
            else:
                out = without(pdf, best)
            yield pd.DataFrame({row_id: pdf[row_id], "actual": pdf["label"], "prediction": z @ inside, "prediction_out": out})

    kind = data.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {kind}, actual double, prediction double, prediction_out double"
    predictions = data.mapInPandas(predict, schema)
    kept = [(str(n), float(w)) for n, w in zip(names, inside[1:]) if abs(w) > threshold]
    coefs = spark.createDataFrame(kept, "feature string, coef double").orderBy("coef")
    r2_out = explained_variance(predictions, "actual", "prediction_out", "r2_out")
    scores = explained_variance(predictions, "actual", "prediction", "r2_in").join(r2_out)
    return predictions, coefs, scores.select(F.lit(float(best)).alias("alpha"), "r2_in", "r2_out")


def wage_lasso(
    long: DataFrame,
    row_id: str,
    cluster: str,
    wage: str,
    alphas: Sequence[float] | None = None,
    folds: int | None = None,
    threshold: float = 1e-5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lasso of `wage` on the clusters a row belongs to, from the long form `(row_id, cluster, wage)`.

    The penalty with the least held-out error is chosen, by leaving each row out or on hash `folds`;
    without `alphas` a path of 100 is tried. Returns predictions `(row_id, actual, prediction,
    prediction_out)`, the coefficients `c_<cluster>` above `threshold`, and one row of
    `alpha, r2_in, r2_out`. A row's wage is its largest; rows without one, or without an id, are left
    out, and repeated pairs count once. More than `MAX_FEATURES` clusters are refused.
    """
    pairs = long.select(row_id, cluster, F.col(wage).cast("double").alias("label")).where(
        F.col(row_id).isNotNull() & F.col("label").isNotNull()
    )
    listed = pairs.select(cluster).where(F.col(cluster).isNotNull()).distinct()
    found = sorted(r[0] for r in listed.limit(MAX_FEATURES + 1).collect())
    if len(found) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} clusters")
    kind = long.schema[cluster].dataType.simpleString()
    places = long.sparkSession.createDataFrame([(c, i) for i, c in enumerate(found)], f"`{cluster}` {kind}, __place int")
    placed = pairs.join(places, cluster, "left")
    data = placed.groupBy(row_id).agg(F.max("label").alias("label"), F.collect_set("__place").alias("x"))
    width = len(found)

    def dense(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(pdf), width))
        sizes = pdf["x"].map(len).to_numpy()
        if sizes.sum():
            out[np.repeat(np.arange(len(pdf)), sizes), np.concatenate(pdf["x"].to_list()).astype(int)] = 1.0
        return out

    return fit_lasso(data, [f"c_{c}" for c in found], dense, row_id, alphas, folds, threshold)
