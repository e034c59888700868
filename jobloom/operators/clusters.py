"""Task clusters: concentration, overlap with occupations, errors, and clusterings of vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.operators.neighbors import collapse_copies, copies_of, pairs_within
from jobloom.operators.ranking import first_per_group
from jobloom.session import cut_lineage, workspace

Clusterer = Callable[..., DataFrame]  # (items, row_id, vec, **options) -> (row_id, cluster)

# Concentration above which a group is flagged, and the affinity's steepness.
HIGH_CONCENTRATION = 0.7
AFFINITY_SCALE = 3.0
KMEANS_ROWS = 1 << 20
SUM_NUMBERS = 1 << 16  # numbers of a partial sum that travel together


def concentration(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sum of squared shares of `value` inside each `group`."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    total = F.sum("__n")
    return counts.groupBy(group).agg((F.sum(F.col("__n") * F.col("__n")) / (total * total)).alias("hh"))


def concentrated(df: DataFrame, group: str, value: str, above: float = HIGH_CONCENTRATION) -> DataFrame:
    """Groups with a flag for high concentration."""
    return concentration(df, group, value).withColumn("high", F.col("hh") > above)


def incidence(df: DataFrame, key: str, cluster: str) -> DataFrame:
    """Distinct (key, cluster) pairs: the long form of the indicator table."""
    return df.select(key, cluster).distinct()


def incidence_wide(df: DataFrame, key: str, cluster: str, clusters: Sequence[int]) -> DataFrame:
    """One 0/1 column `c_<cluster>` per cluster."""
    wide = df.groupBy(key).pivot(cluster, list(clusters)).agg(F.count(F.lit(1)))
    return wide.select(
        key, *[F.least(F.coalesce(F.col(f"`{c}`"), F.lit(0)), F.lit(1)).cast("int").alias(f"c_{c}") for c in clusters]
    )


def task_overlap(df: DataFrame, key: str, cluster: str) -> tuple[DataFrame, DataFrame]:
    """Clusters per key, and keys per cluster."""
    pairs = incidence(df, key, cluster)
    return (
        pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_clusters")),
        pairs.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_keys")),
    )


def regression_table(
    crosswalk: DataFrame, tasks: DataFrame, wages: DataFrame, soc: str, occ: str, cluster: str
) -> DataFrame:
    """`(occ, cluster, wage)`: wages with the clusters each occupation takes part in; noise left out."""
    linked = crosswalk.join(tasks.where(F.col(cluster) != -1), soc)
    return incidence(linked, occ, cluster).join(wages, occ)


def occupation_errors(
    predictions: DataFrame, titles: DataFrame, occ: str, title: str, order: Sequence
) -> DataFrame:
    """Signed and absolute error per occupation with its first title, worst first."""
    names = first_per_group(titles, [occ], order).select(occ, title)
    err = F.col("prediction") - F.col("actual")
    return (
        predictions.select(occ, err.alias("err"), F.abs(err).alias("abs_err"))
        .join(names, occ)
        .orderBy(F.desc("abs_err"), occ)
    )


def explained_variance(df: DataFrame, actual: str, prediction: str, name: str = "r2") -> DataFrame:
    """`1 - mean squared error / population variance`."""
    err = F.col(prediction) - F.col(actual)
    return df.agg((1 - F.avg(err * err) / F.var_pop(actual)).alias(name))


def cluster_profile(
    concentration_table: DataFrame, medoids: DataFrame, labels: DataFrame, cluster: str
) -> DataFrame:
    """One row per cluster: word label, medoid text and concentration."""
    return concentration_table.join(medoids, cluster, "left").join(labels, cluster, "left")


# ---------------------------------------------------------------- clusterings


def bisecting_clusters(
    items: DataFrame, row_id: str, vec: str, n_clusters: int, seed: int = 1
) -> DataFrame:
    """Top-down hierarchical clustering on cosine distance."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    featured = items.select(row_id, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = BisectingKMeans(k=n_clusters, distanceMeasure="cosine", seed=seed).fit(featured)
    return model.transform(featured).select(row_id, F.col("prediction").alias("cluster"))


def spectral_clusters(
    items: DataFrame,
    row_id: str,
    vec: str,
    n_clusters: int,
    max_distance: float,
    scale: float = AFFINITY_SCALE,
    iterations: int = 20,
) -> DataFrame:
    """Power-iteration clustering on the affinities `exp(-scale · d²)` of the pairs in range.

    Items without a partner in range get cluster -1; identical items share a cluster. The pairs are stored once, as
    arrays, and each step is a sum over them in tasks; only one number per item reaches the driver and the tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = items.sparkSession
    points = cut_lineage(collapse_copies(items, row_id, [vec]))
    ids = np.sort(points.select(F.col(row_id).cast("bigint").alias("id")).dropna().toPandas()["id"].to_numpy(dtype="int64"))
    near = pairs_within(items, row_id, [vec], max_distance).select(F.col("i").cast("bigint"), F.col("j").cast("bigint"), "d")
    known = spark.sparkContext.broadcast(ids)

    def as_arrays(batches):
        for batch in batches:
            i, j = (np.searchsorted(known.value, batch.column(k).to_numpy()).astype("int32") for k in range(2))
            d = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_pydict({"i": [i.tobytes()], "j": [j.tobytes()], "a": [np.exp(-scale * d * d).tobytes()]})

    path = workspace(spark, "affinities")
    near.mapInArrow(as_arrays, "i binary, j binary, a binary").write.parquet(path)
    stored = spark.read.schema("i binary, j binary, a binary").parquet(path).coalesce(spark.sparkContext.defaultParallelism)

    def product(x: np.ndarray) -> np.ndarray:
        """The symmetric matrix of affinities times `x`."""
        shared = spark.sparkContext.broadcast(x)

        def add(batches):
            v, total = shared.value, np.zeros(len(x))
            for batch in batches:
                for row in range(batch.num_rows):
                    i, j, w = (np.frombuffer(batch.column(k)[row].as_buffer(), t) for k, t in enumerate(("int32", "int32", "float64")))
                    total += np.bincount(i, w * v[j], len(v)) + np.bincount(j, w * v[i], len(v))
            for s in range(0, len(v), SUM_NUMBERS):
                yield pa.RecordBatch.from_pydict({"start": [s], "part": [total[s : s + SUM_NUMBERS].tobytes()]})

        def merge(key, table):
            parts = [np.frombuffer(p.as_buffer(), "float64") for p in table.column("part")]
            return pa.table({"start": [key[0].as_py()], "part": [np.sum(parts, axis=0).tobytes()]})

        sums = stored.mapInArrow(add, "start long, part binary").groupBy("start").applyInArrow(merge, "start long, part binary")
        out = np.zeros(len(x))
        for r in sums.collect():
            part = np.frombuffer(r["part"], "float64")
            out[r["start"] : r["start"] + len(part)] = part
        shared.unpersist()
        return out

    degree = product(np.ones(len(ids)))
    linked = degree > 0
    before = degree / max(degree.sum(), np.finfo(float).tiny)
    tolerance, last = max(1e-5 / max(linked.sum(), 1), 1e-8), np.inf
    for _ in range(iterations if linked.any() else 0):
        now = np.where(linked, product(before) / np.where(linked, degree, 1.0), 0.0)
        now /= np.abs(now).sum()
        moved = np.abs(now - before).sum()
        settled, last, before = abs(moved - last) <= tolerance, moved, now
        if settled:
            break
    placed = spark.createDataFrame(pd.DataFrame({"rep_id": ids[linked], "v": before[linked]}), "rep_id long, v double")
    # Its partitions decide where k-means starts: they follow from the items alone.
    placed = placed.coalesce(-(-max(len(ids), 1) // KMEANS_ROWS))
    if linked.any():
        placed = placed.withColumn("features", array_to_vector(F.array("v")))
        model = KMeans(k=n_clusters, seed=0).fit(placed)
        placed = model.transform(placed).withColumnRenamed("prediction", "cluster")
    else:
        placed = placed.withColumn("cluster", F.lit(-1))
    return (
        copies_of(items, points, row_id, [vec])
        .join(placed.select("rep_id", "cluster"), "rep_id", "left")
        .select(row_id, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    )


def sweep(
    items: DataFrame,
    row_id: str,
    vec: str,
    clusterer: Clusterer,
    sizes: Sequence[int],
    score: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Score of a clusterer at several cluster counts, long form `(clusters, variable, value)`.

    `score` turns `(row_id, cluster)` into one row of numbers.
    """
    out = None
    for k in sizes:
        scored = score(clusterer(items, row_id, vec, n_clusters=k))
        names = scored.columns
        part = scored.select(
            F.lit(k).alias("clusters"), *[F.col(c).cast("double").alias(c) for c in names]
        ).unpivot(["clusters"], names, "variable", "value")
        out = part if out is None else out.unionByName(part)
    return out
