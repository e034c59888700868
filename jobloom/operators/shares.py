"""Occupation shares, their adjustment and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.session import cut_lineage


def _total(df: DataFrame, column: str) -> Column:
    """Total of a column, added up task by task."""
    return df.agg(F.sum(column)).scalar()


def value_shares(df: DataFrame, column: str, share: str = "share") -> DataFrame:
    """Rows per value and their share of all non-null rows."""
    known = df.where(F.col(column).isNotNull())
    counts = known.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn(share, F.col("n") / total)


def weighted_shares(df: DataFrame, column: str, weight: str, share: str = "share") -> DataFrame:
    """Weight per value as a share of the total weight."""
    sums = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum(weight).alias("__w"))
    return sums.select(column, (F.col("__w") / _total(sums, "__w")).alias(share))


def mean_by_code(df: DataFrame, code: str, value: str, name: str = "mean") -> DataFrame:
    """Mean per integer code; rows whose code is no integer or whose value is null are left out."""
    return (
        df.select(F.col(code).try_cast("bigint").alias(code), F.col(value).alias("__v"))
        .where(F.col(code).isNotNull() & F.col("__v").isNotNull())
        .groupBy(code)
        .agg(F.avg("__v").alias(name))
    )


def confusion_adjusted_shares(predicted: DataFrame, cells: DataFrame, pred: str = "pred") -> DataFrame:
    """Shares of true classes implied by predictions and a confusion table.

    Every prediction spreads over the true classes of its confusion column; a predicted class the
    table lacks adds nothing. Only classes that were predicted are reported, without rescaling.
    """
    # Both have a row per class and are read twice.
    counts = cut_lineage(predicted.groupBy(F.col(pred).alias("__pred")).agg(F.count(F.lit(1)).alias("__k")))
    by_truth = cut_lineage(
        cells.join(counts, cells["pred"] == counts["__pred"])
        .groupBy("truth")
        .agg(F.sum(F.col("n") * F.col("__k")).alias("__w"))
    )
    share = F.col("__w") / _total(by_truth, "__w")
    shares = by_truth.select(F.col("truth").alias("code"), share.alias("share"))
    return shares.join(counts.select(F.col("__pred").alias("code")), "code", "left_semi")


def relative_entropy(p: DataFrame, q: DataFrame, key: str, share: str = "share") -> DataFrame:
    """KL(p‖q) in nats over the union of keys, both rescaled to 1; infinite where q = 0 < p."""
    both = (
        p.select(key, F.col(share).alias("__p"))
        .join(q.select(key, F.col(share).alias("__q")), key, "full")
        .select(F.coalesce("__p", F.lit(0.0)).alias("__p"), F.coalesce("__q", F.lit(0.0)).alias("__q"))
    )
    # Σ (p/P) ln((p/P)/(q/Q)) = (Σ p ln(p/q)) / P + ln(Q/P), which needs one pass.
    term = F.when(F.col("__p") == 0, 0.0).when(F.col("__q") == 0, float("inf")).otherwise(
        F.col("__p") * F.ln(F.try_divide(F.col("__p"), F.col("__q")))
    )
    sp, sq = F.sum("__p"), F.sum("__q")
    return both.agg((F.sum(term) / sp + F.ln(sq / sp)).alias("kl"))


def share_gap(
    a: DataFrame, b: DataFrame, key: str, n: int = 10, share: str = "share"
) -> DataFrame:
    """The `n` keys where `b` exceeds `a` most and the `n` where `a` exceeds `b` most."""
    gap = (
        a.select(key, F.col(share).alias("share_a"))
        .join(b.select(key, F.col(share).alias("share_b")), key)
        .withColumn("gap", F.col("share_a") - F.col("share_b"))
    )

    def side(label: str, order: Column) -> DataFrame:
        return gap.orderBy(order, key).limit(n).withColumn("side", F.lit(label))

    return side("over", F.col("gap").asc()).unionByName(side("under", F.col("gap").desc()))
