"""Confusion tables `(truth, pred, n)` and everything computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import truncate
from jobloom.operators.ranking import top_per_group
from jobloom.session import cut_lineage


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def confusion(df: DataFrame, labels: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Counts over all label pairs, zero cells included; other labels are ignored.

    `labels` is a one-column class set, so the grid has |classes|² rows whatever the input size.
    """
    name = labels.columns[0]
    label_set = labels.agg(F.collect_set(name)).scalar()
    grid = labels.distinct().select(F.col(name).alias(truth), F.explode(label_set).alias(pred))
    counts = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [truth, pred], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_wide(cells: DataFrame, classes: list[str]) -> DataFrame:
    """Square form for files: one row per true class, one column per predicted class."""
    return cells.groupBy("truth").pivot("pred", classes).agg(F.sum("n"))


def class_counts(cells: DataFrame) -> DataFrame:
    """tp, fp, fn, support and predicted count per label in one pass over the cells."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("row"), F.lit(0).cast("bigint").alias("col"), hit.alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("row"), F.col("n").alias("col"), F.lit(0).cast("bigint").alias("tp")),
    )
    return (
        cells.select(F.explode(sides).alias("s"))
        .groupBy("s.label")
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.row").alias("support"), F.sum("s.col").alias("predicted"))
        .select(
            "label",
            "tp",
            (F.col("predicted") - F.col("tp")).alias("fp"),
            (F.col("support") - F.col("tp")).alias("fn"),
            "support",
            "predicted",
        )
    )


def class_scores(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1 per label; 0 where a denominator is 0."""
    return (
        class_counts(cells)
        .withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
    )


def averaged_scores(cells: DataFrame) -> DataFrame:
    """Micro, macro and support-weighted precision, recall and F1 (F1 of the averages).

    Classes without true rows do not enter the averages; their false positives still count.
    """
    scored = class_scores(cells)
    has = F.col("support") > 0
    weight = F.col("support").cast("double")
    sums = scored.agg(
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.sum("fn").alias("fn"),
        F.avg(F.when(has, F.col("precision"))).alias("macro_p"),
        F.avg(F.when(has, F.col("recall"))).alias("macro_r"),
        (F.sum(F.col("precision") * weight) / F.sum(weight)).alias("weighted_p"),
        (F.sum(F.col("recall") * weight) / F.sum(weight)).alias("weighted_r"),
    )
    micro_p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    micro_r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    modes = F.array(
        *[
            F.struct(F.lit(m).alias("mode"), p.alias("precision"), r.alias("recall"))
            for m, p, r in (
                ("micro", micro_p, micro_r),
                ("macro", F.col("macro_p"), F.col("macro_r")),
                ("weighted", F.col("weighted_p"), F.col("weighted_r")),
            )
        ]
    )
    return (
        sums.select(F.inline(modes))
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
    )


def classification_summary(cells: DataFrame, weight_by: str = "truth") -> DataFrame:
    """Accuracy and F1 micro, macro and weighted (by true or by predicted support)."""
    scored = class_scores(cells)
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    weight = F.col("support" if weight_by == "truth" else "predicted").cast("double")
    accuracy = _ratio(F.sum("tp"), F.sum("support"))
    return scored.agg(
        accuracy.alias("accuracy"),
        accuracy.alias("f1_micro"),
        F.avg(F.when(present, F.col("f1"))).alias("f1_macro"),
        _ratio(F.sum(F.col("f1") * weight), F.sum(weight)).alias("f1_weighted"),
    )


def prefix_blocks(cells: DataFrame, n: int) -> DataFrame:
    """Cells whose two codes share their first `n` characters, with that prefix."""
    block = F.substring(F.col("truth").cast("string"), 1, n)
    return cells.where(block == F.substring(F.col("pred").cast("string"), 1, n)).withColumn(
        "block", block
    )


def worst_classes(
    cells: DataFrame,
    by: str = "recall",
    descriptions: DataFrame | None = None,
    train_counts: DataFrame | None = None,
    min_support: int = 5,
    classes: int = 5,
    partners: int = 5,
    width: int = 30,
) -> DataFrame:
    """The worst classes by `recall` or `precision` and the classes they are most mixed up with.

    `descriptions` is `(label, description)`, `train_counts` is `(label, train_n)`.
    """
    scored = class_scores(cells).where(F.col("support") > min_support)
    worst = (
        scored.select("label", F.col(by).alias("score"), "support", "predicted")
        .orderBy("score", "label")
        .limit(classes)
    )
    own, other, total = (
        ("truth", "pred", "support") if by == "recall" else ("pred", "truth", "predicted")
    )
    mixed = cells.select(F.col(own).alias("label"), F.col(other).alias("partner"), "n").join(
        worst, "label"
    )
    out = (
        top_per_group(mixed, ["label"], [F.desc("n"), F.col("partner")], partners, rank="rank")
        .withColumn("proportion", _ratio(F.col("n"), F.col(total)))
        .select("label", "score", F.col("support").alias("test_n"), "rank", "partner", "proportion")
    )
    if train_counts is not None:
        out = out.join(train_counts.select("label", "train_n"), "label", "left")
    if descriptions is not None:
        names = descriptions.select(
            F.col("label").alias("partner"), truncate(F.col("description"), width).alias("partner_name")
        )
        out = out.join(names, "partner", "left")
    return out


def disagreement(df: DataFrame, truth: str, first: str, second: str) -> DataFrame:
    """By class: rows where two predictions differ and the first one is right."""
    return (
        df.where((F.col(first) != F.col(second)) & (F.col(first) == F.col(truth)))
        .groupBy(truth)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights scaled to mean 1, and `n / (classes · n_class)` weights."""
    counts = cut_lineage(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")))
    inverse = counts.agg(F.sum(1 / F.col("n"))).scalar()
    classes = counts.agg(F.count(F.lit(1))).scalar()
    rows = counts.agg(F.sum("n")).scalar()
    return counts.select(
        label,
        "n",
        (classes / (F.col("n") * inverse)).alias("inverse_weight"),
        (rows / (classes * F.col("n"))).alias("balanced_weight"),
    )
