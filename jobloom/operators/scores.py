"""Class scores in long form `(doc, code, p)`: roll-up to prefixes, best classes, hit rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.codes import code_digits
from jobloom.operators.ranking import first_per_group, top_per_group


def text_prefix(code: Column, n: int) -> Column:
    return F.substring(code_digits(code.cast("string")), 1, n)


def normalize_scores(
    scores: DataFrame, doc: str = "doc_id", score: str = "score", p: str = "p"
) -> DataFrame:
    """Scores as shares of each document's total. A document has at most one row per class."""
    total = F.sum(score).over(Window.partitionBy(doc))
    return scores.withColumn(p, F.try_divide(F.col(score), total))


def bubble_up(
    scores: DataFrame, n: int, doc: str = "doc_id", code: str = "code", p: str = "p"
) -> DataFrame:
    """Sum of `p` over the codes that share their first `n` digits."""
    return (
        scores.withColumn(code, text_prefix(F.col(code), n))
        .groupBy(doc, code)
        .agg(F.sum(p).alias(p))
    )


def best_class(
    scores: DataFrame, doc: str = "doc_id", code: str = "code", p: str = "p"
) -> DataFrame:
    """Most probable class per document; ties go to the smallest code."""
    return first_per_group(scores, [doc], [F.col(p).desc(), F.col(code)])


def best_classes(
    scores: DataFrame, n: int, doc: str = "doc_id", code: str = "code", p: str = "p"
) -> DataFrame:
    """The `n` most probable classes per document with their rank."""
    return top_per_group(scores, [doc], [F.col(p).desc(), F.col(code)], n, rank="rank")


def bubble_up_predict(
    scores: DataFrame,
    n: int = 3,
    top: int | None = None,
    doc: str = "doc_id",
    code: str = "code",
    p: str = "p",
) -> DataFrame:
    """Prediction of any score table at prefix level: the best class, or the `top` best."""
    rolled = bubble_up(scores, n, doc, code, p)
    return best_class(rolled, doc, code, p) if top is None else best_classes(rolled, top, doc, code, p)


def bubble_up_accuracy(
    scores: DataFrame, truth: DataFrame, n: int, doc: str = "doc_id", code: str = "code", p: str = "p"
) -> DataFrame:
    """Share of documents whose best prefix is the prefix of their true code."""
    predicted = best_class(bubble_up(scores, n, doc, code, p), doc, code, p)
    joined = predicted.select(doc, F.col(code).alias("__pred")).join(
        truth.select(doc, text_prefix(F.col(code), n).alias("__true")), doc
    )
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("__pred") == F.col("__true")).cast("double")).alias("accuracy"),
    )


def multi_label_hit_rate(
    truth: DataFrame, predicted: DataFrame, doc: str = "doc_id", code: str = "code"
) -> DataFrame:
    """Share of the documents in `truth` with any true code among the predicted ones."""
    hits = truth.select(doc, code).join(predicted.select(doc, code), [doc, code], "left_semi")
    flags = (
        truth.select(doc)
        .distinct()
        .join(hits.select(doc).distinct().withColumn("__hit", F.lit(1.0)), doc, "left")
    )
    return flags.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce("__hit", F.lit(0.0))).alias("hit_rate"),
    )


def predictions_report(
    scores: DataFrame,
    classes: Sequence[str],
    doc: str = "doc_id",
    code: str = "code",
    p: str = "p",
) -> DataFrame:
    """One row per document: its best class (as `best_class`) and one probability column per class; null documents go.

    All of it is one aggregate. The best row is a struct, so Spark aggregates rows sorted by document one
    document after another and holds no table of them; rows of `normalize_scores` come sorted already.
    """
    least = F.min(F.struct(F.col(p).isNull(), ~F.isnan(p), (-F.col(p)).alias("less"), F.col(code).alias("top_class")))
    sums = [F.coalesce(F.sum(F.when(F.col(code) == c, F.col(p))), F.lit(0.0)).alias(f"p_{c}") for c in classes]
    report = scores.where(F.col(doc).isNotNull()).groupBy(doc).agg(least.alias("__best"), *sums)
    return report.select(doc, F.col("__best")["top_class"].alias("top_class"), *[f"`p_{c}`" for c in classes])


def class_list(df: DataFrame, column: str, limit: int = 4096) -> list[str]:
    """Sorted distinct class names, for pivots. Refuses columns that are not a class set."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} classes")
    return sorted(r[0] for r in rows)


def class_correlation(
    scores: DataFrame, classes: Sequence[str], doc: str = "doc_id", code: str = "code", p: str = "p"
) -> DataFrame:
    """Correlation of every two class-probability columns; a missing class counts as 0.

    A document adds the products of the classes it has, summed task by task; the result has a row per
    pair of the given classes.
    """
    n = scores.select(doc).distinct().agg(F.count(F.lit(1))).scalar().cast("double")
    known = scores.where(F.col(code).isin(*classes))
    per_doc = known.groupBy(doc, code).agg(F.sum(p).alias("p"))
    sums = per_doc.groupBy(F.col(code).alias("c")).agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    rows = per_doc.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(code).alias("c"), "p"))).alias("row"))
    # The classes behind each class of a document, which has each once.
    products = F.flatten(
        F.transform(
            "row",
            lambda x, i: F.transform(
                F.slice("row", i + 2, F.size("row")),
                lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b"), (x["p"] * y["p"]).alias("xy")),
            ),
        )
    )
    together = rows.select(F.explode(products).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.xy").alias("sab"))
    names = scores.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in sorted(set(classes))])).alias("a"))
    grid = names.join(names.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    full = (
        grid.join(sums.select(F.col("c").alias("a"), F.col("s").alias("sa"), F.col("ss").alias("ssa")), "a", "left")
        .join(sums.select(F.col("c").alias("b"), F.col("s").alias("sb"), F.col("ss").alias("ssb")), "b", "left")
        .join(together, ["a", "b"], "left")
    )
    var = (n * F.col("ssa") - F.col("sa") ** 2) * (n * F.col("ssb") - F.col("sb") ** 2)
    cov = n * F.coalesce("sab", F.lit(0.0)) - F.col("sa") * F.col("sb")
    return full.select(
        F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.when(var > 0, cov / F.sqrt(var)).alias("corr")
    )
