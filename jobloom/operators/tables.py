"""Lookups, crosswalks, duplicate handling and support filters on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.operators.ranking import first_per_group
from jobloom.session import cut_lineage


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive value, computed once per row; rows where it is null are left out.

    A filter on a plain column would be pushed below it and compute the value again.
    """
    return df.withColumn(name, F.explode(F.array_compact(F.array(value))))


def describe(
    df: DataFrame, lookup: DataFrame, code: str, description: str, name: str
) -> DataFrame:
    """Description of `df[code]`; codes the lookup does not know stand for themselves.

    `lookup` holds `(code, description)` with unique codes.
    """
    names = lookup.select(F.col(code).alias("__code"), F.col(description).alias("__desc"))
    return (
        df.join(names, F.col(code) == F.col("__code"), "left")
        .withColumn(name, F.coalesce("__desc", F.col(code).cast("string")))
        .drop("__code", "__desc")
    )


def attach_crosswalk(
    dictionary: DataFrame, crosswalk: DataFrame, left: str, right: str
) -> DataFrame:
    """Left join that keeps the many-to-many fan-out."""
    return dictionary.join(crosswalk, dictionary[left] == crosswalk[right], "left")


def translate_codes(
    df: DataFrame, crosswalk: DataFrame, code: str, source: str, target: str, order: Sequence[Column]
) -> DataFrame:
    """Replace `df[code]` through the crosswalk's first row per source code; unmapped rows go."""
    first = first_per_group(crosswalk, [source], order).where(F.col(target).isNotNull())
    pairs = first.select(F.col(source).alias(code), F.col(target).alias("__target"))
    return df.join(pairs, code).drop(code).withColumnRenamed("__target", code)


def distinct_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key list, the first in the given order."""
    return first_per_group(df, keys, order)


def unambiguous_titles(
    titles: DataFrame, title: str = "title", code: str = "code", order: Sequence[Column] = ()
) -> DataFrame:
    """Rows whose lower-case title carries exactly one code.

    (code, title) duplicates go first, while the case still counts, so two spellings of one title
    make it ambiguous.
    """
    if order:
        single = first_per_group(titles, [code, title], order)
    else:
        single = titles.dropDuplicates([code, title])
    lowered = single.withColumn(title, F.lower(title))
    clear = lowered.groupBy(title).agg(F.count(code).alias("__n")).where(F.col("__n") == 1)
    return lowered.join(clear.select(title), title, "left_semi")


def upsert_latest(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Last write per key; `order` lists the newest first and must be total."""
    return first_per_group(df, [key], order)


def frequent_classes(df: DataFrame, column: str, at_least: int = 10) -> DataFrame:
    """Rows whose class is not null and has at least `at_least` rows."""
    keep = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= at_least)
    return df.join(keep.select(column), column, "left_semi")


# Fixed values: (least rows, least partners) of the four passes, both exclusive.
SUPPORT_PASSES = ((15, 5), (15, 5), (10, 3), (10, 3))


def mutual_support(
    df: DataFrame, a: str, b: str, passes: Sequence[tuple[int, int]] = SUPPORT_PASSES
) -> DataFrame:
    """Rows whose `a` and `b` support each other, filtered alternately by `a` and `b`.

    The passes need only the counts per (a, b) pair, so they run on that much smaller table, where
    every row of a key is another partner; the rows themselves are filtered once, at the end.
    """
    pairs = cut_lineage(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("__n")))
    for i, (rows, partners) in enumerate(passes):
        key = a if i % 2 == 0 else b
        kept = (
            pairs.groupBy(key)
            .agg(F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__partners"))
            .where((F.col("__rows") > rows) & (F.col("__partners") > partners))
        )
        pairs = pairs.join(kept.select(key), key, "left_semi")
        if i % 2:
            # Each pass reads the one before twice.
            pairs = cut_lineage(pairs)
    kept = pairs.select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    same = [F.col(a) == F.col("__a"), F.col(b).eqNullSafe(F.col("__b"))]
    return df.join(kept, same, "left_semi")


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The `n` most frequent values, ties by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )


def top_cross_section(df: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    """Rows whose `a` and `b` are both among the `n` most frequent."""
    return df.join(top_values(df, a, n).select(a), a, "left_semi").join(
        top_values(df, b, n).select(b), b, "left_semi"
    )


def common_keys(key: str, *tables: DataFrame) -> DataFrame:
    """Keys present in every table."""
    keys = tables[0].select(key).distinct()
    for t in tables[1:]:
        keys = keys.intersect(t.select(key))
    return keys


def stack_labelled(tables: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """Union of tables with the name of each as a column."""
    out = None
    for name, t in tables.items():
        part = t.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def training_set(
    dictionary: DataFrame | None, tasks: DataFrame | None, columns: Sequence[str]
) -> DataFrame:
    """Union of dictionary texts and task texts; either may be left out."""
    parts = [t.select(*columns) for t in (dictionary, tasks) if t is not None]
    if not parts:
        raise ValueError("need dictionary texts, task texts or both")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
