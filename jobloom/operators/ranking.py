"""Ranks, picks and samples per group that never bring a whole group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.session import cut_lineage

HASH_DIGITS = 3  # 4 096 slices per group when the order is a hash


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
) -> DataFrame:
    """First `n` rows of each group. `row_number() <= n` lets Spark cut every group to `n` rows
    per task before the shuffle, so a hot group stays small."""
    name = rank or "__rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return out.withColumn(name, F.col(name).cast("bigint")) if rank else out.drop(name)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def first_values(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """First non-null value of every column on its own, in the given order."""
    position = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in values]
    return df.groupBy(*keys).agg(*picks)


def hash_order(key: Column | str, seed: str = "") -> Column:
    """Pseudo-random order that any engine reproduces."""
    return F.md5(F.concat(F.lit(seed), _col(key).cast("string")))


def sliced_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column,
    name: str = "rank",
) -> DataFrame:
    """`row_number()` over whole groups, computed in slices.

    `slice_by` must not decrease along `order`. Rows are numbered inside (group, slice) and moved
    up by the rows in earlier slices, so the largest unit of work is one slice, not one group.
    There may be thousands of slices per group, so their offsets are merged in, not sent around; first
    slices have none. Group and slice are one struct, which equals another with the same nulls: numbering
    and merging share one shuffle and one sort of the rows. `order` is worked out after that shuffle.
    """
    unit = F.struct(*[F.col(k) for k in keys], slice_by.alias("__slice"))
    sliced = df.withColumn("__unit", unit)
    group = [F.col("__unit")[k] for k in keys]
    before = Window.partitionBy(*group).orderBy(F.col("__unit")["__slice"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("__unit")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(F.col("__unit").alias("__of"), F.sum("__n").over(before).alias("__before"))
        .where(F.col("__before") > 0)
    )
    # Keys travel in the struct alone and are taken out of it behind the shuffle.
    carried = [c for c in df.columns if c not in keys]
    dealt = sliced.select("__unit", *carried).repartition("__unit").select("*", *[F.col("__unit")[k].alias(k) for k in keys])
    local = dealt.withColumn("__local", F.row_number().over(Window.partitionBy("__unit").orderBy(*order)))
    rank = (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("bigint")
    ranked = local.join(offsets.hint("merge"), F.col("__unit") == F.col("__of"), "left").withColumn(name, rank)
    return ranked.select(*dict.fromkeys([*df.columns, name]))


def hash_rank(
    df: DataFrame, keys: Sequence[str], key: str, seed: str = "", name: str = "rank"
) -> DataFrame:
    """Rank inside each group in pseudo-random order of `key`, which must be unique there."""
    order = hash_order(key, seed)
    slice_by = F.conv(F.substring(order, 1, HASH_DIGITS), 16, 10).cast("int")
    return sliced_rank(df, keys, [order, F.col(key)], slice_by, name)


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """`(value, 0-based index)` over the sorted distinct values.

    The values are range-partitioned and stored, so that the per-partition offsets cannot change.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    parts = cut_lineage(values.repartitionByRange(column).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    local = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    return (
        parts.withColumn("__local", local)
        .join(offsets, "__part")
        .select(column, (F.col("__local") - 1 + F.col("__before")).cast("bigint").alias(name))
    )


def nested_local_id(
    df: DataFrame, group: str, nested: str, position: str, name: str, slice_rows: int = 65_536
) -> DataFrame:
    """1-based id of each nested key in order of its first position inside the group."""
    firsts = df.groupBy(group, nested).agg(F.min(position).alias("__first"))
    ids = sliced_rank(
        firsts,
        [group],
        [F.col("__first"), F.col(nested)],
        F.floor(F.col("__first") / slice_rows),
        name,
    ).drop("__first")
    return df.join(ids, [group, nested])


def random_local_id(
    df: DataFrame, keys: Sequence[str], key: str, seed: str, name: str
) -> DataFrame:
    """Shuffled 1..n inside each group."""
    return hash_rank(df, keys, key, seed, name)


def stratified_sample(
    df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str = "1"
) -> DataFrame:
    """`n` rows per stratum in hash order; strata that do not exceed `n` rows give none."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > n)
    picked = top_per_group(df, strata, [hash_order(key, seed), F.col(key)], n)
    return picked.join(sizes.drop("__size"), list(strata), "left_semi")


def random_sample(df: DataFrame, key: str, n: int, seed: str = "1") -> DataFrame:
    """`n` rows in hash order (a distributed top-n)."""
    return df.orderBy(hash_order(key, seed), F.col(key)).limit(n)


def is_train(key: Column | str, share: float = 0.75, seed: str = "") -> Column:
    """True for a `share` of the hash space (in 1/256 steps)."""
    return F.substring(hash_order(key, seed), 1, 2) < f"{round(share * 256):02x}"


def hash_fold(key: Column | str, folds: int, seed: str = "") -> Column:
    """Fold number 0..folds-1 from the key's hash."""
    return (F.conv(F.substring(hash_order(key, seed), 1, 4), 16, 10).cast("int") % folds).cast("int")


def assign_slots(
    groups: dict[int, DataFrame],
    key: str,
    workers: int,
    pattern: Sequence[int],
    seed: str = "1",
) -> DataFrame:
    """Deal items to `workers`, each with `len(pattern)` slots.

    `pattern[j]` names the group slot `j` draws from. A group is dealt from its end and starts over
    when it is used up, so draw `k` of a group of size `m` is its row `m - (k - 1) mod m`.
    """
    order = list(pattern)
    spark = next(iter(groups.values())).sparkSession
    per_group = {g: order.count(g) for g in groups}
    seen: dict[int, int] = {g: 0 for g in groups}
    slots = []
    for j, g in enumerate(order):
        seen[g] += 1
        slots.append((j, g, seen[g], per_group[g]))
    slot_table = F.explode(
        F.array(
            *[
                F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("slot", "grp", "nth", "per"), s)])
                for s in slots
            ]
        )
    )
    draws = (
        spark.range(1, workers + 1)
        .select(F.col("id").alias("worker_id"), slot_table.alias("s"))
        .select(
            "worker_id",
            F.col("s.slot").alias("slot"),
            F.col("s.grp").alias("grp"),
            ((F.col("worker_id") - 1) * F.col("s.per") + F.col("s.nth")).alias("draw"),
        )
    )
    out = None
    for g, items in groups.items():
        ranked = hash_rank(items.select(key), [], key, seed, "__pos")
        size = items.agg(F.count(F.lit(1))).scalar()
        wanted = draws.where(F.col("grp") == g).withColumn(
            "__pos", size - F.pmod(F.col("draw") - 1, size)
        )
        dealt = wanted.join(ranked, "__pos").select("worker_id", "slot", key)
        out = dealt if out is None else out.unionByName(dealt)
    return out
