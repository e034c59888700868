"""Mixing sources to target weights by hierarchical budgeting, with column expressions only.

A token budget flows down a tree (domain, language, source by default). Each node shares its budget
among its children in proportion to their weights, none above what it can supply (its tokens times
the allowed epochs); what a child can't take goes to its siblings first, and only what a whole
branch can't take goes to the branch's own siblings. Each leaf takes whole epochs and then the
prefix of one more, in an order drawn from the seed.

Defined results: a null label is a node of its own; texts without words have no tokens and come
along wherever their leaf's prefix reaches them; repeated rows count each; an empty table gives an
empty result. Shares are rounded down to whole tokens at each node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
# Rows of a leaf whose running totals one task works out; larger leaves are cut along the drawn order.
ROWS_PER_SLICE = 1_000


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """The weight of a node by its label; 1 where none is given."""
    out = F.lit(1)
    for label, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == label, F.lit(weight)).otherwise(out)
    return out.cast("bigint")


def fill(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Adds `share`: the part of `budget` each child of `parent` gets, by `weight` and up to `cap`."""
    nodes = nodes.withColumn("full_at", F.col("cap") / F.col("weight"))
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ahead = siblings.orderBy("full_at", F.col(level).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # With the children ahead full, the rest is dealt at this many tokens per weight; the highest such level holds.
    rate = (F.col("budget") - F.coalesce(F.sum("cap").over(ahead), F.lit(0))) / (
        F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    )
    return (
        nodes.withColumn("rate", rate)
        .withColumn("rate", F.max("rate").over(siblings))
        .withColumn("share", F.least("cap", F.floor(F.col("rate") * F.col("weight"))).cast("bigint"))
        .drop("full_at", "rate")
    )


def leaf_budgets(
    leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]], levels: tuple[str, ...], max_epochs: int
) -> DataFrame:
    """Per leaf its `share` of the budget. `leaves`: levels, tokens."""
    capped = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    given = capped.groupBy(levels[0]).agg(F.sum("cap").alias("cap")).withColumn("budget", F.lit(budget).cast("bigint"))
    for depth, level in enumerate(levels):
        above, path = list(levels[:depth]), list(levels[: depth + 1])
        if depth:
            nodes = capped.groupBy(*path).agg(F.sum("cap").alias("cap"))
            up = given.select(*[F.col(c).alias(f"_{c}") for c in above], F.col("share").alias("budget"))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in above]
            given = nodes.join(up, same).drop(*[f"_{c}" for c in above])
        given = fill(given.withColumn("weight", weight_of(level, weights)), above, level).drop("budget", "weight", "cap")
    return given


def drawn(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch's order, as hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix_sources(
    documents: DataFrame,
    weights: dict[str, dict[str, int]],
    budget_percent: int = 50,
    max_epochs: int = 3,
    seed: int = 17,
    levels: tuple[str, ...] = LEVELS,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of `documents` (doc_id, text and the levels): its tokens and how often the mix holds it (`copies`, 0 if not).

    Columns in `keys` come along and settle the order of rows that share an id.
    """
    rows = cut_lineage(
        documents.select("doc_id", *keys, *levels, F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens"))
    )
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shares = leaf_budgets(leaves, total * budget_percent // 100, weights, levels, max_epochs)
    plan = leaves.select(*[F.col(c).alias(f"_{c}") for c in levels], "tokens", "rows").join(
        shares, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels]
    )
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens"))).otherwise(0).cast("bigint")
    plan = plan.select(
        *[f"_{c}" for c in levels],
        epochs.alias("epochs"),
        (F.col("share") - epochs * F.col("tokens")).alias("rest"),
        F.ceil(F.col("rows") / ROWS_PER_SLICE).alias("slices"),
    )
    placed = rows.join(plan, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels]).drop(*[f"_{c}" for c in levels])
    placed = placed.withColumn("place", drawn(seed, F.col("epochs"), F.col("doc_id")))
    place = F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint")
    placed = placed.withColumn("slice", F.floor(place * F.col("slices") / F.lit(float(1 << 32))))
    slices = placed.groupBy(*levels, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    before = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *[F.col(c).alias(f"_{c}") for c in levels], F.col("slice").alias("_slice"),
        F.coalesce(F.sum("slice_tokens").over(before), F.lit(0)).alias("offset"),
    )
    running = Window.partitionBy(*levels, "slice").orderBy("place", "doc_id", "n_tokens", *keys).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels] + [F.col("slice") == F.col("_slice")]
    reached = placed.withColumn("within", F.sum("n_tokens").over(running)).join(offsets, same)
    fits = (F.col("offset") + F.col("within") <= F.col("rest")).cast("bigint")
    return reached.select("doc_id", *keys, *levels, "n_tokens", (F.col("epochs") + fits).alias("copies"))
