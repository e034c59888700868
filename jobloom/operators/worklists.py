"""Result sets split for annotators, and text replicates per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.operators.ranking import hash_rank, nested_local_id, random_local_id

# Slots per worker, and the slots that draw from the second group.
SLOTS_PER_WORKER = 30
SECOND_GROUP_SLOTS = (3, 6, 9, 12, 15, 21)


def slot_pattern(
    slots: int = SLOTS_PER_WORKER, second: tuple[int, ...] = SECOND_GROUP_SLOTS
) -> list[int]:
    """Group of each slot: 1 for the listed slots, 0 for the others."""
    return [int(j in second) for j in range(slots)]


def split_matches(
    matches: DataFrame, documents: DataFrame, group: str, seed: str = "1", abstract: str | None = None
) -> dict[str, DataFrame]:
    """Matches `(patent_id, sent_id, pos, sentence, task_id, task, distance)` as three tables.

    All documents are kept, with the white space of column `abstract` collapsed. Sentences get ids by
    first appearance in their document, tasks shuffled ids per sentence.
    """
    kept = documents.withColumn(abstract, F.trim(F.regexp_replace(abstract, r"\s+", " "))) if abstract else documents
    ided = nested_local_id(matches, "patent_id", "sent_id", "pos", "sent_index")
    sentences = ided.select("patent_id", "sent_index", "sentence").distinct()
    tasks = random_local_id(
        ided.select("patent_id", "sent_index", "task_id", "task", "distance"),
        ["patent_id", "sent_index"],
        "task_id",
        seed,
        "task_index",
    ).drop("task_id")
    return {
        "documents": kept.withColumn("classifier_group", F.lit(group)),
        "sentences": sentences,
        "tasks": tasks,
    }


def sampled_texts(
    df: DataFrame,
    key: str,
    row_id: str,
    text: str,
    share: float = 0.33,
    replicates: int = 6,
    part_rows: int = 1000,
) -> DataFrame:
    """Concatenation of a sample of texts per key, once per replicate.

    A sample is `share` of the key's rows in a hash order seeded by the replicate. Long samples come
    as numbered parts of `part_rows` texts, in order, so that no task builds an unbounded string.
    """
    copies = df.select(
        key, row_id, text, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    ).withColumn("__id", F.concat(F.col("replicate").cast("string"), F.col(row_id).cast("string")))
    groups = [key, "replicate"]
    ranked = hash_rank(copies, groups, "__id", name="__rank")
    sizes = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(key, F.bround(F.lit(share) * F.col("__n"), 0).alias("__take"))
    )
    picked = ranked.join(sizes, key).where(F.col("__rank") <= F.col("__take"))
    parts = picked.withColumn("part", F.floor((F.col("__rank") - 1) / part_rows))
    rows = F.array_sort(F.collect_list(F.struct(F.col("__rank").alias("r"), F.col(text).alias("t"))))
    return (
        parts.groupBy(*groups, "part")
        .agg(rows.alias("__rows"))
        .select(*groups, "part", F.array_join(F.transform("__rows", lambda x: x["t"]), "").alias("content"))
    )
