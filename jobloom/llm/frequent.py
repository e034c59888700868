"""The most frequent rows of a count table, without sorting it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, limit: int, column: str = "count") -> DataFrame:
    """The rows counted at least 2**k times, for the smallest k that leaves `limit` rows or fewer."""
    bits = F.length(F.bin(column)).alias("bits")
    sizes = {r["bits"]: r["n"] for r in counts.groupBy(bits).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, 64
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > limit:
            break
        least = b
    return counts.filter(F.length(F.bin(column)) >= least)
