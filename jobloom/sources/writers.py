"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import label_slug, tabs_to_spaces


def write_sorted_csv(df: DataFrame, path: str, key: str = "url") -> None:
    """Headed CSV whose files follow one another in key order."""
    df.orderBy(key).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_quoted(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    """Every field quoted."""
    df.write.mode("overwrite").csv(
        path, sep=sep, header=header, quoteAll=True, quote='"', escape='"'
    )


def write_lines(df: DataFrame, path: str, text: str = "content") -> None:
    """One document per line."""
    one_line = F.regexp_replace(F.col(text), r"[\r\n]+", " ")
    df.where(F.col(text).isNotNull()).select(one_line.alias("value")).write.mode("overwrite").text(path)


def labelled_line(content: Column, labels: Sequence[Column]) -> Column:
    """`content __label__a __label__b`, TABs in the content turned into spaces."""
    marks = [F.concat(F.lit("__label__"), label_slug(x)) for x in labels]
    return F.concat_ws(" ", tabs_to_spaces(content), *marks)


def write_labelled_lines(
    df: DataFrame, path: str, content: str = "content", labels: Sequence[str] = ("category", "section")
) -> None:
    line = labelled_line(F.col(content), [F.col(c) for c in labels])
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_by_group(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> None:
    """One folder per group key; a hot key is spread over the tasks that hold its rows."""
    df.write.mode("overwrite").partitionBy(key).format(fmt).save(path)
