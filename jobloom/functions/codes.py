"""Occupation codes such as `11-1011.00` and their prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import trimmed


def code_digits(code: Column) -> Column:
    return F.replace(code, F.lit("-"), F.lit(""))


def code_prefix(code: Column, n: int) -> Column:
    """First `n` characters without the dash, as int; null when they are not digits."""
    if not 1 <= n <= 6:
        raise ValueError("a code prefix has 1 to 6 digits")
    return F.substring(code_digits(code), 1, n).try_cast("int")


def code_prefix_str(code: Column, n: int = 3) -> Column:
    """Prefix as text: trimmed, without anything from the first dot on, without the dash."""
    base = F.substring_index(trimmed(code), ".", 1)
    return F.substring(code_digits(base), 1, n)


def detailed_code(code: Column) -> Column:
    """`NN-NNNN` out of `NN-NNNN.NN`."""
    return F.substring(code, 1, 7)


def numeric_code_prefix(code: Column, n: int = 3) -> Column:
    """Prefix of a code stored as a number; null stays null."""
    return F.substring(code.try_cast("bigint").cast("string"), 1, n).try_cast("int")


def in_major_group(code: Column, group: int) -> Column:
    """True where the two-digit prefix equals `group`."""
    return F.coalesce(code_prefix(code, 2) == group, F.lit(False))


def safe_int(value: Column) -> Column:
    """Integer, or null when the text is not one."""
    return value.try_cast("bigint")


def int_or_raw(value: Column) -> Column:
    """Canonical integer text where the value parses, else the raw text."""
    return F.coalesce(safe_int(value).cast("string"), value)
