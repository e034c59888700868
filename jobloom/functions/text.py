"""Text expressions. All but `cleaner`, which cuts whole batches, are native Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.clean_text import UNSURE, clean_batch

TextProcessor = Callable[[Column], Column]
Tokenizer = Callable[[Column], Column]

# The patterns and sizes that decide the results.
WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{2,}"
NOT_WORD = r"[^\p{L}\p{N}_]"
SEGMENT_BREAK = r"[^0-9a-zA-Z\s]"
SENTENCE_BREAK = r"\.\s+"
CLEAN_BREAK = r"[.!?]\s+|[\t\n]+"
MARKUP = r"<[^>]*>"
CHUNK_WORDS = 300
ELLIPSIS = "…"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, also where `body` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def label_slug(text: Column) -> Column:
    """Lower-case label with every non-word character turned into `_`."""
    return F.lower(F.regexp_replace(text, NOT_WORD, "_"))


def tabs_to_periods(text: Column) -> Column:
    return F.regexp_replace(text, "\t", ". ")


def tabs_to_spaces(text: Column) -> Column:
    return F.translate(text, "\t", " ")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, limit: int) -> Column:
    """Shorten to `limit - 2` characters plus an ellipsis where the text is longer than `limit`."""
    short = F.concat(F.substring(text, 1, limit - 2), F.lit(ELLIPSIS))
    return F.when(F.length(text) > limit, short).otherwise(text)


def word_chunks(text: Column, size: int = CHUNK_WORDS) -> Column:
    """Array of consecutive runs of `size` space-separated words."""

    def chunks(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words), F.lit(size))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))

    return let(F.split(text, " "), chunks)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def long_word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({LONG_WORD})"), F.lit(1))


def space_tokens(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of `low` to `high` tokens, joined by a space."""
    empty = F.array().cast("array<string>")

    def of_size(words: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, runs).otherwise(empty)

    return let(
        tokens, lambda words: F.flatten(F.array(*[of_size(words, n) for n in range(low, high + 1)]))
    )


def sentences(text: Column) -> Column:
    """Sentences of running text, trimmed, empty ones dropped."""
    parts = F.transform(F.split(text, SENTENCE_BREAK), lambda s: trimmed(s))
    return F.filter(parts, lambda s: s != "")


def tab_sentences(content: Column) -> Column:
    """Sentences of cleaned content, which separates them by TAB."""
    return F.filter(F.split(content, "\t"), lambda s: s != "")


def plain_words(text: Column) -> Column:
    """Lower-case text without markup and punctuation, single-spaced."""
    bare = F.regexp_replace(F.lower(text), MARKUP, " ")
    return collapse_whitespace(F.regexp_replace(bare, r"[^\p{L}\p{N}\s]", " "))


def _cleaned(bare: Column, min_tokens: int) -> Column:
    parts = F.transform(
        F.split(F.regexp_replace(bare, MARKUP, " "), CLEAN_BREAK),
        lambda s: collapse_whitespace(F.regexp_replace(s, r"[^\p{L}\p{N}\s]", " ")),
    )
    kept = F.filter(parts, lambda s: (s != "") & (F.size(F.split(s, " ")) >= min_tokens))
    return F.nullif(F.array_join(kept, "\t"), F.lit(""))


def cleaner(min_tokens: int = 4) -> TextProcessor:
    """Text to TAB-separated clean sentences of at least `min_tokens` words, null if none is left.

    The rule is this library's own: lower-case, tags removed, sentences end at `.`, `!` or `?`
    followed by whitespace or at a line break, punctuation becomes a space.

    Texts are cut batch by batch on their bytes. Only those with characters whose class depends on the
    version of Unicode go through regular expressions, so that Spark's classes decide.
    """

    def batch(texts: pa.Array) -> pa.Array:
        return clean_batch(texts, min_tokens)

    quick = F.arrow_udf(batch, "string")

    def clean(text: Column) -> Column:
        bare = F.lower(text)
        done = quick(bare)
        return F.when(done == UNSURE, _cleaned(bare, min_tokens)).otherwise(done)

    return clean


def sentence_count(text: Column) -> Column:
    return F.coalesce(F.size(F.split(text, "[.] ")), F.lit(0))


def is_cut_off(text: Column) -> Column:
    """True unless the text ends in a period."""
    return F.coalesce(F.right(text, F.lit(1)) != ".", F.lit(True))


def content_key(text: Column) -> Column:
    """Identity of a text for caches and joins."""
    return F.md5(text)


def without_first_field(line: Column) -> Column:
    """A CSV line without its first field."""
    return F.regexp_replace(line, r"^[^,]*,", "")
