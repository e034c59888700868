"""Term weights, vocabularies and the terms that mark a class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.text import Tokenizer, let, long_word_tokens, ngrams
from jobloom.operators.ranking import top_per_group
from jobloom.session import cut_lineage

# Fixed value: this library's own short English stop list.
STOP_WORDS = (
    "a about after all also an and any are as at be been but by can do for from had has have he her "
    "his how i if in into is it its may more most no not of on one or other our out over she should "
    "so some such than that the their them then there these they this those to under up was we were "
    "what when which who will with would you your"
).split()

DOCS_PER_TASK = 4096  # texts whose terms one task holds
LOOKUP_TERMS = 1 << 20  # most frequent terms that every task keeps, with their document frequencies


def _runs(terms: Column) -> Column:
    """Distinct terms of an array with their numbers of occurrences."""

    def counted(x: Column) -> Column:
        first = lambda i: (i == 1) | (F.get(x, i - 1) != F.get(x, i - 2))
        starts = F.filter(F.sequence(F.lit(1), F.size(x)), first)
        run = lambda at: F.transform(
            at,
            lambda s, j: F.struct(
                F.get(x, s - 1).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(x) + 1) - s).cast("bigint").alias("tf")
            ),
        )
        return let(starts, run)

    return F.when(F.size(terms) > 0, let(F.sort_array(terms), counted))


def term_counts(
    docs: DataFrame,
    doc: str,
    text: str,
    tokenizer: Tokenizer = long_word_tokens,
    low: int = 1,
    high: int = 1,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """`(doc, term, tf)`; stop words leave before n-grams are formed.

    Terms are counted row by row. Only rows that share their id are added up; all others are dealt by id
    while they are texts, so that what follows per document moves no terms.
    """
    words = tokenizer(F.lower(F.col(text)))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))

    def counted(rows: DataFrame) -> DataFrame:
        tokens = rows.select(doc, words.alias("__w"))
        terms = F.col("__w") if (low, high) == (1, 1) else ngrams(F.col("__w"), low, high)
        return tokens.select(doc, terms.alias("__t")).select(doc, F.inline(_runs(F.col("__t"))))

    ids = docs.groupBy(F.col(doc).alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    rows, several = ids.agg(F.count(F.lit(1)), F.count(F.when(F.col("__n") > 1, 1))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(1, -(-rows // (cores * DOCS_PER_TASK)))
    if not several:
        return counted(docs.repartition(parts, doc))
    same = F.col(doc).eqNullSafe(F.col("__id"))
    repeated = cut_lineage(ids.where(F.col("__n") > 1).select("__id"))
    merged = counted(docs.join(repeated, same, "left_semi")).groupBy(doc, "term").agg(F.sum("tf").alias("tf"))
    return counted(docs.join(repeated, same, "left_anti").repartition(parts, doc)).unionByName(merged)


def tfidf(
    counts: DataFrame,
    doc: str,
    n_docs: Column,
    min_df: int = 1,
    max_df: float = 1.0,
) -> DataFrame:
    """`(doc, term, tfidf)` with `idf = ln((1 + n) / (1 + df)) + 1` and unit rows.

    Terms in fewer than `min_df` documents or in more than the share `max_df` are left out.
    """
    frequency = cut_lineage(
        counts.groupBy("term")
        .agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df"))
        .where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    )
    weighted = _looked_up(counts, frequency, LOOKUP_TERMS).withColumn(
        "w", F.col("tf") * (F.ln((1 + n_docs) / (1 + F.col("df"))) + 1)
    )
    # A window over one document holds at most that document's vocabulary.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return weighted.select(doc, "term", (F.col("w") / norm).alias("tfidf"))


def _looked_up(counts: DataFrame, frequency: DataFrame, limit: int) -> DataFrame:
    """The counts of the terms in `frequency` with their `df`.

    Tasks keep the `limit` most frequent terms; only counts of other terms are moved to theirs.
    """
    if frequency.count() <= limit:
        return counts.join(F.broadcast(frequency), "term")
    top = F.broadcast(cut_lineage(frequency.orderBy(F.desc("df"), "term").limit(limit)))
    rest = frequency.join(top, "term", "left_anti")
    moved = counts.join(top, "term", "left_anti").join(rest, "term")
    return counts.join(top, "term").unionByName(moved)


def vocabulary(words: DataFrame, word: str = "word", min_count: int = 1) -> DataFrame:
    """Words that occur at least `min_count` times."""
    return (
        words.groupBy(word).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    )


def term_effects(
    values: DataFrame,
    classes: DataFrame,
    class_names: Sequence[str],
    doc: str,
    label: str,
    value: str = "tfidf",
) -> DataFrame:
    """Regression of every class indicator on every term: `(class, term, slope, t)`.

    Only sums enter: per term the sum and the sum of squares, and per (term, class) the sum inside
    the class. Documents without the term are zeros, so they enter through the document count.
    `class_names` is the class set; terms come out once per class.
    """
    sizes = classes.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).cast("double").alias("ny"))
    n = classes.agg(F.count(F.lit(1)).cast("double")).scalar()
    joined = values.join(classes.select(doc, label), doc)
    sums = joined.groupBy("term").agg(
        F.sum(value).alias("sx"),
        F.sum(F.col(value) * F.col(value)).alias("sxx"),
        *[F.sum(F.when(F.col(label) == c, F.col(value))).alias(f"c{i}") for i, c in enumerate(class_names)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("class"), F.coalesce(F.col(f"c{i}"), F.lit(0.0)).alias("sxy"))
            for i, c in enumerate(class_names)
        ]
    )
    grid = sums.select("term", "sx", "sxx", F.inline(entries)).join(sizes, "class")
    sxx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    sxy = n * F.col("sxy") - F.col("sx") * F.col("ny")
    syy = n * F.col("ny") - F.col("ny") * F.col("ny")
    r = F.try_divide(sxy, F.sqrt(F.greatest(sxx * syy, F.lit(0.0))))
    t = r * F.sqrt(F.try_divide(n - 2, F.greatest(1 - r * r, F.lit(0.0))))
    return grid.select(
        "class", "term", F.try_divide(sxy, sxx).alias("slope"), F.coalesce(t, F.lit(0.0)).alias("t")
    )


# Smallest |t| shown, and terms shown per class and sign.
MIN_T = 0.5
TERMS_SHOWN = 100


def ranked_terms(effects: DataFrame, min_t: float = MIN_T, n: int = TERMS_SHOWN) -> DataFrame:
    """Per class the `n` terms with the largest positive and negative t, scored `ln |t|`."""
    t = F.col("t")
    signed = effects.where(
        (F.abs(t) > min_t) & (F.length("term") > 1) & (F.abs(t) < float("inf")) & ~F.isnan(t)
    ).withColumn("sign", F.when(t > 0, "positive").otherwise("negative"))
    best = top_per_group(
        signed,
        ["class", "sign"],
        [F.round(F.abs(t), 9).desc(), F.col("term").desc()],
        n,
        rank="rank",
    )
    return best.select("class", "sign", "rank", "term", F.ln(F.abs(t)).alias("score"))
