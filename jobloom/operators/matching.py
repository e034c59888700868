"""Title matching in layers, and string distances between titles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.text import SEGMENT_BREAK, let, trimmed
from jobloom.operators.ranking import first_per_group, top_per_group
from jobloom.session import cut_lineage

Matcher = Callable[[DataFrame], DataFrame]
MATCH_COLUMNS = ("code", "assigned_title")
# Fuzzy titles: edits that pieces are tried for, length of a letter run, runs for a first bound, runs beyond those needed.
NEAR, RUN, FIRST_RUNS, SPARE_RUNS = 2, 3, 3, 4


def exact_matcher(lookup: DataFrame) -> Matcher:
    """Titles equal to a lookup title. Input and lookup titles are lower-case."""
    known = lookup.where(F.col("code").isNotNull()).select("title", "code")

    def match(df: DataFrame) -> DataFrame:
        return df.join(known, "title").withColumn("assigned_title", F.col("title"))

    return match


def title_segments(title: Column) -> Column:
    """Trimmed pieces between punctuation marks."""
    return F.array_distinct(F.transform(F.split(title, SEGMENT_BREAK), lambda s: trimmed(s)))


def segment_matcher(lookup: DataFrame, order: str = "ord") -> Matcher:
    """The longest lookup title that equals a piece of the title; ties by lookup order.

    Each distinct title is matched once, on an equi join, and the result joined back.
    """
    known = lookup.select(
        F.col("title").alias("__segment"), "code", F.col(order).alias("__ord")
    )

    def match(df: DataFrame) -> DataFrame:
        pieces = (
            df.select("title")
            .distinct()
            .select("title", F.explode(title_segments(F.col("title"))).alias("__segment"))
            # Titles that end in a mark would all meet under the empty piece.
            .where("__segment <> ''")
        )
        best = first_per_group(
            pieces.join(known, "__segment"),
            ["title"],
            [F.length("__segment").desc(), F.col("__ord")],
        ).where(F.col("code").isNotNull())
        found = best.select("title", "code", F.col("__segment").alias("assigned_title"))
        return df.join(found, "title")

    return match


def layered_matcher(
    matchers: Sequence[Matcher], row_id: str, layer: str = "layer"
) -> Matcher:
    """Run matchers in order; each sees only the rows no earlier one matched.

    What a layer finds and what it leaves are stored once, so the work grows with the layers and no
    layer is worked out again for the next.
    """

    def match(df: DataFrame) -> DataFrame:
        rest, matched = df, None
        for i, m in enumerate(matchers, 1):
            found = m(rest).withColumn(layer, F.lit(i))
            if i < len(matchers):
                found = cut_lineage(found)
            matched = (
                found if matched is None else matched.unionByName(found, allowMissingColumns=True)
            )
            if i < len(matchers):
                rest = cut_lineage(rest.join(found.select(row_id), row_id, "left_anti"))
        return matched

    return match


def match_rate(matched: DataFrame, total: DataFrame) -> DataFrame:
    """Rows per layer and overall share matched."""
    n = total.agg(F.count(F.lit(1))).scalar()
    return matched.agg(
        F.count(F.lit(1)).alias("matched"), (F.count(F.lit(1)) / n).alias("match_rate")
    )


def _pieces(text: Column, parts: int) -> Column:
    """Cut a text into `parts` runs of almost equal length: (part, start, piece)."""
    size = F.length(text)
    base = F.floor(size / parts)
    longer = size - base * parts  # the last `longer` pieces have one more character
    first_long = F.lit(parts) - longer

    def piece(i: Column) -> Column:
        start = i * base + F.greatest(i - first_long, F.lit(0)) + 1
        width = base + F.when(i >= first_long, 1).otherwise(0)
        return F.struct(
            i.alias("part"),
            start.cast("int").alias("start"),
            F.substr(text, start.cast("int"), width.cast("int")).alias("piece"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), piece)


def _places(part: Column, start: Column, shift: Column, max_edits: int) -> Column:
    """Where piece `part` of a partner may sit in a title that is `shift` characters longer.

    Counted from the left, the pieces before it took at most `part` edits; counted from the right,
    those behind it took at most `max_edits - part`. Some unchanged piece satisfies both.
    """
    low = F.greatest(start - part, start + shift - (max_edits - part))
    high = F.least(start + part, start + shift + (max_edits - part))
    return F.when(low <= high, F.sequence(low, high))


def fuzzy_matcher(
    lookup: DataFrame, max_edits: int | None = None, order: str = "ord", exclude_equal: bool = False
) -> Matcher:
    """Closest lookup title by edits; ties by lookup order. With `max_edits`, none that is further away.

    Without a limit every title gets its best lookup title: what `NEAR` edits reach is looked up by
    pieces (see `within_edits`), the rest is searched by letter runs (see `best_titles`).
    """
    near = NEAR if max_edits is None else max_edits

    def match(df: DataFrame) -> DataFrame:
        titles = df.select("title").where(F.col("title").isNotNull()).distinct()
        found = within_edits(titles, lookup, near, order, exclude_equal)
        if max_edits is None:
            found = cut_lineage(found)
            rest = cut_lineage(titles.join(found, "title", "left_anti"))
            found = found.unionByName(best_titles(rest, lookup, order, exclude_equal))
        return df.join(found, "title")

    return match


def within_edits(titles: DataFrame, lookup: DataFrame, max_edits: int, order: str, exclude_equal: bool) -> DataFrame:
    """(title, code, assigned_title, edits) of the distinct titles that have a lookup title within `max_edits`.

    A lookup title cut into `max_edits + 1` pieces must show one of them unchanged in any title
    that near, moved by a few places. Joining on (length, part, piece) therefore
    finds every partner without comparing all titles; the edit distance is checked inside the join.
    """
    parts = max_edits + 1
    known = (
        lookup.where(F.length("title") >= parts)
        .select(
            F.col("title").alias("__known"),
            "code",
            F.col(order).alias("__ord"),
            F.length("title").alias("__len"),
            F.explode(_pieces(F.col("title"), parts)).alias("__p"),
        )
        .select("__known", "code", "__ord", "__len", "__p.part", "__p.start", "__p.piece")
    )
    short = lookup.where(F.length("title") < parts).select(
        F.col("title").alias("__known"), "code", F.col(order).alias("__ord"), F.length("title").alias("__len")
    )

    # Probe: for every partner length, the places where each of its pieces may sit.
    by_length = titles.select(
        "title",
        F.explode(
            F.sequence(
                F.greatest(F.length("title") - max_edits, F.lit(parts)),
                F.greatest(F.length("title") + max_edits, F.lit(parts)),
            )
        ).alias("__len"),
    ).where(F.abs(F.col("__len") - F.length("title")) <= max_edits)
    base = F.floor(F.col("__len") / parts)
    first_long = F.lit(parts) - (F.col("__len") - base * parts)
    probes = (
        by_length.select(
            "title", "__len", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        )
        .select(
            "title",
            "__len",
            "part",
            (F.col("part") * base + F.greatest(F.col("part") - first_long, F.lit(0)) + 1)
            .cast("int")
            .alias("__start"),
            (base + F.when(F.col("part") >= first_long, 1).otherwise(0))
            .cast("int")
            .alias("__width"),
        )
        .select(
            "title",
            "__len",
            "part",
            "__width",
            F.explode(_places(F.col("part"), F.col("__start"), F.length("title") - F.col("__len"), max_edits)).alias(
                "__at"
            ),
        )
        .where(
            (F.col("__at") >= 1) & (F.col("__at") + F.col("__width") - 1 <= F.length("title"))
        )
        .select(
            "title",
            "__len",
            "part",
            F.substr("title", F.col("__at"), F.col("__width")).alias("piece"),
        )
        .distinct()
    )
    near = F.levenshtein("title", "__known", max_edits)
    different = F.col("title") != F.col("__known") if exclude_equal else F.lit(True)
    keys = ["__len", "part", "piece"]
    k = known.select(*[F.col(c).alias(f"k_{c}") for c in keys], "__known", "code", "__ord")
    on = [F.col(c) == F.col(f"k_{c}") for c in keys]
    pairs = probes.join(k, [*on, near >= 0, different]).select(
        "title", "__known", "code", "__ord"
    )
    # Lookup titles too short to be cut: compare on equal length, they are few by nature.
    tiny = short.select("__known", "code", "__ord", F.col("__len").alias("k_len"))
    tiny_probe = titles.select(
        "title",
        F.explode(
            F.sequence(F.length("title") - max_edits, F.length("title") + max_edits)
        ).alias("__len"),
    ).where(F.length("title") < parts + max_edits)
    tiny_pairs = tiny_probe.join(
        tiny, [F.col("__len") == F.col("k_len"), near >= 0, different]
    ).select("title", "__known", "code", "__ord")
    scored = pairs.unionByName(tiny_pairs).withColumn("edits", F.levenshtein("title", "__known"))
    best = first_per_group(scored, ["title"], [F.col("edits"), F.col("__ord")])
    return best.select("title", "code", F.col("__known").alias("assigned_title"), "edits")


def letter_runs(title: Column) -> Column:
    """Runs of `RUN` letters of a title with marks before and after it; repeated runs are numbered, so that all differ."""
    marked = F.concat(F.lit("\x02" * (RUN - 1)), title, F.lit("\x03" * (RUN - 1)))
    runs = let(marked, lambda m: F.transform(F.sequence(F.lit(1), F.length(m) - RUN + 1), lambda i: F.substr(m, i, F.lit(RUN))))

    def numbered(all_runs: Column) -> Column:
        return F.transform(
            all_runs,
            lambda r, i: F.concat(r, F.size(F.filter(F.slice(all_runs, F.lit(1), i + 1), lambda other: other == r)).cast("string")),
        )

    return let(runs, numbered)


def best_titles(titles: DataFrame, lookup: DataFrame, order: str, exclude_equal: bool) -> DataFrame:
    """(title, code, assigned_title, edits): the closest lookup title of each of the distinct titles, however far.

    An edit changes `RUN` letter runs at most. Lookup titles are indexed by their runs, and a title's runs
    are taken rarest first:

    1. Lookup titles that share one of its `FIRST_RUNS` rarest known runs are scored; the best is a bound `k`.
    2. A lookup title within `k` edits lacks `RUN * k` of the title's runs at most, so it has one of any
       `RUN * k + 1`. Those that have enough of the `RUN * k + SPARE_RUNS` rarest, and fit by length, are scored.
    3. Where the title has no more than `RUN * k` runs, a title without any of them may still be as close:
       lookup titles of fitting lengths are scored. This happens to titles unlike all lookup titles.

    Each step stores what it found, and the bound only falls.
    """
    known = lookup.select(F.col("title").alias("__known"), "code", F.col(order).alias("__ord"), F.length("title").alias("__len")).where("__known is not null")
    known = cut_lineage(known.groupBy("__known", "__len").agg(F.min(F.struct("__ord", "code")).alias("c")).select("__known", "__len", "c.code", "c.__ord"))
    index = cut_lineage(known.select("__known", "__len", F.explode(letter_runs(F.col("__known"))).alias("run")))
    often = index.groupBy("run").agg(F.count(F.lit(1)).alias("often"))
    runs = titles.select("title", F.explode(letter_runs(F.col("title"))).alias("run")).join(often, "run", "left")
    rarest = Window.partitionBy("title").orderBy(F.coalesce("often", F.lit(0)), "run")
    runs = cut_lineage(runs.select("title", "run", F.col("often").isNotNull().alias("known"), F.row_number().over(rarest).alias("place")))

    def scored(pairs: DataFrame) -> DataFrame:
        """The best of each title among pairs (title, __known)."""
        if exclude_equal:
            pairs = pairs.where("title <> __known")
        rows = pairs.join(known.drop("__len"), "__known").select(
            "title", F.struct(F.levenshtein("title", "__known").alias("edits"), "__ord", "__known", "code").alias("best")
        )
        return rows.groupBy("title").agg(F.min("best").alias("best"))

    def better(bests: DataFrame) -> DataFrame:
        return cut_lineage(bests.groupBy("title").agg(F.min("best").alias("best")))

    of_known = Window.partitionBy("title").orderBy("place")
    first = runs.where("known").withColumn("nth", F.row_number().over(of_known)).where(F.col("nth") <= FIRST_RUNS)
    bound = cut_lineage(scored(first.join(index, "run").select("title", "__known").distinct()))

    k, own = F.col("best.edits"), F.length("title") + RUN - 1
    taken = F.least(own, RUN * k + SPARE_RUNS)
    wide = runs.join(bound, "title").where(F.col("known") & (F.col("place") <= taken)).select("title", "run", k.alias("k"))
    shared = (
        wide.join(index, "run")
        .where(F.abs(F.col("__len") - F.length("title")) <= F.col("k"))
        .groupBy("title", "k", "__known")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.least(own, RUN * F.col("k") + SPARE_RUNS) - F.col("n") <= RUN * F.col("k"))
    )
    bound = better(bound.unionByName(scored(shared.select("title", "__known"))))

    # No bound: a lookup title of no more letters is at most as many edits away as the title has, else as the shortest has.
    shortest = known.agg(F.min("__len").alias("shortest"))
    open_ = titles.join(bound, "title", "left").crossJoin(shortest).select(
        "title", F.coalesce(k, F.greatest(F.length("title"), "shortest")).alias("k"), own.alias("own")
    ).where(F.col("own") <= RUN * F.col("k"))
    lengths = open_.select("title", F.explode(F.sequence(F.greatest(F.length("title") - F.col("k"), F.lit(0)), F.length("title") + F.col("k"))).alias("__len"))
    bound = better(bound.unionByName(scored(lengths.join(known.select("__len", "__known"), "__len").select("title", "__known"))))
    return bound.select("title", "best.code", F.col("best.__known").alias("assigned_title"), "best.edits")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two word arrays, row by row of its table."""

    def length(other: Column) -> Column:
        zeros = F.array_repeat(F.lit(0), F.size(other) + 1)

        def row(prev: Column, word: Column) -> Column:
            def cell(cur: Column, j: Column) -> Column:
                hit = F.element_at(prev, j) + 1
                miss = F.greatest(F.element_at(prev, j + 1), F.element_at(cur, -1))
                same = F.element_at(other, j) == word
                return F.array_append(cur, F.when(same, hit).otherwise(miss))

            return F.aggregate(F.sequence(F.lit(1), F.size(other)), F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(a, zeros, row), -1)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), let(b, length)).otherwise(0)


def subsequence_distance(a: Column, b: Column) -> Column:
    """`1 - LCS / longer length` on word arrays."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 0.0).otherwise(1 - common_subsequence(a, b) / longest)


def rerank_titles(
    predicted: DataFrame, lookup: DataFrame, row_id: str, codes: str, n: int = 5, order: str = "ord"
) -> DataFrame:
    """Among the lookup titles of each row's predicted codes, the `n` closest to its title.

    A title is compared once per code, however many rows carry it, and keeps its `n` best there;
    the rows only merge those.
    """
    wanted = predicted.select(row_id, "title", F.explode(codes).alias("code"))
    known = lookup.select("code", F.col("title").alias("candidate"), F.col(order).alias("__ord"))
    scored = (
        wanted.select("title", "code")
        .distinct()
        .join(known, "code")
        .withColumn("distance", subsequence_distance(F.split("candidate", " "), F.split("title", " ")))
    )
    by = [F.col("distance"), F.col("__ord")]
    best = top_per_group(scored, ["title", "code"], by, n)
    return top_per_group(wanted.join(best, ["title", "code"]), [row_id], by, n, rank="rank").drop("__ord")
