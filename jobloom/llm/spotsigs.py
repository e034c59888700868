"""Document fingerprints from spot signatures, with column expressions only.

A signature is a very common word (the anchor) with the chain of the next content words after it;
anchors between them are skipped. The set of a document's signatures is its fingerprint: boilerplate
without running prose adds little to it, and an edit changes only the chains around it. Fingerprints
are compared by Jaccard likeness; `near_copies` compares only sets whose lengths and rare signatures
leave room for the wanted likeness.

Defined results: a null text counts as empty; a text without a chain has one signature, all its
words; equal texts have equal fingerprints. The next document is the one with the next id (a null id
comes first, repeated ids by text), and the first after the last; a single document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Very common words of English, German, French and Spanish.
ANCHORS = tuple(
    """the of and to in a is that for on with as was by at from it be this are or an not have had
    der die das und von zu den im ist für des mit sich auf ein eine dem nicht als auch es
    de la le les et des un une du que est pour qui dans par au sur ce
    el en los las y del se por con para no una su al lo""".split()
)
CHAIN = 2
ROWS_PER_RANGE = 256
# Up to this many ranges of ids their first ids are sent to all tasks; beyond, they are joined by shuffle.
SHARED_RANGES = 1_000_000


def with_signatures(df: DataFrame, text: str, into: str, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Adds the sorted distinct signatures of column `text` as 32-bit numbers."""
    words, content = f"{into}_words", f"{into}_content"

    def is_anchor(w: Column) -> Column:
        return w.isin(*anchors)

    def signature(spot: Column, before: Column) -> Column:
        # Of the words ahead of the spot, `before` are anchors and the rest content.
        at = spot["i"] - before
        return F.when(
            at + (chain - 1) < F.size(content),
            F.hash(spot["word"], *[F.get(F.col(content), at + j) for j in range(chain)]),
        )

    spots = F.filter(
        F.transform(F.col(words), lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda s: is_anchor(s["word"])
    )
    found = F.filter(F.transform(spots, signature), lambda s: s.isNotNull())
    return (
        df.withColumn(words, F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
        .withColumn(content, F.filter(F.col(words), lambda w: ~is_anchor(w)))
        .withColumn(into, found)
        .withColumn(into, F.when(F.size(into) > 0, F.array_sort(F.array_distinct(into))).otherwise(F.array(F.hash(words))))
        .drop(words, content)
    )


def fingerprint(signatures: Column) -> Column:
    """The signatures as text: eight hex digits each, in order."""
    return F.array_join(
        F.transform(signatures, lambda s: F.lower(F.lpad(F.hex(s.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(documents: DataFrame, keep: list[str]) -> DataFrame:
    """Adds `next_<column>` for the columns in `keep`: the values of the next document by id.

    Rows are dealt by ranges of ids of about `ROWS_PER_RANGE` rows; the first row of a range is also
    the last row of the range before it, so each range finds its successors alone.
    """
    stats = documents.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = stats["low"] or 0, stats["high"] or 0
    width = max(1.0, (float(high) - float(low) + 1) * ROWS_PER_RANGE / max(1, stats["n"]))
    span = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(width)), F.lit(-1))
    docs = documents.withColumn("_range", span)
    ranges = docs.groupBy("_range").agg(F.min("doc_id").alias("_first"))
    ring = Window.orderBy("_range")
    ranges = ranges.select(
        "_range", "_first",
        F.coalesce(F.lag("_range").over(ring), F.max("_range").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"),
    )
    if stats["n"] // ROWS_PER_RANGE <= SHARED_RANGES:
        ranges = F.broadcast(ranges)
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy"))
    before = F.struct(F.col("_before").alias("range"), F.lit(1).alias("copy"))
    dealt = docs.join(ranges, "_range").withColumn(
        "_at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.array(own, before)).otherwise(F.array(own)))
    )
    order = Window.partitionBy("_at.range").orderBy("_at.copy", F.col("doc_id").asc_nulls_first(), "text")
    return (
        dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in keep])
        .filter(F.col("_at.copy") == 0)
        .drop("_range", "_first", "_before", "_at")
    )


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): its fingerprint, that of its edited text, and both likenesses.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many of the
    next document's.
    """
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chained = with_next(with_signatures(docs, "text", "sigs"), ["text", "sigs"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = (
        chained.withColumn("n_chars", n.cast("bigint"))
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
        .drop("text", "next_text")
    )
    return with_signatures(edited, "edited", "edited_sigs").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_copies(documents: DataFrame, at_least: float = 0.75) -> DataFrame:
    """Pairs (doc_a, doc_b, likeness) of documents with different signature sets at least so alike.

    Documents with equal sets are compared once, under their smallest id. A set is indexed by its
    rarest signatures only, as many as a partner must share one of, and under the length class of
    each partner it could have, so only sets of fitting lengths meet.
    """
    docs = with_signatures(documents.select("doc_id", "text"), "text", "sigs")
    sets = docs.groupBy("sigs").agg(F.min("doc_id").alias("doc")).withColumn("n", F.size("sigs"))
    parts = sets.select("doc", "n", F.explode("sigs").alias("sig"))
    rarity = parts.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # Signatures of a single set are rarest but match nothing: they only use up the prefix.
    ranked = (
        parts.join(rarity, "sig", "left")
        .groupBy("doc", "n")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sig"))).alias("ordered"))
    )
    room = F.col("n") - F.ceil(F.col("n") * at_least) + 1
    classes = F.floor(F.log("n") / F.log(F.lit(1 / at_least)))
    heads = ranked.select("doc", "n", classes.alias("class"), F.explode(F.slice("ordered", F.lit(1), room.cast("int"))).alias("head")).filter(
        "head.df > 1"
    )
    left = heads.select(F.col("doc").alias("doc_a"), F.col("n").alias("n_a"), "head.sig", F.explode(F.array("class", F.col("class") + 1)).alias("class"))
    right = heads.select(F.col("doc").alias("doc_b"), F.col("n").alias("n_b"), "head.sig", "class")
    smaller_first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_a") < F.col("doc_b")))
    pairs = left.join(right, ["sig", "class"]).filter(smaller_first & (F.col("n_a") >= at_least * F.col("n_b"))).select("doc_a", "doc_b").distinct()
    one = sets.select(F.col("doc").alias("doc_a"), F.col("sigs").alias("sigs_a"))
    two = sets.select(F.col("doc").alias("doc_b"), F.col("sigs").alias("sigs_b"))
    like = likeness(F.col("sigs_a"), F.col("sigs_b"))
    return pairs.join(one, "doc_a").join(two, "doc_b").select("doc_a", "doc_b", like.alias("likeness")).filter(F.col("likeness") >= at_least)
