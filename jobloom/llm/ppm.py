"""Language-model scores by prediction by partial matching on bytes, and a smoothed word baseline.

The model is a trie of byte contexts up to `ORDER` bytes long, counted over all training documents
(texts lower-cased in A-Z, white space as blanks, closed by an end mark). A byte is predicted by its
longest known context; where that has not seen it, an escape (method C: as many chances as distinct
successors) leads to the next shorter one, without the symbols the longer one would have given.
Shorter contexts count in how many longer ones a successor was seen.

The whole trie stays in count tables, one an order. What a byte costs depends on it and the `ORDER`
bytes before alone, so costs are looked up: those of the most frequent strings of that length (`NODES` at
most) go to all tasks; the other strings of a document are joined with the costs of all that occur. A
string that training has not seen gets its cost by joins with the tables of its shorter contexts.

The baseline needs the training count of every word. The most frequent words (`HEAD` at most) go to all tasks;
all other words of a document are joined with the counts by their 64-bit hashes.

Defined results: a null text counts as empty and has one token, its end; repeated rows are scored
each; with no training documents every word is unknown and every byte equally likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm import bytetext as bt
from jobloom.llm.frequent import most_frequent
from jobloom.llm.toxicity import held_out
from jobloom.session import workspace

ORDER = 5
NODES = 1 << 20
HEAD = 1 << 18
FOLDS, HELD = 10, 0
STRETCH = 1 << 22  # keys counted together
MERGED = 3 << 20  # distinct keys a task holds before it passes them on
END = 0x0A
END_WORD = np.uint64(0x1234567890ABCDEF)
SYMBOLS = 257
PREPARED = bt.LOWER.copy()
PREPARED[bt.SPACE] = 0x20


def word_keys(chunk: bt.Chunk, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all tokens, ends included."""
    w = bt.words(chunk, data, ~bt.SPACE)
    ends = np.full(chunk.n, END_WORD)
    return np.concatenate([bt.word_hashes(data, w), ends]), np.concatenate([w.text, np.arange(chunk.n)])


def context_keys(chunk: bt.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every byte and end mark: the byte in the lowest place, its context above; texts start after zeros."""
    n, sizes = chunk.n, np.diff(chunk.offsets)
    padded = np.zeros(len(chunk.data) + n * (ORDER + 1), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    padded[np.arange(len(chunk.data)) + (owner + 1) * ORDER + owner] = PREPARED[chunk.data]
    ends = chunk.offsets[1:] + (np.arange(n) + 1) * ORDER + np.arange(n)
    padded[ends] = END
    keys = np.zeros(len(padded), np.uint64)
    for j in range(ORDER + 1):
        keys[j:] |= padded[: len(padded) - j].astype(np.uint64) << np.uint64(8 * j)
    text = np.repeat(np.arange(n), sizes + ORDER + 1)
    begin = chunk.offsets[:-1] + np.arange(n) * (ORDER + 1)
    symbol = np.ones(len(padded), bool)
    symbol[(begin[:, None] + np.arange(ORDER)).ravel()] = False
    return keys[symbol], text[symbol]


class Tally:
    """Counts of keys in bounded memory: raw keys are counted stretch by stretch, and passed on when too many differ."""

    def __init__(self, kind: int) -> None:
        self.kind, self.raw, self.n = kind, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _merge(self) -> None:
        if self.raw:
            u, c = np.unique(np.concatenate(self.raw), return_counts=True)
            self.keys, inverse = np.unique(np.concatenate([self.keys, u]), return_inverse=True)
            self.counts = np.bincount(inverse, weights=np.concatenate([self.counts, c]), minlength=len(self.keys)).astype(np.int64)
            self.raw, self.n = [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.raw.append(keys)
        self.n += len(keys)
        if self.n >= STRETCH:
            self._merge()
            if len(self.keys) >= MERGED:
                yield from self.drain()

    def drain(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for lo in range(0, len(self.keys), 1 << 18):
            k = self.keys[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), self.kind, np.int32)), pa.array(k.view(np.int64)), pa.array(self.counts[lo : lo + (1 << 18)])],
                names=["kind", "key", "count"],
            )
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)


WORD, CONTEXT, DOCUMENT = 0, 1, 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, contexts = Tally(WORD), Tally(CONTEXT)
    for batch in batches:
        for c in bt.chunks(batch.column(0)):
            yield from words.add(word_keys(c, bt.LOWER[c.data])[0])
            yield from contexts.add(context_keys(c)[0])
    yield from words.drain()
    yield from contexts.drain()


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, known) of keys in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def low_bytes(key: Column, n: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def context(key: Column) -> Column:
    return F.shiftright(key, 8)


def stored(df: DataFrame, name: str) -> DataFrame:
    at = workspace(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def build(longest: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per order, shortest first: successors (key, count), and contexts (context, total, kinds, below_total, below_kinds).

    The last two are of the next shorter context, without this one's successors: each of them is a
    successor there too, since the trie is whole.
    """
    pairs = [longest]
    for order in range(ORDER - 1, -1, -1):
        shorter = pairs[0].groupBy(low_bytes(F.col("key"), order + 1).alias("key")).agg(F.count(F.lit(1)).alias("count"))
        pairs.insert(0, stored(shorter, f"order-{order}"))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for order, level in enumerate(pairs):
        own = level.select("key", "count", context(F.col("key")).alias("context"))
        if order:
            below, of_below = levels[-1]
            taken = below.select(F.col("key").alias("short"), F.col("count").alias("taken"))
            own = own.withColumn("short", low_bytes(F.col("key"), order)).join(taken, "short", "left")
            sums = own.groupBy("context").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("taken").alias("taken"))
            rest = of_below.select(F.col("context").alias("short"), F.col("total").alias("all"), F.col("kinds").alias("all_kinds"))
            contexts = (
                sums.withColumn("short", low_bytes(F.col("context"), order - 1))
                .join(rest, "short", "left")
                .select("context", "total", "kinds", (F.col("all") - F.col("taken")).alias("below_total"), (F.col("all_kinds") - F.col("kinds")).alias("below_kinds"))
            )
        else:
            sums = own.groupBy("context").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("kinds"))
            contexts = sums.select("*", F.lit(0).cast("bigint").alias("below_total"), F.lit(0).cast("bigint").alias("below_kinds"))
        levels.append((level, stored(contexts, f"contexts-{order}")))
    return levels


def seen_costs(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(key, count, value): log10 probability of each string that training has seen."""
    pairs, contexts = levels[-1]
    own = pairs.withColumn("context", context(F.col("key"))).join(contexts.select("context", "total", "kinds"), "context")
    return own.select("key", "count", F.log10(F.col("count") / (F.col("total") + F.col("kinds"))).alias("value"))


def unseen_costs(levels: list[tuple[DataFrame, DataFrame]], keys: DataFrame) -> DataFrame:
    """(key, value): log10 probability of the given distinct strings, by escapes down to the order that has the byte."""
    none = F.lit(None).cast("bigint")
    # `left_total` is null until a context was known; then it and `left_kinds` are what the shorter one has left.
    state = keys.select("key", F.lit(0.0).alias("value"), none.alias("left_total"), none.alias("left_kinds"), F.lit(False).alias("done"))
    beyond = math.log10(max(SYMBOLS - levels[0][0].count(), 1))
    for order in range(ORDER, -1, -1):
        pairs, contexts = levels[order]
        pairs = pairs.select(F.col("key").alias("pair"), F.col("count").alias("times"))
        if order < 2:  # 2**16 contexts and bytes at most, met by very many strings each
            pairs, contexts = F.broadcast(pairs), F.broadcast(contexts)
        low = low_bytes(F.col("key"), order + 1)
        joined = (
            state.withColumns({"pair": low, "context": context(low)}).join(contexts, "context", "left").join(pairs, "pair", "left")
        )
        total = F.coalesce("left_total", "total", F.lit(0))
        kinds = F.coalesce("left_kinds", "kinds", F.lit(0))
        chances = total + kinds
        some = ~F.col("done") & (chances > 0)
        hit = some & F.col("times").isNotNull()
        step = F.when(hit, F.log10(F.col("times") / chances)).when(some, F.log10(kinds / chances)).otherwise(0.0)
        if not order:  # beyond the shortest context all symbols it lacks are equally likely
            step = step - F.when(F.col("done") | hit, 0.0).otherwise(beyond)
        state = joined.select(
            "key",
            (F.col("value") + step).alias("value"),
            F.col("below_total").alias("left_total"),
            F.col("below_kinds").alias("left_kinds"),
            (F.col("done") | hit).alias("done"),
        )
    return state.select("key", "value")


def rarer(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, times) of the distinct pairs."""
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return keys[first], text[first], np.diff(np.append(first, len(keys))).astype(np.int64)


def _score(costs, head, n_train: int, n_words: int):
    """Task function: a row per document with all but its rarer words and strings, and a row per rarer one of a document."""
    smooth = math.log10(n_train + 0.1 * (n_words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (strings, values), (words, counts) = costs.value, head.value
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for c in bt.chunks(batch.column(2)):
                keys, text = context_keys(c)
                at, common = find(strings, keys)
                score = np.bincount(text[common], weights=values[at[common]], minlength=c.n).astype(float)
                rare = [(CONTEXT, 0.0, *rarer(keys[~common], text[~common]))]
                keys, text = word_keys(c, bt.LOWER[c.data])
                at, common = find(words, keys)
                n_tokens = np.bincount(text, minlength=c.n)
                known = np.bincount(text[common], minlength=c.n)
                base = np.bincount(text[common], weights=np.log10(counts[at[common]] + 0.1), minlength=c.n) - n_tokens * smooth
                rare.append((WORD, math.log10(0.1), *rarer(keys[~common], text[~common])))
                row = rows.slice(c.lo, c.n)
                place = np.asarray(row).astype(np.uint64)
                # Rows of documents carry a key of their own, so that the join deals them evenly.
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(c.lo, c.n), row, pa.array(np.full(c.n, DOCUMENT, np.int32)), pa.array(bt.mix(place).view(np.int64)), pa.array(np.zeros(c.n, np.int64)),
                     pa.array(n_tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)],
                    names=OUT,
                )
                for kind, cost, keys, text, times in rare:
                    own, zeros = pa.array(c.lo + text), np.zeros(len(keys))
                    whole = pa.array(zeros.astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(own), rows.take(own), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(times),
                         whole, whole, pa.array(times * cost), pa.array(zeros)],
                        names=OUT,
                    )

    return run


OUT = ["doc_id", "row", "kind", "key", "times", "n_tokens", "n_known", "base", "score"]


def sorted_table(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of a frame of bounded size, by key."""
    top = df.select("key", column).toArrow()
    key = top.column("key").to_numpy().view(np.uint64)
    sort = np.argsort(key)
    return key[sort], top.column(column).to_numpy()[sort]


def score_documents(documents: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    out_of_training = held_out(F.col("doc_id"), FOLDS, HELD)
    counts_at = workspace(spark, "counts")
    (
        docs.filter(~out_of_training)
        .select("text")
        .mapInArrow(_count, "kind int, key bigint, count bigint")
        .groupBy("kind", "key")
        .agg(F.sum("count").alias("count"))
        .write.parquet(counts_at)
    )
    counted = spark.read.parquet(counts_at)
    words = counted.filter(F.col("kind") == WORD).select("key", "count")
    n_train, n_words = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()

    levels = build(counted.filter(F.col("kind") == CONTEXT).select("key", "count"))
    seen = stored(seen_costs(levels), "costs")
    costs = spark.sparkContext.broadcast(sorted_table(most_frequent(seen, NODES), "value"))
    head = spark.sparkContext.broadcast(sorted_table(most_frequent(words, HEAD), "count"))

    scored = stored(
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(
            _score(costs, head, n_train, n_words),
            f"doc_id {kind}, row bigint, kind int, key bigint, times bigint, n_tokens bigint, n_known bigint, base double, score double",
        ),
        "scored",
    )
    unseen = scored.filter(F.col("kind") == CONTEXT).select("key").distinct().join(seen, "key", "left_anti")
    # Of the words outside the head, those seen in training replace their share of an unknown word.
    gain = words.select(F.lit(WORD).alias("kind"), "key", (F.log10(F.col("count") + 0.1) - F.lit(math.log10(0.1))).alias("value"))
    strings = seen.select("key", "value").union(unseen_costs(levels, unseen)).select(F.lit(CONTEXT).alias("kind"), "key", "value")
    worth = F.coalesce(F.col("times") * F.col("value"), F.lit(0.0))
    word = F.col("kind") == WORD
    total = (
        scored.join(gain.union(strings), ["kind", "key"], "left")
        .groupBy("doc_id", "row")
        .agg(
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(word & F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.when(word, worth).otherwise(0.0)).alias("base_score"),
            F.sum(F.col("score") + F.when(F.col("kind") == CONTEXT, worth).otherwise(0.0)).alias("score"),
        )
    )
    return total.select(
        "doc_id",
        out_of_training.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
