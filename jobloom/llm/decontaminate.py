"""Benchmark decontamination by winnowing.

Both sides are hashed in k-grams of words; of every `WINDOW - K + 1` consecutive k-grams the one
with the smallest hash is kept, so every shared span of `WINDOW` words shares a kept fingerprint.
Fingerprints are joined, and every hit is extended on the words themselves to whole windows.
Items shorter than a window count as one window, looked up by the hash of all their words.

Defined results: a null or wordless text has no words and no hits; repeated rows are each judged;
items with the same id count once; wordless items hit nothing; a null id meets itself only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import bytetext as bt

WINDOW = 13
K = 6
# Above this number of benchmark fingerprints the join shuffles both sides instead of sending the small one around.
SHARED_FINGERPRINTS = 500_000


def winnow(grams: np.ndarray, text: np.ndarray, span: int) -> np.ndarray:
    """Positions kept by winnowing: the smallest (rightmost of equals) of each `span` k-grams of one text.

    A text with fewer k-grams than `span` keeps its smallest.
    """
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    best, best_at, size = grams.copy(), at.copy(), 1
    # After each step best[i] is the minimum of grams[i : i + size] within the text of i.
    while size < span:
        step = min(size, span - size)
        a, b = slice(0, n - step), slice(step, n)
        same = text[a] == text[b]
        better = same & (best[b] <= best[a])
        # In place is wrong where the read and written parts overlap, hence the copies.
        new, new_at = best[b].copy(), best_at[b].copy()
        best[a] = np.where(better, new, best[a])
        best_at[a] = np.where(better, new_at, best_at[a])
        size += step
    full = np.zeros(n, bool)
    if n >= span:
        full[: n - span + 1] = text[: n - span + 1] == text[span - 1 :]
    starts = np.concatenate([[True], text[1:] != text[:-1]])
    kept = np.zeros(n, bool)
    kept[best_at[full | starts]] = True
    return np.flatnonzero(kept)


def _grams(chunk: bt.Chunk, k: int) -> tuple[np.ndarray, np.ndarray, bt.Words, np.ndarray]:
    data = bt.LOWER[chunk.data]
    w = bt.words(chunk, data, bt.ALNUM)
    hashes = bt.word_hashes(data, w)
    grams = bt.gram_hashes(hashes, k)
    ok = w.text[: len(grams)] == w.text[k - 1 :] if len(grams) else np.zeros(0, bool)
    return grams[ok], w.text[: len(grams)][ok], w, hashes


def fingerprints(texts: DataFrame, id_column: str, text_column: str, short_lengths: list[int]) -> DataFrame:
    """(id, fp): the distinct winnowed fingerprints of each text, and the hashes of its grams of the given short lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for c in bt.chunks(batch.column(1)):
                grams, text, w, hashes = _grams(c, K)
                keep = winnow(grams, text, WINDOW - K + 1)
                fps, owners = [grams[keep]], [text[keep]]
                for m in short_lengths:
                    g = bt.gram_hashes(hashes, m)
                    ok = w.text[: len(g)] == w.text[m - 1 :] if len(g) else np.zeros(0, bool)
                    # Another constant per length, so that lengths never meet each other's hashes.
                    fps.append(bt.mix(g[ok] + np.uint64(m)))
                    owners.append(w.text[: len(g)][ok])
                fp, owner = np.concatenate(fps), np.concatenate(owners)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner + c.lo)), pa.array(fp.view(np.int64))], names=["id", "fp"]
                )

    kind = dict(texts.dtypes)[id_column]
    return texts.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, f"id {kind}, fp bigint")


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(id, text, fp) of the benchmark: winnowed, or of all words for short items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for c in bt.chunks(texts):
                grams, text, w, hashes = _grams(c, K)
                keep = winnow(grams, text, WINDOW - K + 1)
                long = w.counts[text[keep]] >= WINDOW
                fps, owners = [grams[keep][long]], [text[keep][long]]
                for m in range(1, WINDOW):
                    own = np.flatnonzero(w.counts == m)
                    g = bt.gram_hashes(hashes, m)
                    if len(own):
                        fps.append(bt.mix(g[w.first[own]] + np.uint64(m)))
                        owners.append(own)
                fp, owner = np.concatenate(fps), np.concatenate(owners)
                at = pa.array(owner + c.lo)
                lengths = pa.array(np.minimum(w.counts[owner], WINDOW).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), texts.take(at), pa.array(fp.view(np.int64)), lengths],
                    names=["item_id", "item_text", "fp", "words"],
                )

    kind = dict(items.dtypes)["item_id"]
    return items.select("item_id", F.col("text").cast("string")).mapInArrow(
        run, f"item_id {kind}, item_text string, fp bigint, words int"
    )


def _windows(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of one lower-cased text and its window hashes."""
    c, data = bt.text_arrays([text])
    data = bt.LOWER[data]
    w = bt.words(c, data, bt.ALNUM)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(w.start, w.end, strict=True)], bt.word_hashes(data, w)


def _judge(doc_words: list[bytes], doc_hashes: np.ndarray, item: bytes, hit: np.ndarray) -> bool:
    """Mark the document words inside occurrences of the item's windows; whether there were any."""
    item_words, item_hashes = _windows(item)
    m = min(WINDOW, len(item_words))
    if m == 0 or len(doc_words) < m:
        return False
    mine, theirs = bt.gram_hashes(doc_hashes, m), bt.gram_hashes(item_hashes, m)
    at_item = {}
    for j, h in enumerate(theirs.tolist()):
        at_item.setdefault(h, []).append(j)
    found = False
    for i in np.flatnonzero(np.isin(mine, theirs)):
        for j in at_item[int(mine[i])]:
            if doc_words[i : i + m] == item_words[j : j + m]:
                hit[i : i + m] = True
                found = True
                break
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of `documents` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated."""
    short = item_fingerprints(benchmark)
    facts = short.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("words") < WINDOW, F.col("words"))).alias("m")).first()
    tests = short.select("item_id", "item_text", "fp").distinct()
    hits = fingerprints(documents, "doc_id", "text", sorted(facts["m"])).join(
        F.broadcast(tests) if facts["n"] <= SHARED_FINGERPRINTS else tests, "fp"
    )
    found = (
        hits.select("id", "item_id", "item_text")
        .distinct()
        .groupBy("id")
        .agg(F.collect_list(F.struct(F.col("item_id").cast("string").alias("k"), F.col("item_text").alias("t"))).alias("items"))
    )
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, items = batch.column(1), batch.column(2)
            n_words = np.zeros(len(texts), np.int64)
            for c in bt.chunks(texts):
                data = bt.LOWER[c.data]
                n_words[c.lo : c.hi] = bt.words(c, data, bt.ALNUM).counts
            n_hit, n_items = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            keys: list[list[str]] = [[] for _ in range(len(texts))]
            for i in np.flatnonzero(items.is_valid().to_numpy(zero_copy_only=False)):
                doc_words, doc_hashes = _windows((texts[i].as_py() or "").encode())
                hit = np.zeros(len(doc_words), bool)
                keys[i] = sorted({x["k"] for x in items[i].as_py() if _judge(doc_words, doc_hashes, (x["t"] or "").encode(), hit) and x["k"] is not None})
                n_hit[i], n_items[i] = hit.sum(), len(keys[i])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words),
                    pa.array(n_hit),
                    pa.array(n_items),
                    pa.array([hashlib.sha256(",".join(k).encode()).hexdigest() for k in keys]),
                    pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    return joined.mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    )
