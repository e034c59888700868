"""Byte-pair style word pieces learned from word counts."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.session import cut_lineage

# Vocabulary defaults and the mark of a word start.
VOCAB_SIZE = 30_000
MIN_PAIR_COUNT = 5
WORD_START = "▁"

# What a round may bring to the driver: pairs with their counts, and pieces in distinct runs.
CANDIDATES = 1 << 14
RUN_PIECES = 1 << 17

Pair = tuple[str, str]
TABLE = "parts array<string>, n long"
ARROW_TABLE = pa.schema([("parts", pa.list_(pa.string())), ("n", pa.int64())])


def _merge(parts: list[str], a: str, b: str) -> list[str]:
    merged, i = [], 0
    while i < len(parts):
        if parts[i] == a and i + 1 < len(parts) and parts[i + 1] == b:
            merged.append(a + b)
            i += 2
        else:
            merged.append(parts[i])
            i += 1
    return merged


def _found(parts: pa.ListArray, pairs: Iterable[Pair]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pieces of all words, the word of each, whether it and the next piece of its word are one of the pairs)."""
    flat = parts.flatten()
    word = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    hit = np.zeros(len(flat), bool)
    coded = flat.dictionary_encode()
    at = {piece: i for i, piece in enumerate(coded.dictionary.to_pylist())}
    wanted = np.array(sorted(at[a] * len(at) + at[b] for a, b in pairs if a in at and b in at), np.int64)
    if len(wanted):
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = code[:-1] * len(at) + code[1:]
        same = wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
        hit[:-1] = same & (word[1:] == word[:-1])
    return flat, word, hit


def _runs(table: DataFrame, known: set[Pair]) -> DataFrame:
    """Distinct longest stretches of words whose neighbouring pieces are all known pairs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, word, hit = _found(batch["parts"], known)
            behind = np.append(False, hit)[: len(hit)]
            first, last = np.flatnonzero(hit & ~behind), np.flatnonzero(behind & ~hit)
            ends = np.append(0, np.cumsum(last - first + 1))
            inside = np.arange(ends[-1]) + np.repeat(first - ends[:-1], np.diff(ends))
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(inside)))
            yield pa.RecordBatch.from_arrays([runs, batch["n"].take(pa.array(word[first]))], schema=ARROW_TABLE)

    return table.mapInArrow(cut, TABLE).groupBy("parts").agg(F.sum("n").alias("n"))


class _Merges:
    """Merges as sorted pairs of codes, to be done on many words at once."""

    def __init__(self, merges: list[Pair]) -> None:
        ranks = {pair: i for i, pair in enumerate(merges)}
        names = list(dict.fromkeys(x for a, b in ranks for x in (a, b, a + b)))
        at = {name: i for i, name in enumerate(names)}
        self.names, self.last = pa.array(names, pa.string()), len(merges)
        self.base = len(names) + 1  # the code of all other pieces is one less
        pairs = np.array([at[a] * self.base + at[b] for a, b in ranks], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.rank = pairs[order], np.array(list(ranks.values()), np.int64)[order]
        self.piece = np.zeros(self.last, np.int64)
        self.piece[self.rank] = np.array([at[a + b] for a, b in ranks], np.int64)[order]

    def apply(self, parts: pa.ListArray) -> pa.ListArray:
        """The words with, step by step, all places of each word's first merge merged from left to right."""
        flat = parts.flatten()
        code = pc.fill_null(pc.index_in(flat, self.names), self.base - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        origin = np.arange(len(flat))
        done = [(word[:0], code[:0], origin[:0])]
        while len(code):
            pair = code[:-1] * self.base + code[1:]
            place = np.minimum(np.searchsorted(self.pairs, pair), self.last - 1)
            good = (self.pairs[place] == pair) & (word[1:] == word[:-1])
            rank = np.append(np.where(good, self.rank[place], self.last), self.last)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(start, append=len(word)))
            ready, left = least == self.last, least < self.last
            done.append((word[ready], code[ready], origin[ready]))
            word, code, origin, rank, least = word[left], code[left], origin[left], rank[left], least[left]
            hit = np.flatnonzero(rank == least)
            # Neighbouring hits are one piece repeated: every other one is merged.
            index = np.arange(len(hit))
            since = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) > 1, index, 0))
            hit = hit[(index - since) % 2 == 0]
            code[hit] = self.piece[rank[hit]]
            word, code, origin = (np.delete(x, hit + 1) for x in (word, code, origin))
        word, code, origin = map(np.concatenate, zip(*done))
        order = np.argsort(word, kind="stable")
        at = np.where(code < self.base - 1, code, self.base - 1 + origin)[order]
        ends = np.append(0, np.cumsum(np.bincount(word, minlength=len(parts))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([self.names, flat]).take(pa.array(at)))


def _apply(table: DataFrame, merges: list[Pair]) -> DataFrame:
    """Words after the merges, each done once and in order; words that are one piece by then have no pairs and go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        them = _Merges(merges)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([them.apply(batch["parts"]), batch["n"]], schema=ARROW_TABLE)

    return table.mapInArrow(run, TABLE).where(F.size("parts") > 1)


def _learn(runs: list, unknown: int, min_count: int, room: int) -> list[tuple[str, str, int]]:
    """The leading merges that runs decide, where a pair outside of runs counts at most `unknown`.

    The parts of a piece are the same wherever it stands: merges are done everywhere at once, and none
    crosses its ends. So a new pair stands where one pair of the first words stood, always the same one:
    it counts no more than that pair, and lies in runs if that does.
    """
    words = [list(r["parts"]) for r in runs]
    counts: dict[Pair, int] = defaultdict(int)
    where: dict[Pair, set[int]] = defaultdict(set)
    for i, r in enumerate(runs):
        for pair in zip(words[i], words[i][1:]):
            counts[pair] += r["n"]
            where[pair].add(i)
    heap = [(-n, pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    learned: list[tuple[str, str, int]] = []
    while heap and len(learned) < room:
        least, pair = heapq.heappop(heap)
        if counts[pair] != -least:
            continue
        # Pairs outside of runs that tie with the first one come after it, as runs hold the first pairs.
        if -least < min_count or (learned and -least <= unknown):
            break
        learned.append((*pair, -least))
        changed = set()
        for i in where.pop(pair):
            old, new = words[i], _merge(words[i], *pair)
            for p in zip(old, old[1:]):
                counts[p] -= runs[i]["n"]
                changed.add(p)
            for p in zip(new, new[1:]):
                counts[p] += runs[i]["n"]
                where[p].add(i)
                changed.add(p)
            words[i] = new
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], p))
    return learned


def learn_pieces(
    words: DataFrame,
    word: str = "word",
    count: str = "n",
    merges: int | None = None,
    min_count: int = MIN_PAIR_COUNT,
    candidates: int = CANDIDATES,
    vocab_size: int = VOCAB_SIZE,
    run_pieces: int = RUN_PIECES,
) -> DataFrame:
    """Merges `(rank, a, b, piece, n)` in the order they are learned; ties by the pieces.

    Learning ends at `merges`, or where letters and pieces are `vocab_size`, or where no pair counts
    `min_count`. The words stay distributed. A round takes the `candidates` most frequent pairs, sums
    the stretches of words that consist of them, and brings these to the driver, which finds all merges
    they decide; with over `run_pieces` pieces in them it takes fewer pairs. The first pair is always
    decided, so every round gets on. Null words are left out, null counts are 0, words in several rows add up.
    """
    spark = words.sparkSession
    letters = F.filter(F.split(F.concat(F.lit(WORD_START), word), ""), lambda c: c != "")
    table = cut_lineage(
        words.where(F.col(word).isNotNull()).select(
            letters.alias("parts"), F.coalesce(F.col(count), F.lit(0)).cast("long").alias("n")
        )
    )
    room = vocab_size - table.select(F.explode("parts")).distinct().count()
    if merges is not None:
        room = min(room, merges)
    learned: list[tuple] = []
    size = candidates
    while len(learned) < room:
        neighbours = F.zip_with(
            F.slice("parts", 1, F.size("parts") - 1),
            F.slice("parts", 2, F.size("parts") - 1),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        )
        top = (
            table.where(F.size("parts") > 1)
            .select(F.explode(neighbours).alias("p"), "n")
            .groupBy("p.a", "p.b")
            .agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "a", "b")
            .limit(candidates + 1)
            .collect()
        )
        if not top or top[0]["n"] < min_count:
            break
        size = min(size, candidates, len(top))
        while True:
            runs = cut_lineage(_runs(table, {(r["a"], r["b"]) for r in top[:size]}))
            if size == 1 or (runs.agg(F.sum(F.size("parts"))).first()[0] or 0) <= run_pieces:
                break
            size = max(1, size // 4)
        unknown = top[size]["n"] if size < len(top) else 0
        # Runs of the first pair alone need not be small; its count is known.
        if size == 1 and unknown:
            found = [tuple(top[0])]
        else:
            found = _learn(runs.collect(), unknown, min_count, room - len(learned))
        learned += [(len(learned) + i, a, b, a + b, n) for i, (a, b, n) in enumerate(found, 1)]
        table = cut_lineage(_apply(table, [(a, b) for a, b, _ in found]))
        size *= 2
    return spark.createDataFrame(learned, "rank int, a string, b string, piece string, n long")
