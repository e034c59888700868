"""Merges on many words at once against the same merges word by word, and what is left of the words."""

import random

import pyarrow as pa

from jobloom.operators import pieces


def by_word(parts, merges):
    ranks = {pair: i for i, pair in enumerate(merges)}
    while any(pair in ranks for pair in zip(parts, parts[1:])):
        parts = pieces._merge(parts, *merges[min(ranks[p] for p in zip(parts, parts[1:]) if p in ranks)])
    return parts


def test_merges_of_many_words_are_those_of_each():
    rng = random.Random(5)
    for _ in range(60):
        words = [[rng.choice("aab▁é") for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(0, 30))]
        known, merges = ["a", "b", "▁"], []
        for _ in range(rng.randint(1, 12)):
            pair = (rng.choice(known), rng.choice(known))
            if pair not in merges:
                merges.append(pair)
                known.append("".join(pair))
        rng.shuffle(merges)
        got = pieces._Merges(merges).apply(pa.array(words, pa.list_(pa.string())))
        assert got.to_pylist() == [by_word(w, merges) for w in words]


def test_whole_words_leave_the_table(spark):
    table = spark.createDataFrame([(["a", "b"], 3), (["a", "b", "c"], 2), (["c", "a"], 1)], pieces.TABLE)
    got = pieces._apply(table, [("a", "b")]).collect()
    assert sorted((r["parts"], r["n"]) for r in got) == [(["ab", "c"], 2), (["c", "a"], 1)]


def test_runs_of_known_pairs(spark):
    table = spark.createDataFrame([(list("abcabx"), 3), (list("xab"), 2), (["a"], 9), (list("yz"), 1), (list("abc"), 5)], pieces.TABLE)
    got = pieces._runs(table, {("a", "b"), ("b", "c"), ("q", "r")}).collect()
    assert sorted((r["parts"], r["n"]) for r in got) == [(["a", "b"], 5), (["a", "b", "c"], 8)]
