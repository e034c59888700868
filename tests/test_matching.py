import random
import re

import pytest
from pyspark.sql import functions as F

from jobloom.operators import matching


def lookup(spark, pairs):
    return spark.createDataFrame([(t, c, i) for i, (t, c) in enumerate(pairs)], "title string, code string, ord int")


def test_longest_segment_wins_then_lookup_order(spark, rows):
    known = lookup(spark, [("cook", "1"), ("line cook", "2"), ("head chef", "3"), ("chef head", "4")])
    jobs = spark.createDataFrame(
        [(1, "cook / line cook"), (2, "chef head - head chef"), (3, "the cook"), (4, "cook!")], "id int, title string"
    )
    got = jobs.transform(matching.segment_matcher(known)).select("id", "code", "assigned_title")
    assert rows(got) == [(1, "2", "line cook"), (2, "3", "head chef"), (4, "1", "cook")]


def test_segment_match_joins_on_equality(spark):
    known = lookup(spark, [("cook", "1")])
    jobs = spark.createDataFrame([(1, "cook")], "id int, title string")
    plan = jobs.transform(matching.segment_matcher(known))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_layers_are_disjoint(spark, rows):
    known = lookup(spark, [("cook", "1"), ("nurse", "2")])
    jobs = spark.createDataFrame([(1, "cook"), (2, "cook, nights"), (3, "pilot"), (4, "nurse")], "id int, title string")
    match = matching.layered_matcher([matching.exact_matcher(known), matching.segment_matcher(known)], "id")
    got = jobs.transform(match).select("id", "code", "layer")
    assert rows(got) == [(1, "1", 1), (2, "1", 2), (4, "2", 1)]
    rate = matching.match_rate(jobs.transform(match), jobs).first()
    assert (rate["matched"], rate["match_rate"]) == (3, 0.75)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_match_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    known = sorted({word() for _ in range(60)})
    rng.shuffle(known)
    titles = sorted({word() for _ in range(80)})
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    for limit in (1, 2):
        match = matching.fuzzy_matcher(lookup(spark, [(k, "c") for k in known]), max_edits=limit)
        got = {r["title"]: (r["edits"], r["assigned_title"]) for r in df.transform(match).collect()}
        want = {}
        for t in titles:
            d, i = min((edits(t, k), i) for i, k in enumerate(known))
            if d <= limit:
                want[t] = (d, known[i])
        assert got == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequence_distance(spark):
    rng = random.Random(4)
    phrase = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7)))
    pairs = [(phrase(), phrase()) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string")
    d = matching.subsequence_distance(F.split("a", " "), F.split("b", " "))
    for r in df.select("a", "b", d.alias("d")).collect():
        a, b = r["a"].split(), r["b"].split()
        assert abs(r["d"] - (1 - lcs(a, b) / max(len(a), len(b)))) < 1e-12


def test_segments_are_the_pieces_between_punctuation(spark):
    title = "Chef / cook, (nights) é ok"
    got = spark.createDataFrame([(title,)], "t string").select(matching.title_segments(F.col("t")).alias("s")).first()["s"]
    assert set(got) == {s.strip() for s in re.split(r"[^0-9a-zA-Z\s]", title)}


def closest(titles, lookup, exclude_equal=False):
    """{title: (edits, ord)} by comparing every title with every lookup title."""
    out = {}
    for t in titles:
        best = min(((edits(t, k), o) for k, _, o in lookup if not (exclude_equal and k == t)), default=None)
        if best:
            out[t] = best
    return out


@pytest.mark.parametrize("exclude_equal", [False, True])
@pytest.mark.parametrize("seed", [3, 4])
def test_unlimited_fuzzy_matches_are_the_best_of_all(spark, seed, exclude_equal):
    rng = random.Random(seed)
    words = ["nurse", "senior", "welder", "data", "clerk", "an", "na", "aaaa", "of", "engineer", "night shift", "q"]
    lookup = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(40)}) + ["a", "aa", ""]
    lookup = [(t, f"c{i}", i) for i, t in enumerate(lookup)]
    titles = {"", "a", "zzzz", "0123456789012345678901234567890123456789", "xyzzy plugh", "welders of night", "aaaaaaaaaaaaaaaaaa"}
    for t, _, _ in lookup[::2]:
        letters = list(t)
        for _ in range(rng.randint(0, 12)):
            letters.insert(rng.randint(0, len(letters)), rng.choice("abnsé w"))
            if rng.random() < 0.5:
                letters.pop(rng.randrange(len(letters)))
        titles |= {"".join(letters), t}
    known = spark.createDataFrame(lookup, "title string, code string, ord int")
    rows = spark.createDataFrame([(t,) for t in [*titles, None, "zzzz"]], "title string")
    got = rows.transform(matching.fuzzy_matcher(known, exclude_equal=exclude_equal)).collect()
    order = {t: o for t, _, o in reversed(lookup)}
    assert len(got) == len(titles) + 1
    assert {r["title"]: (r["edits"], order[r["assigned_title"]]) for r in got} == closest(titles, lookup, exclude_equal)


def test_unlimited_fuzzy_matches_of_empty_tables(spark):
    known = spark.createDataFrame([("nurse", "c", 1), (None, "d", 2)], "title string, code string, ord int")
    none = spark.createDataFrame([], "title string")
    assert none.transform(matching.fuzzy_matcher(known)).collect() == []
    rows = spark.createDataFrame([("clerk",)], "title string")
    assert rows.transform(matching.fuzzy_matcher(known.limit(0))).collect() == []
    assert [r["assigned_title"] for r in rows.transform(matching.fuzzy_matcher(known)).collect()] == ["nurse"]
