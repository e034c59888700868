"""Near copies, repeated strings, contamination and fingerprints against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import bytetext as bt
from jobloom.llm import decontaminate, jaccard_join, spotsigs, suffix_dedup
from jobloom.llm.components import components
from tests.llm import helpers as h


def test_near_copy_classes(spark):
    rows = h.odd_rows()
    got = jaccard_join.near_copy_classes(h.documents(spark, rows)).collect()
    assert h.by_id(got) == h.by_id(h.near_classes(rows))


def test_near_copies_around_the_threshold(spark):
    rng = random.Random(7)
    words = h.vocabulary(rng)
    rows = []
    for family in range(12):
        base = h.sentence(rng, rng.randint(6, 60), words).split()
        for i in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((family * 10 + i, " ".join(w) + " shared closing line of many documents here"))
    got = jaccard_join.near_copy_classes(h.documents(spark, rows)).collect()
    assert h.by_id(got) == h.by_id(h.near_classes(rows))


def test_blocks_of_a_large_hub(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TREE_SETS", 3)
    monkeypatch.setattr(jaccard_join, "PROBE_SETS", 4)
    monkeypatch.setattr(jaccard_join, "COMMON_IN_TASK", 2)
    test_near_copies_around_the_threshold(spark)


def test_near_copies_of_an_empty_table(spark):
    assert jaccard_join.near_copy_classes(h.documents(spark, [])).collect() == []


def test_prefix_tree_finds_all_partners():
    rng = np.random.default_rng(5)
    base = rng.choice(10_000, 60, replace=False)
    sets = []
    for _ in range(80):
        s = base.copy()
        k = rng.integers(0, 14)
        s[rng.integers(0, 60, k)] = rng.integers(10_000, 20_000, k)
        sets.append(np.unique(s[: rng.integers(40, 61)]).astype(np.uint64))
    tree = jaccard_join.PrefixTree(sets)
    for probe in sets:
        want = {j for j, s in enumerate(sets) if jaccard_join.linked(len(np.intersect1d(probe, s)), len(probe), len(s))}
        assert set(tree.partners(probe)) == want


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 200) for i in range(30)] + [(7, 7)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()
    assert {r["node"]: r["label"] for r in got} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 100}


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed):
    rng = random.Random(seed)
    words = h.vocabulary(rng)
    items = [(i, h.sentence(rng, rng.choice([1, 2, 5, 12, 13, 14, 30, 60]), words)) for i in range(30)]
    items += [(90, None), (91, ""), (92, "..."), (3, items[3][1]), (93, "Tie tie tie tie tie tie tie tie tie tie tie tie tie tie")]
    rows = h.odd_rows(seed)
    for k in range(25):
        text = h.sentence(rng, rng.randint(3, 120), words)
        piece = h.plain_words(rng.choice(items[:30])[1])
        at = rng.randint(0, len(piece))
        rows.append((100 + k, f"{text}, {' -- '.join(piece[at:]).upper()} {text[:20]}"))
    rows += [(200, "tie " * 20), (201, "tie " * 12)]
    got = decontaminate.decontaminate(h.documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert h.by_id(got) == h.by_id(h.contamination(rows, items))


def test_contamination_with_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARED_FINGERPRINTS", 0)
    test_contamination(spark, 3)


def test_contamination_of_and_by_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.decontaminate(h.documents(spark, [(1, "a b c"), (2, None)]), none).collect()
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in sorted(got)] == [(1, 3, 0, False), (2, 0, 0, False)]
    assert decontaminate.decontaminate(h.documents(spark, []), none).collect() == []


def repetitive_rows(seed):
    rng = random.Random(seed)
    words = h.vocabulary(rng, 60)
    passage = h.sentence(rng, 60, words)
    rows = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 131), (5, "ab" * 200), (6, passage), (7, "é" * 80)]
    for i in range(8, 30):
        cut = rng.randint(0, len(passage) - 20)
        end = rng.randint(cut + 10, len(passage))
        rows.append((i, f"{h.sentence(rng, rng.randint(0, 30), words)} {passage[cut:end]}{rng.choice('xyz')} {h.sentence(rng, 20, words)}"))
    rows += [(30, rows[12][1]), (31, rows[12][1] * 2), (32, "ba" * 100 + passage), (None, passage)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_remove_repeats(spark, seed):
    rows = repetitive_rows(seed)
    got = suffix_dedup.remove_repeats(h.documents(spark, rows)).collect()
    assert h.by_id(got) == h.by_id(h.without_repeats(rows))


def test_remove_repeats_span_by_span(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY_CONTEXTS", 1)
    monkeypatch.setattr(suffix_dedup, "SORTED_AT_ONCE", 5)
    test_remove_repeats(spark, 3)


def test_repeated_rows_are_one_document(spark):
    text = "0123456789" * 15
    rows = [(1, text), (1, text), (2, text)]
    got = h.by_id(suffix_dedup.remove_repeats(h.documents(spark, rows)).collect())
    once = h.by_id(h.without_repeats([(1, text), (2, text)]))
    assert got == [once[0], once[0], once[1]]
    assert suffix_dedup.remove_repeats(h.documents(spark, [])).collect() == []


def test_suffix_sort_orders_by_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 2000).astype(np.uint8)
    starts = rng.integers(0, 1900, 300)
    group = np.sort(rng.integers(0, 5, 300))
    order = suffix_dedup.Suffixes(data).sort(starts, group)
    raw = data.tobytes()
    keys = [(int(g), raw[s : s + 100]) for g, s in zip(group[order], starts[order])]
    assert keys == sorted(keys)
    assert sorted(order) == list(range(300))


def test_span_hashes_compare_substrings():
    data = np.frombuffer(b"abcabcabcd", np.uint8)
    prefix = bt.prefix_hashes(data)
    spans = bt.span_hashes(prefix, np.array([0, 3, 6, 7]), np.array([3, 6, 9, 10]))
    assert spans[0] == spans[1] == spans[2] != spans[3]


def chains(text):
    import re

    words = [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]
    content = [w for w in words if w not in spotsigs.ANCHORS]
    out, seen = set(), 0
    for w in words:
        if w in spotsigs.ANCHORS:
            if seen + 2 <= len(content):
                out.add((w, content[seen], content[seen + 1]))
        else:
            seen += 1
    return out or {tuple(words)}


def test_fingerprints_and_likeness(spark):
    rng = random.Random(4)
    words = [*h.vocabulary(rng, 80), "the", "of", "and", "der", "que"] * 2
    rows = [(5 * i, h.sentence(rng, rng.randint(1, 60), words)) for i in range(30)]
    rows += [(3, None), (4, ""), (6, rows[2][1]), (7, "one the"), (999, "Ünd the Ärger of ß — the end of it all 😀 the last")]
    rows.sort()
    got = {r["doc_id"]: r for r in spotsigs.fingerprint_edits(h.documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = chains(text), chains(edited), chains(following)
        r = got[doc_id]
        import hashlib

        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b))
        assert r["near_next"] == pytest.approx(len(a & c) / len(a | c))
        assert len(r["fingerprint"]) == 8 * len(a)
    assert got[6]["fingerprint"] == got[10]["fingerprint"]


def test_next_of_one_of_many_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS_PER_RANGE", 3)
    rows = [(i * i, f"text {i}") for i in range(50)] + [(None, "null id"), (49, "text 7")]
    got = spotsigs.with_next(h.documents(spark, rows), ["text"]).select("doc_id", "text", "next_text").collect()
    ring = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [(i, t, ring[(k + 1) % len(ring)][1]) for k, (i, t) in enumerate(ring)]
    assert h.by_id(got) == h.by_id(want)
    assert [r["near_next"] for r in spotsigs.fingerprint_edits(h.documents(spark, [(1, "the old man and the sea")])).collect()] == [1.0]
    assert spotsigs.fingerprint_edits(h.documents(spark, [])).collect() == []


def test_near_copies_by_signatures(spark):
    rng = random.Random(9)
    words = [*h.vocabulary(rng, 60), "the", "of", "and"] * 2
    rows = []
    for family in range(6):
        base = h.sentence(rng, 60, words).split()
        for i in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((family * 10 + i, " ".join(w)))
    got = {(r["doc_a"], r["doc_b"]): r["likeness"] for r in spotsigs.near_copies(h.documents(spark, rows)).collect()}
    sets, first = {}, {}
    for doc_id, text in rows:
        first.setdefault(frozenset(chains(text)), doc_id)
    sets = {d: s for s, d in first.items()}
    want = {}
    for a in sets:
        for b in sets:
            if (len(sets[a]), a) < (len(sets[b]), b):
                like = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if like >= 0.75:
                    want[(a, b)] = pytest.approx(like)
    assert got == want and want


def test_fingerprint_is_native(spark):
    plan = spotsigs.fingerprint_edits(h.documents(spark, h.odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert F  # plans are checked as text


def test_sketches_never_deny_a_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(base[: rng.integers(500, 4000)]) for _ in range(20)]
    sets += [np.unique(np.concatenate([base[:1000], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in (0, 100, 333, 334, 600)]
    bits = jaccard_join.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    words = [np.frombuffer(b, np.uint64) for b in bits]
    assert len({len(w) for w in words}) > 2
    allowed = denied = 0
    for a, x in zip(sets, words):
        for b, y in zip(sets, words):
            ok = bool(jaccard_join.may_link(x, len(a), y, len(b)))
            assert ok or not jaccard_join.linked(len(np.intersect1d(a, b)), len(a), len(b))
            allowed, denied = allowed + ok, denied + (not ok)
    assert allowed and denied
