"""Alignment of two tokenizations against a brute-force version."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobloom.llm import token_align as ta
from tests.llm import helpers as h


@pytest.fixture(scope="module")
def tokenizers():
    with open(f"{ta.TOKENIZERS}/{ta.BYTE_BPE}", encoding="utf-8") as a, open(f"{ta.TOKENIZERS}/{ta.PIECE_BPE}", "rb") as b:
        return ta.Tokenizers(a.read(), b.read())


def spans(ids, spelled):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(spelled[i]), i))
        at += len(spelled[i])
    return out


def brute(rows, tk):
    """[(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum)] by comparing all tokens of a text."""
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = tk.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = tk.b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(tk.of_a.spelled[i] for i in a) != want or b"".join(tk.of_b.spelled[i] for i in b) != want:
            a, b = [], []
        a, b = spans(a, tk.of_a.spelled), spans(b, tk.of_b.spelled)
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        groups = []
        for lo, hi in zip([0, *ends], ends):
            sides = [",".join(str(t[2]) for t in side if lo <= t[0] and t[1] <= hi) for side in (a, b)]
            groups.append("|".join(sides))
        docs.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (i, na, nb, g, len(links), text, sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links))
        for i, na, nb, g, links, text in docs
    ]


def texts():
    rng = random.Random(4)
    words = h.vocabulary(rng)
    odd = [
        None, "", " ", "  two  blanks ", "a▁b", "▁", "tab\tand\n\nlines \r\n", "<|endoftext|> <s> </s> <unk> <0x41>",
        "naïve ﬁ ① 漢字 русский 👩‍👩‍👧 é", "don't we'll I'm 12345 3.14159", "x" * 700, " 　wide", "\x00nul\x7f", "é" * 90,
    ]
    rows = list(enumerate(odd))
    rows += [(100 + i, h.sentence(rng, rng.randint(1, 60), words)) for i in range(40)]
    rows += [(100, rows[-1][1]), (None, "no id here"), (None, "no id here")]
    return rows


def columns(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()]


@pytest.mark.parametrize("shared", [ta.SHARED_PAIRS, 40, 0])
def test_alignment(spark, tokenizers, shared):
    rows = texts()
    df = h.documents(spark, rows).withColumn("groups", F.lit("x")).withColumn("links", F.lit("y")).withColumn("row", F.lit(1))
    got = columns(ta.with_counts(ta.align_documents(df), shared))
    assert h.by_id(got) == h.by_id(brute(rows, tokenizers))


def test_small_memo_changes_nothing(tokenizers, monkeypatch):
    part = [t or "" for _, t in texts()]
    whole = ta.Aligner(tokenizers).align(part)
    monkeypatch.setattr(ta, "MEMO_TOKENS", 5)
    aligner = ta.Aligner(tokenizers)
    for i, text in enumerate(part):
        assert aligner.align([text]).to_pylist()[0] == whole.slice(i, 1).to_pylist()[0]


def test_very_long_text(spark, tokenizers):
    rng = random.Random(9)
    words = h.vocabulary(rng)
    long = h.sentence(rng, 60_000, words)
    rows = [(1, long), (2, "y" * 20_000), (3, "short one")]
    got = {r["doc_id"]: r for r in ta.align_tokenizers(h.documents(spark, rows)).collect()}
    a, b = spans(tokenizers.a.encode(" " + long).ids, tokenizers.of_a.spelled), spans(tokenizers.b.encode(long), tokenizers.of_b.spelled)
    ends_a, ends_b = {x[1] for x in a}, {x[1] for x in b}
    assert (got[1]["n_a"], got[1]["n_b"], got[1]["n_groups"], got[1]["n_links"]) == (len(a), len(b), len(ends_a & ends_b), len(ends_a | ends_b))
    assert got[2]["n_links"] >= max(got[2]["n_a"], got[2]["n_b"])


def test_empty_table(spark):
    assert ta.align_tokenizers(h.documents(spark, [])).collect() == []


def test_ranks_give_the_same_ids(tokenizers):
    rng = random.Random(2)
    letters = [chr(c) for c in [*range(9, 127), *range(0xA0, 0x180), *range(0x400, 0x460), 0x85, 0x2028, 0x3000, 0x4E00, 0x1F600]]
    spelled = [s.decode("utf-8", "ignore") for s in tokenizers.of_a.spelled]
    words = ["".join(rng.choice(letters if rng.random() < 0.5 else "etaoin shrdlu") for _ in range(rng.randint(1, 30))) for _ in range(20_000)]
    words += spelled + [rng.choice(spelled) + rng.choice(spelled) for _ in range(20_000)] + ["<|endoftext|>", "a" * 5000]
    by_merges = [e.ids for e in tokenizers.a.encode_batch_fast(words, add_special_tokens=False)]
    assert [tokenizers.ranked.encode_ordinary(w) for w in words] == by_merges


def test_links_pack_and_unpack():
    import numpy as np
    import pyarrow as pa

    rows = [(np.array([3, 9, 1 << 47]), np.array([1, 2, 70_000])), (np.zeros(0, np.int64), np.zeros(0, np.int64)), (np.array([5]), np.array([4]))]
    owner, codes, times = ta.unpack(pa.array([ta.pack(c, t) for c, t in rows], pa.binary()))
    assert (owner.tolist(), codes.tolist(), times.tolist()) == ([0, 0, 0, 2], [3, 9, 1 << 47, 5], [1, 2, 70_000, 4])


def test_texts_that_never_repeat_are_aligned_on_arrays(tokenizers):
    """Every window of such texts is new, so nothing is gained by remembering any; Python steps per token or word would show."""
    import sys

    rng = random.Random(11)
    part = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(9)) for _ in range(400)) for _ in range(20)]
    aligner, steps = ta.Aligner(tokenizers), 0

    def traced(frame, event, _):
        nonlocal steps
        steps += event == "line"
        return traced if frame.f_code.co_filename == ta.__file__ else None

    sys.settrace(traced)
    try:
        got = aligner.align(part)
    finally:
        sys.settrace(None)
    assert steps < 8_000
    assert [tuple(r.values())[:5] for r in got.to_pylist()] == [(*r[1:5], r[5]) for r in brute(list(enumerate(part)), tokenizers)]
