"""Conversation repair against a search of all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from jobloom.llm import turn_repair as tr
from tests.llm import helpers as h

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def faults_of(rows):
    """[(role, text, fault)] of ordered rows."""
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.strip(WHITE)
        fault = None
        if not stripped:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif stripped[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by expanding partial audits in order of cost, then of their letters."""
    pattern = re.compile(r"(s?(ua)+)?")
    heap = [(0, "", 0, ())]
    best = None
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        initials = "".join(r[:1] or "?" for r, _ in out)
        if at == len(rows) and pattern.fullmatch(initials):
            found = (cost, audit, out)
            best = found if best is None or found[:2] < best[:2] else best
        if best is not None and cost + 2 > best[0] and at == len(rows):
            continue
        options = [("I", 2, 0, (who, "")) for who in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            options.append(("D", 3, 1, None))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options.append(("K", extra, 1, (role, text)))
                options += [("R", 2 + extra, 1, (who, text)) for who in ("user", "assistant")]
        for letter, more, step, row in options:
            new = out if row is None else (*out, row)
            initials = "".join(r[:1] or "?" for r, _ in new)
            if re.fullmatch(r"s?(ua)*u?", initials):
                heapq.heappush(heap, (cost + more, audit + letter, at + step, new))
    return best


def expected(conversations, damage=True):
    """Summary rows by conversation of (conv_id, turn, role, text) rows."""
    out, every = [], {}
    for conv_id, turn, role, text in conversations:
        group = every.setdefault(conv_id, [])
        blank = lambda v: " " if v is None else v
        role, text = blank(role), blank(text)
        kind = zlib.crc32(f"{blank(conv_id)}:{blank(turn)}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        group += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv_id, rows in every.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marked = faults_of(rows)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for r, _, _ in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = cheapest(marked)
        counts = [sum(f == name for _, _, f in marked) for name in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv_id, gaps, *counts, illegal, cost, audit, digest))
    return out


def conversations(seed, n=60, longest=7):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", "  \n", "A long one, it goes on?", "cut off here", "Good. ", "tail.\x0b", "ü…"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u2", "", None])
            number = None if rng.random() < 0.08 else turn + rng.choice([0, 0, 0, 1, 3])
            rows.append((None if conv == 3 else conv, number, role, rng.choice([None, *texts])))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in ("kind", "copy", "again", "same", "fault", "audit", "cost", "of", "place", "edit")])


COLUMNS = ["conv_id", *tr.SUMMARY, "audit", "repaired_sha256"]


def summary(df):
    return h.by_id(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_of_damaged_conversations(spark, seed):
    rows = conversations(seed)
    assert summary(tr.repair_damaged(frame(spark, rows))) == h.by_id(expected(rows))


def test_conversations_without_turns_left(spark):
    gone = [i for i in range(2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:5]
    rows = [(i, 0, "user", "Hello.") for i in gone] + [(9999, 1, "user", "Hi.")]
    assert summary(tr.repair_damaged(frame(spark, rows))) == h.by_id(
        [*[(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in gone], *expected(rows[-1:])]
    )


@pytest.mark.parametrize("modulus", [tr.MODULUS, 5, 1])
def test_ties_and_hash_collisions(monkeypatch, modulus):
    """Every order of two audits, also where all hashes are alike."""
    monkeypatch.setattr(tr, "MODULUS", modulus)
    rng = random.Random(5)
    nodes = [tr.Audit()]
    for _ in range(400):
        nodes.append(tr.Audit(rng.choice(nodes[-20:]), rng.choice("DIKR")))
    for _ in range(3000):
        x, y = rng.choice(nodes), rng.choice(nodes)
        assert tr.before(x, y) == (x.letters() < y.letters())


def stream(rows):
    talk, out = tr.Conversation(), []
    for i, (role, text, fault) in enumerate(faults_of(rows)):
        talk.feed(i, role, text, fault)
        if (i + 1) % tr.SETTLE == 0:
            out += talk.settle()
    cost, rest = talk.finish()
    return cost, "".join(talk.audit), [(r, t) for _, r, t, _ in out + rest], talk


@pytest.mark.parametrize("seed", range(6))
def test_settling_changes_nothing(monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b!", "cut", "", f"text {i}."])) for i in range(400)]
    whole = stream(rows)
    monkeypatch.setattr(tr, "SETTLE", 3)
    pieces = stream(rows)
    assert whole[:3] == pieces[:3]


def test_long_conversations_are_settled_on_the_way():
    rng = random.Random(1)
    talk, most = tr.Conversation(), 0
    for i in range(20_000):
        talk.feed(i, rng.choice(["user", "assistant"]), f"turn {i}.", None)
        if (i + 1) % tr.SETTLE == 0:
            talk.settle()
            most = max(most, len(talk.open))
    assert most < 200


def test_repaired_turns(spark):
    rows = conversations(8)
    got = {}
    for r in tr.repaired_turns(frame(spark, rows)).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    want = {r[0]: r[-1] for r in expected(rows, damage=False)}
    empty = hashlib.sha256(b"").hexdigest()
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in got.items()} == {k: v for k, v in want.items() if v != empty}


def test_very_long_text_and_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(3000)] + [(2, 0, "user", "word " * 200_000 + ".")]
    got = {r["conv_id"]: r for r in tr.audit_conversations(frame(spark, rows)).collect()}
    assert (got[1]["cost"], got[1]["audit"], got[2]["audit"]) == (0, "K" * 3000, "KI")
    lines = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:Turn {i}." for i in range(3000))
    assert got[1]["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest()


def test_empty_table(spark):
    assert tr.repair_damaged(frame(spark, [])).collect() == []
    assert tr.repaired_turns(frame(spark, [])).collect() == []
