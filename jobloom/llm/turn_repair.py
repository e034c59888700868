"""Repair of conversation structure by a dynamic program over persistent audits.

Turns are read in order (turn, nulls first; turns of one number by role and text). The first fault of
each counts: blank (nothing but white space), duplicate (role and text seen earlier in the
conversation), truncated (the last letter is no `.`, `!` or `?`). Edits turn the role initials into an
optional system turn and pairs of user and assistant: keep (K) costs 0, a new role (R) 2, deletion (D)
3 and is all that blank turns and duplicates may get, an inserted empty turn (I) 2; a truncated turn
that stays costs 1 more. Of all cheapest repairs the audit, the initials of its edits in order, is the
least by ASCII.

The program keeps one cheapest audit per state of the role pattern. Audits share their beginnings as
linked nodes, each with its ancestors at powers of two and a rolling hash, so two of them are compared
by a search for their longest common prefix; equal hashes are verified on the letters. Every step ends
in a turn's own edit, so no audit of a step begins another and the order of two survives whatever
follows. What all states have in common is settled and leaves the memory, turns and letters alike.

Conversations are dealt and sorted by Spark (in external sorts) and streamed: a task holds the turns
that are not settled yet, never a conversation. One conversation is one stream, since its repaired text
gets one hash.

Defined results: null roles and texts are one space; an empty role fits nowhere; null ids are one
conversation; null turns come first and take no part in gaps; repeated rows are duplicates; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1  # costs
# From any state, two insertions (4) and a deletion (3) at most make up for being in another, whatever
# follows. An audit that costs more than this above the cheapest is part of no cheapest repair.
SLACK = 2 * INSERT + DELETE
SETTLE = 1024  # turns between searches for what is settled
MODULUS, FACTOR = (1 << 61) - 1, 0x1F123BB5159A55E5
# States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL_PAIRS = {"su", "ua", "au"}


def wanted(state: int) -> str:
    """The role that an inserted or renamed turn takes."""
    return "assistant" if state == USER else "user"


class Audit:
    """A linked letter of an audit: the letters before it are shared with other audits."""

    __slots__ = ("letter", "length", "hash", "up")

    def __init__(self, before: Audit | None = None, letter: str = "") -> None:
        self.letter = letter
        if before is None:
            self.length, self.hash, self.up = 0, 0, []
            return
        self.length = before.length + 1
        self.hash = (before.hash * FACTOR + ord(letter)) % MODULUS
        # up[k] is the node 2**k letters back.
        self.up = up = [before]
        k = 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1

    def add(self, letters: str) -> Audit:
        node = self
        for letter in letters:
            node = Audit(node, letter)
        return node

    def back(self, steps: int) -> Audit:
        node, k = self, 0
        while steps:
            if steps & 1:
                node = node.up[k]
            steps >>= 1
            k += 1
        return node

    def letters(self, after: Audit | None = None) -> str:
        """The letters from the root, or from the node `after` on."""
        out, node = [], self
        while node.up and node is not after:
            out.append(node.letter)
            node = node.up[0]
        return "".join(reversed(out))


def same(x: Audit, y: Audit) -> bool:
    """Whether two audits of one length have the same letters; the walk ends at the node they share."""
    while x is not y:
        if x.letter != y.letter:
            return False
        x, y = x.up[0], y.up[0]
    return True


def before(x: Audit, y: Audit) -> bool:
    """Whether audit x is less than y by ASCII."""
    short = min(x.length, y.length)
    a, b = x.back(x.length - short), y.back(y.length - short)
    if a.hash == b.hash:
        if same(a, b):
            return x.length < y.length
        return x.letters() < y.letters()
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and a.up[k].hash != b.up[k].hash:
            a, b = a.up[k], b.up[k]
    if not same(a.up[0], b.up[0]):
        return x.letters() < y.letters()
    return a.letter < b.letter


@cache
def moves(initial: str, lost: bool, cut: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(state, next state, cost, letters) of the ways to treat one turn, with up to two insertions before it.

    Of equal pairs of states only the cheapest, least letters are listed.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in range(4):
        at = state
        for inserted in range(3):
            if inserted:
                at = NEXT[at, wanted(at)[0]]
            ways = [(DELETE, "D", at)]
            if not lost:
                if (at, initial) in NEXT:
                    ways.append((CUT * cut, "K", NEXT[at, initial]))
                ways.append((RENAME + CUT * cut, "R", NEXT[at, wanted(at)[0]]))
            for cost, letter, to in ways:
                way = (cost + INSERT * inserted, "I" * inserted + letter)
                best[state, to] = min(best.get((state, to), way), way)
    return tuple((state, to, cost, letters) for (state, to), (cost, letters) in best.items())


class Conversation:
    """The turns of one conversation, fed in order."""

    def __init__(self) -> None:
        root = Audit()
        self.states: dict[int, tuple[int, Audit]] = {START: (0, root)}
        self.root = root
        self.open: list[tuple[str, str, int | None]] = []  # turns that are not settled
        self.settled = START
        self.audit: list[str] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0
        self.initial: str | None = None
        self.low = self.high = self.last = None
        self.turns = 0

    def feed(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            if self.last is None or turn != self.last:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
        self.open.append((role, text, turn))
        found: dict[int, tuple[int, Audit]] = {}
        ways: dict[int, list[tuple[int, Audit, str]]] = {}
        for state, to, cost, letters in moves(initial, fault in ("blank", "duplicate"), fault == "truncated"):
            if state in self.states:
                spent, audit = self.states[state]
                ways.setdefault(to, []).append((spent + cost, audit, letters))
        for to, options in ways.items():
            least = min(o[0] for o in options)
            ties = [audit.add(letters) for spent, audit, letters in options if spent == least]
            first = ties[0]
            for other in ties[1:]:
                if before(other, first):
                    first = other
            found[to] = (least, first)
        limit = min(spent for spent, _ in found.values()) + SLACK
        self.states = {state: best for state, best in found.items() if best[0] <= limit}

    def settle(self) -> list[tuple[str, str, str, int | None]]:
        """Takes what the audits of all states have in common off the memory; returns its repaired turns."""
        audits = [a for _, a in self.states.values()]
        short = min(a.length for a in audits)
        level = [a.back(a.length - short) for a in audits]
        # The deepest node that all share: ancestors are nodes, so identity decides.
        for k in range(max(len(a.up) for a in level) - 1, -1, -1):
            if all(k < len(a.up) for a in level) and any(a.up[k] is not level[0].up[k] for a in level):
                level = [a.up[k] for a in level]
        common = level[0] if all(a is level[0] for a in level) else level[0].up[0]
        out = self._write(common.letters())
        # The rest is linked anew, shared nodes staying shared.
        fresh = {id(common): Audit()}
        states = {}
        for state, (spent, audit) in self.states.items():
            path, node = [], audit
            while id(node) not in fresh:
                path.append(node)
                node = node.up[0]
            copy = fresh[id(node)]
            for old in reversed(path):
                copy = fresh[id(old)] = Audit(copy, old.letter)
            states[state] = (spent, copy)
        self.states = states
        return out

    def _write(self, letters: str) -> list[tuple[str, str, str, int | None]]:
        """Applies settled letters: the repaired turns as (edit, role, text, turn)."""
        out, used, state = [], 0, self.settled
        for letter in letters:
            role, text, turn = wanted(state), "", None
            if letter != "I":
                kept_role, text, turn = self.open[used]
                used += 1
                if letter == "D":
                    continue
                role = kept_role if letter == "K" else role
            out.append((letter, role, text, turn))
            state = NEXT[state, role[:1]]
        self.open, self.settled = self.open[used:], state
        self.audit.append(letters)
        return out

    def finish(self) -> tuple[int, list[tuple[str, str, str, int | None]]]:
        """The cost, and the turns of the rest; `audit` is whole then."""
        best: tuple[int, Audit] | None = None
        for state, (spent, audit) in self.states.items():
            for _ in range({START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]):
                spent, audit = spent + INSERT, audit.add("I")
            if best is None or spent < best[0] or (spent == best[0] and before(audit, best[1])):
                best = (spent, audit)
        assert best is not None
        return best[0], self._write(best[1].letters())

    @property
    def gaps(self) -> int:
        return 0 if self.low is None or self.high is None else self.high - self.low + 1 - self.turns


def with_faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault) of the turns, dealt by conversation and sorted."""
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    ).repartition("conv_id")
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = rows.select("*", F.sha2(F.concat("role", F.lit("\0"), F.length("role").cast("string"), F.lit("\0"), "text"), 256).alias("same"))
    # Dealt by conversation already: this sorts within tasks and shuffles nothing.
    again = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault: Column = (
        F.when(trimmed == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    )
    rows = rows.withColumn("again", again).select("conv_id", "turn", "role", "text", fault.alias("fault"), "again")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again"]
    return rows.sortWithinPartitions(*order).drop("again")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Conversation, list, int | None]]:
    """(conv_id, conversation, repaired turns, cost) as they settle; the cost comes with the last of a conversation."""
    conv, talk, fed = None, None, 0
    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if talk is None or conv_id != conv:
                if talk is not None:
                    cost, rest = talk.finish()
                    yield conv, talk, rest, cost
                conv, talk, fed = conv_id, Conversation(), 0
            talk.feed(turn, role, text, fault)
            fed += 1
            if fed % SETTLE == 0:
                yield conv, talk, talk.settle(), None
    if talk is not None:
        cost, rest = talk.finish()
        yield conv, talk, rest, cost


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text, and the turn it was (null if inserted)."""
    kind = dict(turns.dtypes)["conv_id"]
    schema = pa.schema([("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("turn", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for conv_id, _, out, cost in _stream(batches):
            rows = [{"place": place + i, "edit": e, "role": r, "text": t, "turn": n} for i, (e, r, t, n) in enumerate(out)]
            part = pa.RecordBatch.from_pylist(rows, schema)
            ids = pa.array([conv_id] * len(rows), _arrow_type(kind))
            yield pa.RecordBatch.from_arrays([ids, *part.columns], names=["conv_id", *schema.names])
            place = 0 if cost is not None else place + len(out)

    return with_faults(turns).mapInArrow(run, f"conv_id {kind}, place bigint, edit string, role string, text string, turn bigint")


def _arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audit_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The hash is that of the repaired turns as `role:text` lines. Ids are whole numbers or strings.
    """
    kind = dict(turns.dtypes)["conv_id"]
    schema = pa.schema([("conv_id", _arrow_type(kind)), *[(c, pa.int64()) for c in SUMMARY], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first, done = hashlib.sha256(), True, []
        for conv_id, talk, out, cost in _stream(batches):
            for _, role, text, _ in out:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if cost is None:
                continue
            numbers = {"gaps": talk.gaps, **talk.faults, "illegal": talk.illegal, "cost": cost}
            done.append({"conv_id": conv_id, **numbers, "audit": "".join(talk.audit), "repaired_sha256": digest.hexdigest()})
            digest, first = hashlib.sha256(), True
            if len(done) == 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        yield pa.RecordBatch.from_pylist(done, schema)

    numbers = ", ".join(f"{c} bigint" for c in SUMMARY)
    return with_faults(turns).mapInArrow(run, f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults planted by crc32 of `conv_id:turn` (nulls: one space) modulo 20.

    0 drops the turn, 1 empties its text, 2 takes out its `.`, `!` and `?`, 3 repeats it, 4 makes it the user's.
    """
    conv_id, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The audit of every conversation after damage; those that lost all turns have zeros, an empty audit and the hash of nothing."""
    audits = audit_conversations(damaged(conversations)).withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct()
    empty = {**{c: F.lit(0).cast("bigint") for c in SUMMARY}, "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    joined = every.join(audits, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select("conv_id", *[F.coalesce(c, other).alias(c) for c, other in empty.items()])
