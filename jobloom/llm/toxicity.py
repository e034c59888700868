"""Toxicity behind a noisy channel.

Words that may hide another one (digits or signs for letters, letters repeated, letters spaced out)
are read as lattices of the characters they may stand for; the Viterbi path under a character
trigram model restores them. A plain word has a single path, itself, so only the others are decoded.
Four and more single characters apart from one another, whatever white space and text surround them, are
read as one run, in which every learned word of four letters and more is looked for.
The restored words and their beginnings carry log-odds learned from labelled documents, and a
document's score follows its most telling word.

Learning uses every labelled row outside the held-out fold; every text is scored whole. Defined
results: null, empty and wordless texts get the score of a document without telling words; repeated
rows score alike; without labelled rows every score is the neutral prior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm import bytetext as bt

MIN_TOXIC_DOCS = 8
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
MEMO_WORDS = 400_000
# Which letters a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SUBSTITUTE, DROP_REPEAT, DROP_SIGN, DROP_MARK = 0.7, 1.5, 25.0, 1.0  # channel costs, in nats
# A letter and a sign that stands for one, a letter three times, or letters with marks in between.
HIDING = re.compile(r"[^\W\d_].*[013456789@$!|+(€]|[013456789@$!|+(€].*[^\W\d_]|(.)\1\1|\w[^\w\s]\w[^\w\s]\w")
MARKS = re.compile(r"^[^\w@$!|+(€]+|(?:[^\w@$|+(€]|([@$|+(€])\1{2,})+$")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){3,}(?!\S)")


@dataclass
class CharModel:
    """Character trigrams with backed-off counts; `cost` is the negative log probability."""

    trigrams: dict[str, int]
    bigrams: Counter = field(default_factory=Counter)
    singles: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        for gram, n in self.trigrams.items():
            self.bigrams[gram[:2]] += n
            self.singles[gram[2]] += n
        self.total = sum(self.singles.values())
        self.kept: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        out = self.kept.get(gram)
        if out is None:
            low = (self.singles[gram[2]] + 0.5) / (self.total + 50)
            out = self.kept[gram] = -math.log((self.trigrams.get(gram, 0) + 2 * low) / (self.bigrams[gram[:2]] + 2))
        return out


def decode(seen: str, model: CharModel) -> str:
    """The likeliest reading of a lower-case string: the Viterbi path through its lattice."""
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for i, ch in enumerate(seen):
        if ch.isalpha():
            arcs = [(ch, 0.0)]
            # Doubled letters are ordinary; of three and more, all but one may go.
            if i and seen[i - 1] == ch and (seen[i - 2 : i] == ch * 2 or seen[i + 1 : i + 2] == ch):
                arcs.append(("", DROP_REPEAT))
        elif ch in STANDS_FOR:
            arcs = [(c, SUBSTITUTE) for c in STANDS_FOR[ch]] + [("", DROP_SIGN)]
        else:
            arcs = [("", DROP_MARK)]
        new: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, path) in states.items():
            for letter, price in arcs:
                if letter:
                    to, total, way = state[1] + letter, cost + price + model.cost(state + letter), (letter, path)
                else:
                    to, total, way = state, cost + price, path
                if to not in new or total < new[to][0]:
                    new[to] = (total, way)
        states = new
    best = min(states.items(), key=lambda x: (x[1][0] + model.cost(x[0] + "$"), x[0]))
    out, path = [], best[1][1]
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def readings(token: str, model: CharModel) -> list[str]:
    """The words a lower-case token may be: itself without marks and, if it may hide one, its restoration."""
    plain = EDGE.sub("", token)
    core = MARKS.sub("", token)
    out = [plain] if plain else []
    if HIDING.search(core) and sum(map(str.isalpha, core)) >= 2:
        out.append(decode(core, model))
    return out


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


@dataclass
class Model:
    odds: dict[str, float]
    chars: CharModel
    slope: float = 1.0
    offset: float = -2.0

    def __post_init__(self) -> None:
        self.longest = max((len(f) for f in self.odds if not f.endswith("*")), default=0)

    def word_score(self, token: str) -> float:
        return max((self.odds.get(f, 0.0) for w in readings(token, self.chars) for f in features(w)), default=0.0)

    def spaced_score(self, text: str) -> float:
        """The best word inside runs of single characters."""
        best = 0.0
        for m in SPACED.finditer(text):
            run = "".join(m.group().split())
            run = decode(run, self.chars) if not run.isalpha() else run
            for i in range(len(run)):
                for j in range(i + 4, min(len(run), i + self.longest) + 1):
                    best = max(best, self.odds.get(run[i:j], 0.0))
        return best

    def score(self, odds: float) -> float:
        return 1 / (1 + math.exp(-(self.offset + self.slope * odds)))


class Memo(dict):
    """Word scores of a task, worked out once per word."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= MEMO_WORDS:
            self.clear()
        out = self[token] = self.model.word_score(token)
        return out


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def calibrate(
    odds: np.ndarray, labels: np.ndarray, slope: float, offset: float, steps: int = 50, n: np.ndarray | float = 1.0
) -> tuple[float, float]:
    """Logistic slope and offset for the odds of documents that did not teach them, `n` of each kind, held near the given ones by a weak prior."""
    x = np.column_stack([odds, np.ones(len(odds))])
    start = np.array([slope, offset])
    prior = np.diag([4.0, 0.1])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((n * (np.logaddexp(0, z) - labels * z)).sum() + 0.5 * (beta - start) @ prior @ (beta - start))

    beta = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        gradient = x.T @ (n * (labels - p)) - prior @ (beta - start)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + prior, gradient)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
    return float(max(beta[0], 0.05)), float(beta[1])


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, text, label) of all labelled rows outside the held-out fold; the ids grow with the input, so they are merged, not sent around."""
    rows = labels.filter(~held_out(F.col("doc_id"), folds, fold) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    ids = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    texts = documents.filter(~held_out(F.col("doc_id"), folds, fold)).select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(ids.hint("merge"), "doc_id").select("doc_id", "text", "label")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, limit: int) -> DataFrame:
    """(text, label) of at most `limit` labelled rows outside the held-out fold; the ids are few, so they go to the scan."""
    rows = labels.filter(~held_out(F.col("doc_id"), folds, fold) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    ids = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")


def train(documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> Model:
    """Log-odds of words and beginnings, and the character model, from labelled documents.

    Three of ten labelled documents only calibrate the score, with the odds the others taught.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, grams, docs = Counter(), Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                tokens = Counter((text or "").lower().split())
                words = {EDGE.sub("", t) for t in tokens} - {""}
                (toxic if label else clean).update({f for w in words for f in features(w)})
                docs[bool(label)] += 1
                for w in words:
                    if w.isalpha():
                        padded = f"^^{w}$"
                        grams.update(padded[i : i + 3] for i in range(len(w) + 1))
        rows = [("f", k, toxic[k], clean[k]) for k in toxic.keys() | clean.keys()]
        rows += [("g", k, n, 0) for k, n in grams.items()] + [("n", "docs", docs[1], docs[0])]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "t", "c"])

    rows = labelled_rows(documents, labels, "toxic", folds, fold)
    teaches = F.pmod(F.xxhash64("doc_id", F.lit("teach")), F.lit(10)) < 7
    counts = (
        rows.filter(teaches).mapInArrow(count, "kind string, key string, t bigint, c bigint")
        .groupBy("kind", "key")
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .filter((F.col("kind") != "f") | ((F.col("t") >= MIN_TOXIC_DOCS) & (F.col("t") > 2 * F.col("c"))))
        .collect()
    )
    n = [(r["t"], r["c"]) for r in counts if r["kind"] == "n"]
    toxic, clean = n[0] if n else (0, 0)
    odds = {
        r["key"]: math.log((r["t"] + 0.5) / (toxic + 1)) - math.log((r["c"] + 0.5) / (clean + 1)) for r in counts if r["kind"] == "f"
    }
    model = Model(odds, CharModel({r["key"]: r["t"] for r in counts if r["kind"] == "g"}), 1.0, math.log((toxic + 1) / (clean + 10)))
    # Odds come from the table, so there are no more kinds than learned words and beginnings, twice.
    tried = score(rows.filter(~teaches), model, ["label"]).groupBy("odds", "kept.label").count().orderBy("odds", "label").collect()
    if tried:
        found, truth, n = (np.array([float(r[c]) for r in tried]) for c in ("odds", "label", "count"))
        model.slope, model.offset = calibrate(found, truth, model.slope, model.offset, n=n)
    return model


def score(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(kept, odds, score) of every row, from its whole text: the columns in `keep` as a struct, and the odds of the most telling word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model)
        for batch in batches:
            texts = batch.column(1)
            odds_of, out = np.zeros(len(texts)), np.zeros(len(texts))
            for c in bt.chunks(texts):
                for i, text in enumerate(texts.slice(c.lo, c.n).to_pylist()):
                    text = (text or "").lower()
                    odds = max(map(memo.__getitem__, text.split()), default=0.0)
                    odds = max(odds, model.spaced_score(text))
                    odds_of[c.lo + i], out[c.lo + i] = odds, model.score(odds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odds_of), pa.array(out)], names=["kept", "odds", "score"])

    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"kept {dict(rows.dtypes)['kept']}, odds double, score double")


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = score(documents, train(documents, labels), ["doc_id"]).select("kept.doc_id", "score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
