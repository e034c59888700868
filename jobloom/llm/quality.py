"""Quality by a vote of nearest labelled neighbours in a latent space.

A text's terms are its byte-class pairs, hashed lower-case words and a few repetition marks. Terms
are weighted by log frequency and rarity, and reduced to `RANK` latent dimensions by a singular
value decomposition of at most `SAMPLE` labelled texts (drawn by hash). Those texts' vectors go to
all tasks; each task multiplies its documents with all of them in blocks, so neighbours are exact,
and the `NEIGHBOURS` nearest vote with weights that grow with their cosine.

Every text is described whole. Defined results: a null text counts as empty; texts without bytes
have the zero vector and get the share of good labels; without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import bytetext as bt
from jobloom.llm.toxicity import held_out, labelled_sample

SAMPLE = 6_000
RANK = 48
NEIGHBOURS = 15
BLOCK = 512
THRESHOLD = 0.3
HASHED = 512

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "%", "*", "&", "$", "#"]
CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    CLASS[[ord(_c) for _c in _g]] = _i
CLASS[0x80:] = len(_GROUPS) + 1
N_CLASSES = len(_GROUPS) + 2
PAIRS = N_CLASSES * N_CLASSES
MARKS = 6
TERMS = PAIRS + HASHED + MARKS


def term_counts(chunk: bt.Chunk) -> np.ndarray:
    """Term counts of each text of a chunk, texts x TERMS."""
    n = chunk.n
    out = np.zeros((n, TERMS), np.float32)
    if len(chunk.data) == 0:
        return out
    owner = np.repeat(np.arange(n), np.diff(chunk.offsets))
    kinds = CLASS[chunk.data]
    same = owner[1:] == owner[:-1]
    pair = (owner[:-1] * PAIRS + kinds[:-1] * N_CLASSES + kinds[1:])[same]
    out[:, :PAIRS] = np.bincount(pair, minlength=n * PAIRS).reshape(n, PAIRS)
    data = bt.LOWER[chunk.data]
    w = bt.words(chunk, data, ~bt.SPACE)
    hashes = bt.word_hashes(data, w)
    out[:, PAIRS : PAIRS + HASHED] = np.bincount(
        w.text * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED
    ).reshape(n, HASHED)
    for k, lag in enumerate((1, 2, 3, 5)):
        again = (hashes[lag:] == hashes[:-lag]) & (w.text[lag:] == w.text[:-lag])
        out[:, PAIRS + HASHED + k] = np.bincount(w.text[lag:][again], minlength=n)
    # Words that the text has had before, and lines that it has had before.
    order = np.lexsort((hashes, w.text))
    h, t = hashes[order], w.text[order]
    again = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    out[:, PAIRS + HASHED + 4] = np.bincount(t[1:][again], minlength=n)
    lines = bt.words(chunk, data, np.arange(256) != 0x0A)
    line_hashes = bt.word_hashes(data, lines)
    order = np.lexsort((line_hashes, lines.text))
    h, t = line_hashes[order], lines.text[order]
    again = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    out[:, PAIRS + HASHED + 5] = 10 * np.bincount(t[1:][again], minlength=n)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    rarity: np.ndarray
    axes: np.ndarray  # TERMS x rank
    vectors: np.ndarray  # labelled texts x rank, unit rows
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit(weigh(counts, self.rarity) @ self.axes)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Scores of the given texts, block by block of `BLOCK` texts against all labelled vectors."""
        if len(self.labels) == 0:
            return np.full(len(counts), self.prior)
        mine = self.embed(counts)
        k = min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(counts))
        for lo in range(0, len(counts), BLOCK):
            cosine = mine[lo : lo + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.exp(20 * (np.take_along_axis(cosine, near, 1) - 1))
            out[lo : lo + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        empty = ~mine.any(axis=1)
        out[empty] = self.prior
        return np.clip(out, 0.0, 1.0)


def weigh(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Log frequencies relative to the text's length, times rarity."""
    size = counts[:, :PAIRS].sum(1, keepdims=True) + 1
    return np.log1p(1000 * counts / size) * rarity


def train(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Model:
    """The latent space and the labelled vectors. What reaches the driver is bounded by `SAMPLE` rows of term counts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in bt.chunks(batch.column(0)):
                counts = term_counts(c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(c.lo, c.n), pa.array([r.astype(np.float32).tobytes() for r in counts], pa.binary())],
                    names=["label", "counts"],
                )

    rows = labelled_sample(documents, labels, "quality", folds, fold, SAMPLE).select("text", "label").mapInArrow(describe, "label int, counts binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["counts"])))
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), np.float32).reshape(len(rows), TERMS)
    good = np.array([r["label"] for r in rows], float)
    rarity = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    weighted = weigh(counts, rarity)
    # The right singular vectors, from the TERMS x TERMS products.
    values, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    axes = np.ascontiguousarray(axes[:, ::-1][:, :RANK]).astype(np.float32)
    return Model(rarity, axes, unit(weighted @ axes), good, float(good.mean()))


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = train(documents, labels)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for c in bt.chunks(batch.column(1)):
                out[c.lo : c.hi] = model.vote(term_counts(c))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return (
        documents.select("doc_id", F.col("text").cast("string"))
        .mapInArrow(run, f"doc_id {kind}, score double")
        .select(
            "doc_id",
            held_out(F.col("doc_id"), 5, 0).alias("held_out"),
            "score",
            (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        )
    )
