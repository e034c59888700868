"""Alignment of two tokenizations of a text, by the byte offsets where their tokens end.

A text is tokenised whole by a byte-level BPE (A, on one space and the text) and by a piece BPE with
byte fallback (B, which adds the space). Byte offsets where tokens of both end cut it into groups, and
every pair of tokens whose bytes overlap is a link. The texts of a task are laid end to end and aligned
many at a time, on arrays of at most `MEMO_TOKENS` tokens (or one text) that are then forgotten.

How often each pair of ids is linked is counted over the whole corpus. Pairs are kept with their
documents as sorted codes; the most frequent (`SHARED_PAIRS` at most) go to all tasks with their
counts, all others are joined.

Defined results: null and empty texts, and texts whose tokens don't spell one space and the text
(U+2581 in a text, for one) have no tokens, all zeros and no groups. Special tokens inside a text are
plain text. Repeated rows each count, ids may be null, other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import bytetext as bt
from jobloom.llm.frequent import most_frequent
from jobloom.session import workspace

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
MEMO_TOKENS = 1 << 21  # tokens of both sides that are aligned at a time
SHARED_PAIRS = 1 << 20
STRETCH = 1 << 21  # links counted together in a task
SPACE_MARK = "▁"
SIGNS = (",", "|", ";", "")  # after an id: more of its side, the other side, the next group, nothing


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """The bytes of each id and their lengths."""

    spelled: list[bytes]

    def __post_init__(self) -> None:
        self.length = np.array([len(s) for s in self.spelled], np.int64)
        self.bytes = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.begin = np.cumsum(self.length) - self.length

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another."""
        size = self.length[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.begin[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


# Fixed values of byte-level vocabularies: the pattern that splits a text before the merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizers:
    """Both tokenizers from the contents of their files, with their vocabularies."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes) -> None:
        # One thread a task: Spark spreads the work.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        spelled = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(ch in letters for ch in token)
            spelled[i] = bytes(letters[ch] for ch in token) if known else token.encode()
        self.of_a = Vocabulary(spelled)
        self.ranked = self._by_ranks(json.loads(byte_bpe))
        self.b = SentencePieceProcessor(model_proto=piece_bpe)
        pieces = range(self.b.get_piece_size())
        self.of_b = Vocabulary(
            [
                bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE_MARK, " ").encode()
                for i in pieces
            ]
        )
        # Every id as a number and the sign that follows it, in the order of `SIGNS`.
        self.written = pa.array([f"{i}{sign}" for i in range(max(len(self.of_a.length), len(self.of_b.length))) for sign in SIGNS], pa.string())

    def _by_ranks(self, file: dict):
        """The same byte-level BPE by the ranks of its vocabulary, three times as fast, where its merges stand in the order of their ids."""
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        plain = file.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        ids = [model["vocab"].get(left + right, -1) for left, right in merges]
        if not plain or not ids or ids[0] < 0 or any(y <= x for x, y in zip(ids, ids[1:])):
            return None
        import tiktoken

        ranks = {self.of_a.spelled[i]: i for i in model["vocab"].values() if i <= ids[-1]}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts, how many each has) of both, none for texts that the tokens don't spell."""
        spaced = [" " + t for t in texts]
        if self.ranked is not None:
            a = list(map(self.ranked.encode_ordinary, spaced))
        else:
            a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        want = [s.encode() for s in spaced]
        size = np.array(list(map(len, want)), np.int64)
        ok = size > 1
        sides = []
        for vocabulary, ids in ((self.of_a, a), (self.of_b, b)):
            n = np.array(list(map(len, ids)), np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, n.sum())
            owner = np.repeat(np.arange(len(texts)), n)
            ok &= np.bincount(owner, vocabulary.length[flat], len(texts)) == size
            sides.append((vocabulary, flat, n, owner))
        for vocabulary, flat, _, owner in sides:
            spelled = vocabulary.spell(flat[ok[owner]])
            wrong = np.flatnonzero(spelled != np.frombuffer(b"".join(w for w, good in zip(want, ok) if good), np.uint8))
            good = np.flatnonzero(ok)
            ok[good[np.searchsorted(np.cumsum(size[good]), wrong, "right")]] = False
        (_, flat_a, n_a, owner_a), (_, flat_b, n_b, owner_b) = sides
        return (flat_a[ok[owner_a]], np.where(ok, n_a, 0)), (flat_b[ok[owner_b]], np.where(ok, n_b, 0))


_LOADED: dict[tuple[int, int], Tokenizers] = {}


def loaded(byte_bpe: str, piece_bpe: bytes) -> Tokenizers:
    """The tokenizers of a worker process, loaded once."""
    key = hash(byte_bpe), hash(piece_bpe)
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(byte_bpe, piece_bpe)
    return _LOADED[key]


def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distinct values of two ascending arrays; the stable sort merges runs in linear time."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return both[np.append(True, both[1:] != both[:-1])[: len(both)]]


def shared_values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The values that two strictly ascending arrays have in common."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return both[1:][both[1:] == both[:-1]]


class Aligner:
    """Alignments of texts by both tokenizers."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.tokenizers = tokenizers

    def align(self, texts: list[str]) -> pa.RecordBatch:
        """Per text: n_a, n_b, n_groups, n_links, groups, and its distinct links with how often each occurs."""
        (a, n_a), (b, n_b) = self.tokenizers.encode(texts)
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        block = (first_a + first_b)[:-1] // MEMO_TOKENS
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)] if texts else []
        parts = [
            self._align(a[first_a[lo] : first_a[hi]], n_a[lo:hi], b[first_b[lo] : first_b[hi]], n_b[lo:hi])
            for lo, hi in zip(edges, edges[1:])
        ]
        n_groups, n_links, groups, links = map(chain.from_iterable, zip(*parts)) if parts else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(n_a, pa.int64()),
                pa.array(n_b, pa.int64()),
                pa.array(list(n_groups), pa.int64()),
                pa.array(list(n_links), pa.int64()),
                pa.array(list(groups), pa.string()),
                pa.array(list(links), pa.binary()),
            ],
            names=["n_a", "n_b", "n_groups", "n_links", "groups", "links"],
        )

    def _align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[list[int], list[int], list[str], list[bytes]]:
        """n_groups, n_links, groups as text and packed links of texts that have `n_a` ids of `a` and `n_b` of `b`, one after another.

        The texts are laid end to end, so every offset where tokens end closes one link, of the tokens that hold
        the byte before it, and an offset where both end closes a group; the end of a text closes both.
        """
        of_a, of_b = self.tokenizers.of_a, self.tokenizers.of_b
        n = len(n_a)
        text_of = np.repeat(np.arange(n), n_a)
        end_a, end_b = np.cumsum(of_a.length[a]), np.cumsum(of_b.length[b])
        shared = shared_values(end_a, end_b)
        # Tokens up to the end of each group, and inside it.
        upto_a, upto_b = np.searchsorted(end_a, shared, "right"), np.searchsorted(end_b, shared, "right")
        size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        n_groups = np.bincount(text_of[upto_a - 1], minlength=n)
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[upto_a - 1] = 1
        sign_b[upto_b - 1] = 2
        sign_b[np.cumsum(n_b)[n_b > 0] - 1] = 3
        # A group's ids of A stand after all ids of earlier groups, its ids of B after its own of A as well.
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)] = a * np.int64(len(SIGNS)) + sign_a
        order[np.arange(len(b)) + np.repeat(upto_a, size_b)] = b * np.int64(len(SIGNS)) + sign_b
        at = pa.array(np.concatenate([[0], np.cumsum(n_a + n_b)]), pa.int64())
        groups = pc.binary_join(pa.LargeListArray.from_arrays(at, self.tokenizers.written.take(pa.array(order))), "").to_pylist()

        # Text, id of A and id of B in one number, far below 64 bits for vocabularies of up to a million.
        bits_a, bits_b = (len(v.length).bit_length() for v in (of_a, of_b))
        ends = merged(end_a, end_b)
        at_a = np.searchsorted(end_a, ends)
        n_links = np.bincount(text_of[at_a], minlength=n)
        links = (text_of << bits_a | a)[at_a] << bits_b | b[np.searchsorted(end_b, ends)]
        links.sort()
        first = np.flatnonzero(np.append(True, links[1:] != links[:-1])[: len(links)])
        times = np.diff(first, append=len(links))
        links = links[first]
        cuts = np.searchsorted(links, np.arange(n + 1) << (bits_a + bits_b)).tolist()
        codes = (links >> bits_b & ((1 << bits_a) - 1)) << 32 | links & ((1 << bits_b) - 1)
        packed = [pack(codes[lo:hi], times[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
        return n_groups.tolist(), n_links.tolist(), groups, packed


def pack(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending codes and how often each occurs, as differences in byte planes, which compress well."""
    both = np.concatenate([np.diff(codes, prepend=0), times.astype(np.int64)])
    return both.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, times) of all rows of a column of packed links."""
    codes, times, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for value in packed:
        both = np.ascontiguousarray(np.frombuffer(value.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
        n = len(both) // 2
        codes.append(np.cumsum(both[:n]))
        times.append(both[n:])
        sizes.append(n)
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate(codes), np.concatenate(times)


def _pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a column of packed links of about `STRETCH` links."""
    sizes = np.array([v.as_buffer().size // 16 for v in column], np.int64)
    block = np.cumsum(sizes) // STRETCH
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(column)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi > lo:
            yield lo, column.slice(lo, hi - lo)


def align_documents(documents: DataFrame, tokenizers: str = TOKENIZERS, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Per row of (doc_id, text): n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`) and its packed links.

    The tokenizer files are read by the driver from folder `tokenizers` and sent to the tasks.
    """
    with open(os.path.join(tokenizers, byte_bpe), encoding="utf-8") as f:
        file_a = f.read()
    with open(os.path.join(tokenizers, piece_bpe), "rb") as f:
        file_b = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(loaded(file_a, file_b))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for c in bt.chunks(texts):
                part = [t or "" for t in texts.slice(c.lo, c.n).to_pylist()]
                out = aligner.align(part)
                yield pa.RecordBatch.from_arrays([ids.slice(c.lo, c.n), *out.columns], names=["doc_id", *out.schema.names])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary"
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (code, count) of packed links, added up within stretches of a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def sums() -> pa.RecordBatch:
        codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([t for _, t in held]), len(codes)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "count"])

    for batch in batches:
        for _, part in _pieces(batch.column(0)):
            _, codes, times = unpack(part)
            held.append((codes, times))
            size += len(codes)
            if size >= STRETCH:
                yield sums()
                held, size = [], 0
    if held:
        yield sums()


def link_counts(aligned: DataFrame) -> DataFrame:
    """(code, count): how often each pair of ids is linked over all rows."""
    return aligned.select("links").mapInArrow(_count, "code bigint, count bigint").groupBy("code").agg(F.sum("count").alias("count"))


def with_counts(aligned: DataFrame, shared_pairs: int = SHARED_PAIRS) -> DataFrame:
    """The aligned rows without their links, but with n_best and count_sum.

    n_best counts the links whose pair is the most frequent of its id of B (ties included); count_sum adds up the counts.
    """
    spark = aligned.sparkSession
    at = workspace(spark, "aligned")
    aligned.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(at)
    stored = spark.read.parquet(at)
    counts_at = workspace(spark, "link-counts")
    link_counts(stored).write.parquet(counts_at)
    counts = spark.read.parquet(counts_at)
    # One row per id of B at most.
    of_b = counts.groupBy(F.col("code").bitwiseAND((1 << 32) - 1).alias("b")).agg(F.max("count").alias("best")).toArrow()
    best = np.zeros(int(max(of_b.column("b").to_numpy(), default=0)) + 1, np.int64)
    best[of_b.column("b").to_numpy()] = of_b.column("best").to_numpy()
    table = most_frequent(counts, shared_pairs).toArrow()
    order = np.argsort(table.column("code").to_numpy())
    shared, n_shared = table.column("code").to_numpy()[order], table.column("count").to_numpy()[order]

    def split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(shared):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        place = np.minimum(np.searchsorted(shared, codes), len(shared) - 1)
        return place, shared[place] == codes

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, part in _pieces(batch.column(1)):
                owner, codes, times = unpack(part)
                place, found = split(codes)
                owner, codes, times, n = owner[found] + lo, codes[found], times[found], n_shared[place[found]]
                np.add.at(total, owner, n * times)
                np.add.at(n_best, owner, np.where(best[codes & 0xFFFFFFFF] == n, times, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best), pa.array(total)], names=["row", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in _pieces(batch.column(1)):
                owner, codes, times = unpack(part)
                rare = ~split(codes)[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner[rare] + lo)),
                        pa.array(codes[rare]),
                        pa.array(times[rare]),
                        pa.array(best[codes[rare] & 0xFFFFFFFF]),
                    ],
                    names=["row", "code", "times", "best"],
                )

    links = stored.select("row", "links")
    sums = links.mapInArrow(known, "row bigint, n_best bigint, count_sum bigint")
    if counts.count() > len(shared):
        rest = links.mapInArrow(others, "row bigint, code bigint, times bigint, best bigint").join(counts, "code")
        is_best = F.when(F.col("count") == F.col("best"), F.col("times")).otherwise(0)
        rest = rest.groupBy("row").agg(F.sum(is_best).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
        sums = sums.union(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return stored.drop("links").join(sums, "row").drop("row")


def align_tokenizers(documents: DataFrame, tokenizers: str = TOKENIZERS, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Per row of `documents`: doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum."""
    return with_counts(align_documents(documents, tokenizers, byte_bpe, piece_bpe))
