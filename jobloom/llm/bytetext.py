"""Vectorised words and hashes of many texts at once, on their UTF-8 bytes.

Tasks get texts as Arrow columns. `chunks` cuts a column into runs of whole texts of about `limit`
bytes, so the arrays of a step stay small whatever the batch holds; a text is never cut. All hashes
are 64-bit, equal for equal input in every task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
# Odd multipliers of the polynomial hashes; the second pair makes an independent check hash.
BASE = 0x9E3779B97F4A7C15
CHECK_BASE = 0xC2B2AE3D27D4EB4F
MASK64 = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Word bytes of the contamination contract: digits, a-z and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept per process."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that any bits can serve as a bucket or an order."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Chunk:
    """Whole texts lo..hi of a column: their bytes and where each begins (one entry more than texts)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a string column in order; a null counts as an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    if n == 0:
        return
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Words:
    """Words of a chunk: byte spans, the text each belongs to and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # index of each text's first word, one entry more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(chunk: Chunk, data: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes for which `kind` holds, never across texts."""
    n = len(data)
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = chunk.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, chunk.offsets)
    text = np.repeat(np.arange(chunk.n), np.diff(first))
    return Words(start, end, text, first)


def prefix_hashes(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """P[i]: polynomial hash of the first i bytes; `span_hashes` compares any two substrings by it."""
    p, _ = powers(base, len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    _, inverse = powers(base, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    return span_hashes(prefix_hashes(data), w.start, w.end)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for each i; the caller keeps those within one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    m = 1
    for j in range(k):
        m = (m * 0xD1342543DE82EF95 + 1) & MASK64 | 1
        out += hashes[j : j + n] * np.uint64(m)
    return mix(out)


def fold(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo `modulus`."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def text_arrays(values: list[bytes]) -> tuple[Chunk, np.ndarray]:
    """A chunk of the given byte strings."""
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    data = np.frombuffer(b"".join(values), np.uint8)
    return Chunk(0, len(values), data, offsets), data
