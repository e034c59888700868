"""The text cleaner on Arrow batches: numpy classifies the bytes of many texts and cuts them together."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18  # bytes of text cut at a time; a longer text is cut alone
UNSURE = "\n"  # returned for a text with characters that not all versions of Unicode class alike

WORD, END, BLANK, LINE = 1, 2, 4, 8
KINDS = bytes(
    WORD if chr(b).isalnum() and b < 128 else LINE | BLANK if b in b"\t\n" else BLANK if b in b" \x0b\f\r" else END if b in b".!?" else 0
    for b in range(256)
)
LETTER, UNKNOWN = 1, 2


def _class(point: int) -> int:
    """Letters and numbers are known as such where Unicode has long had them, all others where they are assigned."""
    kind = unicodedata.category(chr(point))
    if kind == "Cn":
        return UNKNOWN
    if kind[0] not in "LN":
        return 0
    return LETTER if unicodedata.ucd_3_2_0.category(chr(point)) != "Cn" else UNKNOWN


@cache
def _classes() -> np.ndarray:
    return np.array([_class(p) for p in range(1 << 16)], np.uint8)


def _classified(points: np.ndarray) -> np.ndarray:
    out = _classes()[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        some, at = np.unique(points[high], return_inverse=True)
        out[high] = np.array([_class(int(p)) for p in some], np.uint8)[at]
    return out


def _code_points(t: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the characters that begin at `lead`, and their numbers of bytes."""
    one, two, three, four = (t[np.minimum(lead + k, len(t) - 1)].astype(np.int64) for k in range(4))
    size = 2 + (one >= 0xE0) + (one >= 0xF0)
    points = np.where(
        size == 2,
        (one & 0x1F) << 6 | two & 0x3F,
        np.where(
            size == 3,
            (one & 0x0F) << 12 | (two & 0x3F) << 6 | three & 0x3F,
            (one & 0x07) << 18 | (two & 0x3F) << 12 | (three & 0x3F) << 6 | four & 0x3F,
        ),
    )
    return np.minimum(points, 0x10FFFF), size


def _blank_tags(t: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> None:
    """A `<`, all up to the next `>` of its text, and that: one blank."""
    less, more = np.flatnonzero(t == ord("<")), np.flatnonzero(t == ord(">"))
    close = np.searchsorted(more, less)
    less, close = less[close < len(more)], close[close < len(more)]
    same = np.searchsorted(bounds, less, "right") == np.searchsorted(bounds, more[close], "right")
    close, first = np.unique(close[same], return_index=True)
    begin, end = less[same][first], more[close]
    step = np.zeros(len(t) + 1, np.int8)
    step[begin] = 1
    step[end + 1] -= 1
    kinds[np.cumsum(step[:-1], dtype=np.int8) > 0] = 0
    kinds[begin] = BLANK


def _cut(t: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end, `bounds` being where each begins and the end of all: the clean bytes, their number per text, the unsure texts."""
    kinds = np.frombuffer(bytearray(t).translate(KINDS), np.uint8)
    unsure, sizes = np.zeros(len(bounds) - 1, bool), np.zeros(len(bounds) - 1, np.int64)
    lead = np.flatnonzero(t >= 0xC0)
    if len(lead):
        points, size = _code_points(t, lead)
        classes = _classified(points)
        unsure[np.searchsorted(bounds, lead[classes == UNKNOWN], "right") - 1] = True
        letter, size = lead[classes == LETTER], size[classes == LETTER]
        for k in range(4):
            kinds[letter[size > k] + k] = WORD
    if (t == ord("<")).any():
        _blank_tags(t, bounds, kinds)
    word = kinds == WORD
    breaks = (kinds & LINE) > 0
    breaks[:-1] |= ((kinds[:-1] & END) > 0) & ((kinds[1:] & BLANK) > 0)
    texts = bounds[:-1][bounds[:-1] < len(t)]
    breaks[texts] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    first[texts] = word[texts]
    last[:-1] &= ~word[1:]
    last[texts[texts > 0] - 1] = word[texts[texts > 0] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sentence = np.cumsum(breaks, dtype=np.int32)[begin]
    new = np.flatnonzero(np.diff(sentence, prepend=-1))
    words = np.diff(new, append=len(begin))
    kept = np.repeat(words >= min_words, words)
    begin, end, sentence = begin[kept], end[kept], sentence[kept]
    if not len(begin):
        return t[:0], sizes, unsure
    at = np.searchsorted(begin, bounds)
    followed = np.ones(len(begin), bool)
    followed[at[1:][at[1:] > at[:-1]] - 1] = False
    between = np.where(np.diff(sentence, append=-1) != 0, ord("\t"), ord(" "))
    # Words and what lies between them in turn; behind a word that another follows, one byte is kept for the separator.
    runs = np.diff(np.column_stack([begin, end]).ravel(), prepend=0, append=len(t))
    take = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    take[end[followed]] = True
    out = t.copy()
    out[end[followed]] = between[followed]
    ends = np.concatenate([[0], np.cumsum(end - begin + followed)])
    return out[take], ends[at[1:]] - ends[at[:-1]], unsure


def clean_batch(texts: pa.Array, min_words: int) -> pa.Array:
    """Clean sentences of lower-case texts as `text.cleaner` defines them, null if there are none, `UNSURE` for unsure texts."""
    kind, min_words = texts.type, max(min_words, 1)
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    t = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    parts, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        if bounds[i] < bounds[j]:
            parts.append(_cut(t[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], min_words))
        else:
            parts.append((t[:0], np.zeros(j - i, np.int64), np.zeros(j - i, bool)))
        i = j
    out, sizes, unsure = (np.concatenate(x) for x in zip(*parts)) if parts else (t[:0], bounds[:0], np.zeros(0, bool))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    whole = np.packbits(sizes > 0, bitorder="little")
    clean = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(out), pa.py_buffer(whole))
    return (pc.if_else(pa.array(unsure), UNSURE, clean) if unsure.any() else clean).cast(kind)
