"""Odd documents and brute-force versions of the corpus operators."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOWN = str.maketrans(UPPER, UPPER.lower())
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that documents may have besides their own, named like those the operators use inside.
CLASHING = ["score", "odds", "kept", "node", "n", "key", "count", "doc", "place", "hub", "label", "secrets", "redacted",
            "n_candidates", "text_hash", "id", "items", "row", "copies", "n_tokens", "sigs", "component_id", "first"]


def documents(spark, rows):
    """A documents table of (doc_id, text) pairs with the usual columns and many clashing ones."""
    full = [(i, t, "en", f"src{(i or 0) % 5}", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def vocabulary(rng, n=400):
    syllables = ["ba", "con", "de", "fi", "gul", "ha", "in", "jo", "ka", "lem", "mi", "no", "ort", "pa", "qui", "ran", "é"]
    return sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)})


def odd_rows(seed=3):
    """Nulls, empties, blanks, repeated rows, exact and near copies, one very long text and one long word."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "One two  three"), (5, "one TWO three")]
    base = sentence(rng, 120, words)
    rows += [(6, base), (7, base), (7, base), (8, base.upper())]
    for i in range(9, 20):
        w = base.split()
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, sentence(rng, rng.randint(5, 80), words)) for i in range(20, 40)]
    long = sentence(rng, 6000, words)
    rows += [(40, long), (41, long + " and one more"), (42, "x" * 3000), (None, base + " null id")]
    return rows


def space_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(DOWN)) if w]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(DOWN))


def fold(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def shingles(text):
    w = space_words(text)
    m = min(5, len(w))
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()


def near_classes(rows):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if find(j) == find(i) and r[0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return out


def contamination(rows, items):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)] by looking for every window everywhere."""
    windows = []
    for item_id, text in items:
        w = plain_words(text)
        m = min(13, len(w))
        windows += [(item_id, w[i : i + m]) for i in range(len(w) - m + 1)] if w else []
    out = []
    for doc_id, text in rows:
        w, hit, found = plain_words(text), set(), set()
        for item_id, window in windows:
            m = len(window)
            for i in range(len(w) - m + 1):
                if w[i : i + m] == window:
                    hit |= set(range(i, i + m))
                    found.add(item_id)
        names = sorted(str(i) for i in found)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def without_repeats(rows, span=100):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] by a dictionary of all spans, ids being distinct."""
    first, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - span + 1):
            if first.setdefault(raw[i : i + span], (doc_id, i)) != (doc_id, i):
                gone[i : i + span] = [True] * span
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))
