"""Removal of repeated byte strings across all documents, by hash-compared suffix sorts.

A byte goes if a `SPAN`-byte string that covers it also starts earlier in the corpus. Every span is
assigned to the anchor inside it, its `ANCHOR`-byte string with the smallest hash, so equal spans
share an anchor wherever they stand. Consecutive spans of one anchor form a run with a context, the
bytes they cover. Runs are dealt by anchor: of runs with equal contexts all but the first go whole,
which settles whole copies without looking at single spans. Where an anchor still has several
contexts, their spans are sorted as suffixes: a merge sort whose comparisons find the common
extension of two suffixes by binary search over prefix polynomial hashes; neighbours with a common
extension of a span are the same string, which their bytes then confirm. Anchors with very many
contexts are dealt span by span instead, through the same sort.

Tasks drop repeats among their own runs before the shuffle, so a string that is everywhere reaches
its anchor at most once per task.

Defined results: null and empty texts have no bytes; rows that repeat an id and text are one
document, rows that repeat only the id follow one another by a hash of their texts; a null id comes
before all others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import bytetext as bt
from jobloom.session import workspace

SPAN = 100
ANCHOR = 32
STRETCH = 1 << 19  # runs of a task compared with one another before the shuffle
MANY_CONTEXTS = 20_000  # of one anchor, from which its spans are dealt one by one
SORTED_AT_ONCE = 8_192  # contexts
LOW7 = np.uint64(127)
NO_ID = np.iinfo(np.int64).min
# A place packs start (36 bits), spans (7) and a tag of the text (20), in this order.
_START, _SPANS, _TAG = 27, 20, (1 << 20) - 1


def place_of(start: np.ndarray, spans: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << _START) | (spans.astype(np.int64) << _SPANS) | tag


def start_of(place: np.ndarray) -> np.ndarray:
    return place >> _START


def spans_of(place: np.ndarray) -> np.ndarray:
    return (place >> _SPANS) & 127


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def tags(chunk: bt.Chunk) -> np.ndarray:
    raw = chunk.data.tobytes()
    o = chunk.offsets
    return np.array([zlib.crc32(raw[o[i] : o[i + 1]]) & _TAG for i in range(chunk.n)], np.int64)


def runs(chunk: bt.Chunk) -> tuple[np.ndarray, ...]:
    """Runs of spans with one anchor: (anchor hash, context hash, text, start in the text, spans, tied).

    In a tied run some span holds its anchor twice, so equal spans may stand within the run itself.
    """
    n = len(chunk.data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool)
    prefix, check = bt.prefix_hashes(chunk.data), bt.prefix_hashes(chunk.data, bt.CHECK_BASE)
    at = np.arange(n - ANCHOR + 1)
    hashes = bt.span_hashes(prefix, at, at + ANCHOR)
    # The smallest hash of each span; its place rides in the lowest bits, modulo 128, once as it is and once reversed.
    place = at.astype(np.uint64) & LOW7
    least, other = (hashes & ~LOW7) | place, (hashes & ~LOW7) | (LOW7 - place)
    width, size = SPAN - ANCHOR + 1, 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        other = np.minimum(other[: len(other) - step], other[step:])
        size += step
    start = np.arange(n - SPAN + 1)
    text = np.searchsorted(chunk.offsets, start, "right") - 1
    whole = start + SPAN <= chunk.offsets[text + 1]
    start, text, least, other = start[whole], text[whole], least[whole], other[whole]
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool)
    anchor = start + (((least & LOW7).astype(np.int64) - start) % 128)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    spans = np.diff(np.append(first, len(start)))
    a, t = start[first], text[first]
    context = bt.span_hashes(check, a, a + spans - 1 + SPAN, bt.CHECK_BASE)
    tied = np.logical_or.reduceat((least & LOW7) != LOW7 - (other & LOW7), first)
    return least[first] & ~LOW7, context, t, a - chunk.offsets[t], spans, tied


RUN_SCHEMA = "anchor bigint, context bigint, doc bigint, place bigint, kind int"
LIVE, TIED, AGAIN = 0, 1, 2


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of the documents; kind AGAIN marks those whose context has an earlier run in this task."""
    kept: list[tuple[np.ndarray, ...]] = []
    held = 0

    def settle() -> pa.RecordBatch:
        anchor, context, doc, place, tied = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((place, doc, context, anchor))
        anchor, context, doc, place, tied = anchor[order], context[order], doc[order], place[order], tied[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(anchor)), 0))
        again = (doc != doc[first]) | (place != place[first])
        # Settled runs only pass through: deal them evenly.
        anchor = np.where(again, bt.mix(doc.view(np.uint64) ^ place.view(np.uint64)), anchor)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(place), pa.array(np.where(again, AGAIN, tied).astype(np.int32))],
            names=["anchor", "context", "doc", "place", "kind"],
        )

    for batch in batches:
        ids = ids_of(batch.column(0))
        for c in bt.chunks(batch.column(1)):
            anchor, context, text, start, spans, tied = runs(c)
            kept.append((anchor, context, ids[c.lo + text], place_of(start, spans, tags(c)[text]), tied))
            held += len(anchor)
            if held >= STRETCH:
                yield settle()
                kept, held = [], 0
    if kept:
        yield settle()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs in; out come those that go whole (`gone`), and the first of each context where the anchor has several or the run is tied."""
    last = None  # anchor, context, doc, place of the first run of the context at hand
    waiting = None  # the anchor's first context, sent on once a second one turns up
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, context, doc, place = (batch.column(i).to_numpy() for i in range(4))
        kind = batch.column(4).to_numpy()
        again = kind == AGAIN
        n = len(anchor)
        live = np.flatnonzero(~again)
        gone = again.copy()
        send = np.zeros(n, bool)
        extra: list[tuple[int, int, int]] = []
        if len(live):
            a, c, d, p = anchor[live], context[live], doc[live], place[live]
            new_anchor, new = np.ones(len(a), bool), np.ones(len(a), bool)
            new_anchor[1:] = a[1:] != a[:-1]
            new[1:] = new_anchor[1:] | (c[1:] != c[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            first_doc, first_place = d[first], p[first]
            if last is not None and a[0] == last[0]:
                new_anchor[0] = False
                if c[0] == last[1]:
                    new[0] = False
                    head = first == 0
                    first_doc = np.where(head, last[2], first_doc)
                    first_place = np.where(head, last[3], first_place)
            gone[live] = ~new & ((d != first_doc) | (p != first_place))
            # Firsts of contexts, in order; an anchor with a second context sends all its firsts.
            firsts = np.flatnonzero(new)
            if len(firsts):
                later = ~new_anchor[firsts]  # not the anchor's first context
                leads = np.append(later[1:] & (a[firsts[1:]] == a[firsts[:-1]]), False)
                send[live[firsts]] = later | leads | (kind[live[firsts]] == TIED)
                if later[0] and waiting is not None:
                    extra.append(waiting)
                    waiting = None
                end = firsts[-1]
                # Only an unsent first of the batch's last anchor may still have to go.
                waiting = None if send[live[end]] else (int(a[end]), int(d[end]), int(p[end]))
            last = (a[-1], c[-1], first_doc[-1], first_place[-1])
        out = np.flatnonzero(gone | send)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(anchor[out], np.array([x[0] for x in extra], np.int64))),
                pa.array(np.append(doc[out], np.array([x[1] for x in extra], np.int64))),
                pa.array(np.append(place[out], np.array([x[2] for x in extra], np.int64))),
                pa.array(np.append(gone[out], np.zeros(len(extra), bool))),
            ],
            names=["anchor", "doc", "place", "gone"],
        )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, tag known by place, wanted runs) in; the bytes of each run out, or of each span where the anchor has very many."""
    for batch in batches:
        keys, docs, places, data = [], [], [], []
        for text, doc, wanted in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer()
            tag = zlib.crc32(raw) & _TAG
            raw = raw.to_pybytes()
            for w in wanted.as_py():
                if w["place"] & _TAG != tag:
                    continue
                start, spans = w["place"] >> _START, (w["place"] >> _SPANS) & 127
                if w["many"]:
                    for s in range(start, start + spans):
                        piece = raw[s : s + SPAN]
                        keys.append(int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True))
                        docs.append(doc.as_py())
                        places.append((s << _START) | (1 << _SPANS) | tag)
                        data.append(piece)
                else:
                    keys.append(w["anchor"])
                    docs.append(doc.as_py())
                    places.append(w["place"])
                    data.append(raw[start : start + spans - 1 + SPAN])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(data, pa.binary())],
            names=["anchor", "doc", "place", "bytes"],
        )


class Suffixes:
    """A buffer whose suffixes are compared by their first `SPAN` bytes through prefix hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.append(data, np.zeros(1, np.uint8))
        self.prefix = bt.prefix_hashes(data)
        _, self.inverse = bt.powers(bt.BASE, len(data) + 1)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes x and y, at most `SPAN`: binary search for the longest equal hash."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), SPAN)
        prefix, inverse = self.prefix, self.inverse
        px, py, ix, iy = prefix[x], prefix[y], inverse[x], inverse[y]
        for _ in range(SPAN.bit_length()):
            mid = (low + high + 1) >> 1
            equal = (prefix[x + mid] - px) * ix == (prefix[y + mid] - py) * iy
            low = np.where(equal, mid, low)
            high = np.where(equal, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; `ties` says so where their spans are equal."""
        k = self.extension(x, y)
        full = k == SPAN
        inside = np.where(full, 0, k)
        return np.where(full, ties, self.data[x + inside] < self.data[y + inside])

    def sort(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Stable order of `starts` by group and suffix: by the first eight bytes, then by merging what they leave equal."""
        head = np.zeros(len(starts), np.uint64)
        for j in range(8):
            head = (head << np.uint64(8)) | self.data[starts + j]
        order = np.lexsort((head, group))
        head, group = head[order], group[order]
        new = np.ones(len(starts), bool)
        new[1:] = (head[1:] != head[:-1]) | (group[1:] != group[:-1])
        return order[self.merge(starts[order], np.cumsum(new))]

    def merge(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Stable order of `starts` by group (already ascending) and suffix: bottom-up merging inside all groups at once."""
        n = len(starts)
        order = np.arange(n)
        begin = np.searchsorted(group, group)
        end = np.searchsorted(group, group, "right")
        size = 1
        while True:
            at = np.arange(n)
            run = (at - begin) // size
            partner = begin + (run ^ 1) * size
            todo = np.flatnonzero(partner < end)
            if not len(todo):
                return order
            mine = starts[order[todo]]
            low, high = partner[todo].copy(), np.minimum(partner[todo] + size, end[todo])
            odd = (run[todo] & 1).astype(bool)
            open_ = np.flatnonzero(low < high)
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                # Elements of the right run go after equal ones of the left run.
                less = self.before(starts[order[mid]], mine[open_], odd[open_])
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            own = at[todo] - (begin[todo] + run[todo] * size)
            to = begin[todo] + (run[todo] & ~1) * size + own + (low - partner[todo])
            new = order.copy()
            new[to] = order[todo]
            order = new
            size *= 2


def repeated_spans(group: np.ndarray, doc: np.ndarray, place: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, place) of the spans that start earlier in another context of their group; groups ascend."""
    lengths = np.array([len(d) for d in data])
    buffer = np.frombuffer(b"".join(data), np.uint8)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    spans = spans_of(place)
    owner = np.repeat(np.arange(len(data)), spans)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
    starts = base[owner] + offset
    # Spans enter in corpus order within their group, and the sort is stable: the first of equals is the earliest.
    corpus = place_of(start_of(place)[owner] + offset, np.ones(len(owner), np.int64), place[owner] & _TAG)
    enter = np.lexsort((corpus, doc[owner], group[owner]))
    owner, starts, corpus = owner[enter], starts[enter], corpus[enter]
    suffixes = Suffixes(buffer)
    order = suffixes.sort(starts, group[owner])
    owner, starts, corpus = owner[order], starts[order], corpus[order]
    same = np.zeros(len(owner), bool)
    same[1:] = (group[owner[1:]] == group[owner[:-1]]) & (suffixes.extension(starts[1:], starts[:-1]) == SPAN)
    # Confirm on the bytes: equal hashes of unequal strings must not remove anything.
    for lo in range(0, len(same), 1 << 16):
        at = np.flatnonzero(same[lo : lo + (1 << 16)]) + lo
        window = np.arange(SPAN)
        same[at] = (buffer[starts[at][:, None] + window] == buffer[starts[at - 1][:, None] + window]).all(axis=1)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    d = doc[owner]
    repeat = same & ((d != d[first]) | (corpus != corpus[first]))
    return d[repeat], corpus[repeat]


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor in; repeated spans out, anchor by anchor in bounded batches."""
    held: list[pa.RecordBatch] = []

    def settle(table: pa.Table) -> pa.RecordBatch:
        doc, place = repeated_spans(
            table.column("anchor").to_numpy(), table.column("doc").to_numpy(), table.column("place").to_numpy(),
            [b.as_buffer().to_pybytes() for b in table.column("bytes")],
        )
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place)], names=["doc", "place"])

    rest: pa.Table | None = None
    for batch in batches:
        for lo in range(0, batch.num_rows, SORTED_AT_ONCE):
            piece = pa.Table.from_batches([batch.slice(lo, SORTED_AT_ONCE)])
            rest = piece if rest is None else pa.concat_tables([rest, piece])
            anchor = rest.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut and rest.num_rows >= SORTED_AT_ONCE:
                yield settle(rest.slice(0, cut))
                rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield settle(rest)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, places of spans that go) in; sizes and the hash of what is left out."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, places in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_py().encode()
            n_removed = n_spans = 0
            kept = raw
            if places.is_valid:
                place = places.values.to_numpy()
                place = place[(place & _TAG) == (zlib.crc32(raw) & _TAG)]
                if len(place):
                    start = start_of(place)
                    marks = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(marks, start, 1)
                    np.add.at(marks, start + spans_of(place) - 1 + SPAN, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    n_removed = int(gone.sum())
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            for column, value in zip(out, (len(raw), n_removed, n_spans, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): n_bytes, n_removed, n_spans and kept_sha256 of its text without repeats."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    split_at = workspace(spark, "runs")
    (
        docs.mapInArrow(_run_rows, RUN_SCHEMA)
        .repartition("anchor")
        .sortWithinPartitions("anchor", "context", "doc", "place")
        .mapInArrow(_split, "anchor bigint, doc bigint, place bigint, gone boolean")
        .write.parquet(split_at)
    )
    split = spark.read.parquet(split_at)
    open_runs = split.filter(~F.col("gone"))
    many = open_runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY_CONTEXTS).select("anchor", F.lit(True).alias("many"))
    wanted = (
        open_runs.join(many, "anchor", "left")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("anchor", "place", F.coalesce("many", F.lit(False)).alias("many"))).alias("wanted"))
    )
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    texts = docs.withColumn("doc", doc)
    spans_at = workspace(spark, "spans")
    (
        texts.join(wanted, "doc")
        .select("text", "doc", "wanted")
        .mapInArrow(_contexts, "anchor bigint, doc bigint, place bigint, bytes binary")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_sort_contexts, "doc bigint, place bigint")
        .write.parquet(spans_at)
    )
    gone = split.filter("gone").select("doc", "place").union(spark.read.parquet(spans_at)).groupBy("doc").agg(F.collect_list("place").alias("places"))
    return (
        texts.join(gone, "doc", "left")
        .select("doc_id", "text", "places")
        .mapInArrow(_strip, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    )
