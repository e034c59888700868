"""N-gram Jaccard join of documents through prefix trees.

A document is the set of its distinct five-word shingles, as 64-bit hashes; documents with equal
sets are one node. All sets follow one global order, rare shingles first: shingles seen often inside
the tasks that read the texts come last, by their counts, and hashes order the rest. Two linked sets
share one of the first `n - ceil(0.75 n) + 1` shingles of each, so nodes that share such a shingle
are candidates. They are not paired with one another: each is tied to the smallest node of the
shingle, its hub.

Ties are verified first; what they link needs no further comparison. Around every hub that still has
nodes of another component, those nodes are stored in a prefix tree (common shingles first, chains of
single children as one segment) and all nodes of the hub traverse it: a segment's overlap counts once
for all sets below it, and a subtree is left as soon as the sizes of its sets and what remains of
both sides can't reach the threshold. Large hubs are cut into blocks of both roles.

Sets are long, so only those travel that may matter: each node has a sketch of parity bits (twice its
shingles, `SKETCH` at least), in which two sets differ in at most as many bits as in shingles. Pairs whose sketches differ too much
can't be linked, and only the other nodes' sets are read again from their texts, picked by a Bloom
filter of bounded size.

Defined results: a document with fewer than five words has one shingle, all its words; null, empty
and wordless texts have none, are linked with nothing and form their own component; equal sets are
linked; rows that repeat an id are judged on their own texts; a null id never names a component
unless no other id is in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import bytetext as bt
from jobloom.llm.components import components
from jobloom.llm.frequent import most_frequent
from jobloom.session import workspace

SHINGLE = 5
NUM, DEN = 75, 100  # linked: DEN * intersection >= NUM * union
COMMON_IN_TASK = 4  # sets of one stretch of a task that hold a shingle, from which its count is passed on
STRETCH = 1 << 22  # hashes counted together in a task
COMMON = 1 << 18  # shingles with a counted place in the order (their table goes to all tasks: 4 MB)
TREE_SETS, PROBE_SETS = 512, 2048  # sets of a block in either role
SKETCH = 2048
BLOOM_BITS = 1 << 27  # at most; it goes to all tasks (16 MB)


def shingle_sets(chunk: bt.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingles of each text of a chunk, and where each text's begin."""
    data = bt.LOWER[chunk.data]
    w = bt.words(chunk, data, ~bt.SPACE)
    hashes = bt.word_hashes(data, w)
    grams = bt.gram_hashes(hashes, SHINGLE)
    ok = w.text[: len(grams)] == w.text[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    grams, text = grams[ok], w.text[: len(grams)][ok]
    for m in range(1, SHINGLE):
        own = np.flatnonzero(w.counts == m)
        if len(own):
            short = bt.mix(bt.gram_hashes(hashes, m)[w.first[own]] + np.uint64(m))
            grams, text = np.concatenate([grams, short]), np.concatenate([text, own])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(chunk.n + 1))


def node_ids(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, from all its shingles; 0 for empty sets."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(bt.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    sums = total[first[1:]] - total[first[:-1]]
    n = np.diff(first).astype(np.uint64)
    return np.where(n > 0, bt.mix(sums + n), np.uint64(0)).view(np.int64)


def sketches(grams: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set, the parities of its shingles in classes by their low bits: twice as many as shingles, a power of two."""
    n = np.diff(first)
    cells = np.maximum(SKETCH, 1 << np.ceil(np.log2(2 * np.maximum(n, 1))).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), n)
    out: list[bytes] = [b""] * len(n)
    for size in np.unique(cells):
        texts = np.flatnonzero(cells == size)
        local = np.full(len(n), -1)
        local[texts] = np.arange(len(texts))
        mine = local[owner] >= 0
        at = local[owner[mine]] * size + (grams[mine] & np.uint64(size - 1)).astype(np.int64)
        odd = (np.bincount(at, minlength=len(texts) * size) & 1).astype(np.uint8).reshape(len(texts), size)
        for i, row in zip(texts, np.packbits(odd, axis=1, bitorder="little"), strict=True):
            out[i] = row.tobytes()
    return out


def may_link(bits_a: np.ndarray, n_a: np.ndarray, bits_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether sketches (rows of 64-bit words) allow a link; exact in that it never denies one.

    The finer sketch is folded: the parities of a coarser class are those of its parts together.
    """
    while bits_a.shape[-1] > bits_b.shape[-1]:
        bits_a = bits_a[..., : bits_a.shape[-1] // 2] ^ bits_a[..., bits_a.shape[-1] // 2 :]
    while bits_b.shape[-1] > bits_a.shape[-1]:
        bits_b = bits_b[..., : bits_b.shape[-1] // 2] ^ bits_b[..., bits_b.shape[-1] // 2 :]
    both = n_a + n_b
    apart = both - 2 * -(-NUM * both // (DEN + NUM))
    fits = DEN * np.minimum(n_a, n_b) >= NUM * np.maximum(n_a, n_b)
    return fits & (np.bitwise_count(bits_a ^ bits_b).sum(axis=-1) <= apart)


def by_size(column: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sketches of a column by their sizes: (rows, their 64-bit words)."""
    raw = [b.as_buffer() for b in column]
    sizes = np.array([b.size for b in raw], np.int64)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, np.frombuffer(b"".join(raw[i] for i in rows), np.uint64).reshape(len(rows), size // 8)))
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, node) of the documents, and rows (n = -count, node = shingle) of shingles common in a stretch."""
    kept: list[np.ndarray] = []
    held, kind = 0, pa.int64()

    def common() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = counts >= COMMON_IN_TASK
        return pa.RecordBatch.from_arrays(
            [pa.nulls(int(often.sum()), kind), pa.array(-counts[often].astype(np.int64)), pa.array(values[often].view(np.int64)), pa.nulls(int(often.sum()), pa.binary())],
            names=["doc_id", "n", "node", "bits"],
        )

    for batch in batches:
        kind = batch.column(0).type
        for c in bt.chunks(batch.column(1)):
            grams, first = shingle_sets(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(c.lo, c.n), pa.array(np.diff(first)), pa.array(node_ids(grams, first)), pa.array(sketches(grams, first), pa.binary())],
                names=["doc_id", "n", "node", "bits"],
            )
            kept.append(grams)
            held += len(grams)
            if held >= STRETCH:
                yield common()
                kept, held = [], 0
    if kept:
        yield common()


def _heads(common: np.ndarray, rank: np.ndarray):
    """Task function: rows (node, shingle, common) of the first shingles of each set in the global order, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for c in bt.chunks(batch.column(0)):
                grams, first = shingle_sets(c)
                nodes, n = node_ids(grams, first), np.diff(first)
                fresh = np.zeros(c.n, bool)
                for i, node in enumerate(nodes.tolist()):
                    fresh[i] = node not in done
                    done.add(node)
                owner = np.repeat(np.arange(c.n), n)
                grams, owner = grams[fresh[owner]], owner[fresh[owner]]
                n = np.where(fresh, n, 0)
                first = np.concatenate([[0], np.cumsum(n)])
                if len(common):
                    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                    often = np.where(common[at] == grams, rank[at], 0)
                else:
                    often = np.zeros(len(grams), np.int64)
                order = np.lexsort((grams, often, owner))
                place = np.arange(len(grams)) - first[owner]
                keep = order[place < (n - -(-NUM * n // DEN) + 1)[owner]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[owner[keep]]), pa.array(grams[keep].view(np.int64)), pa.array(often[keep] > 0)],
                    names=["node", "shingle", "common"],
                )

    return run


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shingle, node): ties every node to the first node of its shingle."""
    last, hub = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, node = (batch.column(i).to_numpy() for i in (0, 1))
        new = np.ones(len(shingle), bool)
        new[1:] = shingle[1:] != shingle[:-1]
        starts = np.flatnonzero(new)
        hubs = node[starts].copy()
        if last is not None and shingle[0] == last:
            hubs[0] = hub
        hubs = np.repeat(hubs, np.diff(np.append(starts, len(shingle))))
        last, hub = shingle[-1], hubs[-1]
        other = hubs != node
        # A pair ties once per stretch of rows, not once per shingle.
        pairs = np.unique(np.column_stack([hubs[other], node[other]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hub", "node"])


def _scramble(node: np.ndarray, salt: int) -> np.ndarray:
    return bt.mix(node.view(np.uint64) ^ np.uint64(salt))


BLOOM_SALTS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x243F6A8885A308D3)


def _bloom_cells(size: int):
    """Task function: the (word, bit) cells of nodes in a Bloom filter of `size` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            at = np.concatenate([_scramble(node, s) % np.uint64(size) for s in BLOOM_SALTS])
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"]
            )

    return run


def bloom_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of nodes: 16 bits a node, `BLOOM_BITS` at most."""
    size = min(BLOOM_BITS, max(1 << 16, 1 << (16 * nodes.count()).bit_length()))
    cells = nodes.mapInArrow(_bloom_cells(size), "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[cells.column("word").to_numpy()] = cells.column("bits").to_numpy()
    return out.view(np.uint64)


def _sets(bloom: np.ndarray):
    """Task function: (node, grams) of the texts whose node is in the filter, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for c in bt.chunks(batch.column(0)):
                grams, first = shingle_sets(c)
                nodes = node_ids(grams, first)
                wanted = np.diff(first) > 0
                for salt in BLOOM_SALTS:
                    at = _scramble(nodes, salt) % np.uint64(64 * len(bloom))
                    wanted &= (bloom[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                keep = [i for i in np.flatnonzero(wanted).tolist() if int(nodes[i]) not in done]
                done.update(int(nodes[i]) for i in keep)
                raw = [grams[first[i] : first[i + 1]].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(raw, pa.binary())], names=["node", "grams"])

    return run


def _compatible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, node, sketches and sizes of both) whose sketches allow a link."""
    for batch in batches:
        n_a, n_b = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        ok = np.zeros(batch.num_rows, bool)
        hubs, nodes = by_size(batch.column(2)), by_size(batch.column(3))
        for rows_a, a in hubs:
            for rows_b, b in nodes:
                rows, i, j = np.intersect1d(rows_a, rows_b, assume_unique=True, return_indices=True)
                ok[rows] = may_link(a[i], n_a[rows], b[j], n_b[rows])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["hub", "node"]).filter(pa.array(ok))


def _screen(table: pa.Table) -> pa.Table:
    """One block around a hub: the nodes with a partner in the other role and another component that sketches allow."""
    stored, n, comp = (table.column(c).to_numpy() for c in ("stored", "n", "comp"))
    sketched = by_size(table.column("bits"))
    keep = np.zeros(len(n), bool)
    for rows, bits in sketched:
        for i, own in zip(rows, bits, strict=True):
            if not stored[i]:
                continue
            for others, theirs in sketched:
                near = ~stored[others] & (comp[others] != comp[i]) & (DEN * np.minimum(n[others], n[i]) >= NUM * np.maximum(n[others], n[i]))
                probes = others[near]
                good = probes[may_link(own, n[i], theirs[near], n[probes])]
                keep[good] = True
                keep[i] |= len(good) > 0
    return table.select(["hub", "tree", "probe", "node", "comp", "stored"]).filter(pa.array(keep))


def linked(common: int, n_a: int, n_b: int) -> bool:
    return DEN * common >= NUM * (n_a + n_b - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, node, hub_grams, grams): whether the two sets are linked."""
    for batch in batches:
        out = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            fits = DEN * min(len(x), len(y)) >= NUM * max(len(x), len(y))
            out.append(fits and linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["hub", "node", "linked"])


class PrefixTree:
    """Sets in one order, stored in a tree whose segments are runs of shingles without a branch."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = [len(s) for s in sets]
        self.values, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Common shingles first, so that sets share the upper part of the tree.
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((self.values, -counts))] = np.arange(len(counts))
        self.rank = rank
        cuts = np.cumsum([0, *self.sizes])
        ordered = [np.sort(rank[places[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        keys = sorted(range(len(sets)), key=lambda i: ordered[i].astype(">u4").tobytes())
        self.root = self._grow([(i, ordered[i]) for i in keys])

    def _grow(self, entries: list[tuple[int, np.ndarray]]) -> list:
        """[segment, depth after it, smallest and largest set below, sets that end here, children]."""
        top: list = [np.zeros(0, np.int64), 0, 0, 0, [], []]
        work = [(top, 0, len(entries), 0)]
        while work:
            node, lo, hi, depth = work.pop()
            low, high = entries[lo][1], entries[hi - 1][1]
            m = min(len(low), len(high))
            differ = np.flatnonzero(low[depth:m] != high[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            node[0], node[1] = low[depth:end], end
            sizes = [len(e[1]) for e in entries[lo:hi]]
            node[2], node[3] = min(sizes), max(sizes)
            while lo < hi and len(entries[lo][1]) == end:
                node[4].append(entries[lo][0])
                lo += 1
            while lo < hi:
                token = entries[lo][1][end]
                to = lo + 1
                while to < hi and entries[to][1][end] == token:
                    to += 1
                child: list = [None, 0, 0, 0, [], []]
                node[5].append(child)
                work.append((child, lo, to, end))
                lo = to
        return top

    def partners(self, probe: np.ndarray) -> Iterator[int]:
        """The stored sets linked with the given sorted set."""
        n = len(probe)
        at = np.minimum(np.searchsorted(self.values, probe), len(self.values) - 1)
        mine = np.sort(self.rank[at[self.values[at] == probe]])
        member = np.zeros(len(self.values), bool)
        member[mine] = True
        work = [(self.root, 0)]
        while work:
            (segment, depth, small, large, ends, children), common = work.pop()
            if DEN * large < NUM * n or DEN * n < NUM * small:
                continue
            if len(segment):
                common += int(member[segment].sum())
                left = len(mine) - int(np.searchsorted(mine, segment[-1], "right"))
            else:
                left = len(mine)
            # The size that leaves most room: all of the probe's remaining shingles, and no others.
            size = min(max(depth + left, small), large)
            best = common + min(size - depth, left)
            if (DEN + NUM) * best < NUM * (size + n):
                continue
            for i in ends:
                if linked(common, self.sizes[i], n):
                    yield i
            work.extend((c, common) for c in children)


def _search(table: pa.Table) -> pa.Table:
    """One block around a hub: links between its stored and its traversing sets, no more than join their components."""
    role, node, comp = (table.column(c).to_numpy() for c in ("stored", "node", "comp"))
    grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in table.column("grams")]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    stored = [i for i in range(len(grams)) if role[i]]
    out: list[tuple[int, int]] = []
    if stored:
        tree = PrefixTree([grams[i] for i in stored])
        for i in range(len(grams)):
            if role[i]:
                continue
            for j in tree.partners(grams[i]):
                a, b = find(int(comp[i])), find(int(comp[stored[j]]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(node[i]), int(node[stored[j]])))
    return pa.table({"hub": pa.array([a for a, _ in out], pa.int64()), "node": pa.array([b for _, b in out], pa.int64())})


def near_copy_classes(documents: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): n_shingles and component_id, the smallest id reachable by links."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    described = workspace(spark, "described")
    docs.mapInArrow(_describe, f"doc_id {kind}, n bigint, node bigint, bits binary").write.parquet(described)
    rows = spark.read.parquet(described)
    often = most_frequent(rows.filter("n < 0").groupBy("node").agg((-F.sum("n")).alias("count")), COMMON).toArrow()
    values = often.column("node").to_numpy().view(np.uint64)
    order = np.argsort(values)
    shared = values[order], often.column("count").to_numpy()[order]
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
    texts = docs.select("text")

    heads_at = workspace(spark, "heads")
    texts.mapInArrow(_heads(*shared), "node bigint, shingle bigint, common boolean").write.parquet(heads_at)
    heads = spark.read.parquet(heads_at)
    rare = heads.filter(~F.col("common")).select("shingle", "node").repartition("shingle").sortWithinPartitions("shingle", "node")
    # Common shingles, of which there are few, may each hold a large part of all nodes: their hubs come from partial minima.
    many = heads.filter("common").select("shingle", "node")
    hubs = many.groupBy("shingle").agg(F.min("node").alias("hub"))
    ties = rare.mapInArrow(_tie, "hub bigint, node bigint").union(many.join(F.broadcast(hubs), "shingle").filter("hub <> node").select("hub", "node")).distinct()
    ties_at = workspace(spark, "ties")
    ties.write.parquet(ties_at)
    ties = spark.read.parquet(ties_at)

    sketched = nodes.select("node", "n", "bits")
    of_hubs = sketched.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits"))
    compatible_at = workspace(spark, "compatible")
    (
        ties.join(sketched, "node")
        .join(of_hubs, "hub")
        .select("hub", "node", "hub_bits", "bits", "hub_n", "n")
        .mapInArrow(_compatible, "hub bigint, node bigint")
        .write.parquet(compatible_at)
    )
    compatible = spark.read.parquet(compatible_at)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, grams) of the wanted nodes and a few more, read from the texts."""
        at = workspace(spark, "sets")
        found = texts.mapInArrow(_sets(bloom_filter(wanted)), "node bigint, grams binary")
        found.join(wanted, "node", "left_semi").dropDuplicates(["node"]).write.parquet(at)
        return spark.read.parquet(at)

    sets = sets_of(compatible.select("node").union(compatible.select("hub")).distinct())
    both = compatible.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("grams").alias("hub_grams")), "hub")
    verified_at = workspace(spark, "verified")
    both.select("hub", "node", "hub_grams", "grams").mapInArrow(_verify, "hub bigint, node bigint, linked boolean").write.parquet(verified_at)
    verified = spark.read.parquet(verified_at).filter("linked").select("hub", "node")

    first_classes = components(verified, "hub", "node").withColumnRenamed("label", "comp")
    members = ties.select("hub", "node").union(ties.select("hub", F.col("hub").alias("node")).distinct())
    placed = members.join(first_classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_hub = first_classes.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    placed = placed.join(of_hub, "hub", "left").withColumn("apart", F.col("comp") != F.coalesce("hub_comp", "hub"))
    sizes = placed.groupBy("hub").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("apart").cast("int")).alias("loose")).filter("loose > 0 and all > 2")
    placed = placed.join(sizes, "hub").select(
        "hub", "node", "comp", "apart",
        F.ceil(F.col("loose") / TREE_SETS).cast("int").alias("trees"), F.ceil(F.col("all") / PROBE_SETS).cast("int").alias("probes"),
    )

    def block(count: str):
        return F.pmod(F.xxhash64("node", "hub"), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    traversing = placed.select("hub", "node", "comp", F.lit(False).alias("stored"), every("trees").alias("tree"), block("probes").alias("probe"))
    stored = placed.filter("apart").select("hub", "node", "comp", F.lit(True).alias("stored"), every("probes").alias("probe"), block("trees").alias("tree"))
    screened_at = workspace(spark, "screened")
    (
        traversing.unionByName(stored)
        .join(sketched, "node")
        .groupBy("hub", "tree", "probe")
        .applyInArrow(_screen, "hub bigint, tree int, probe int, node bigint, comp bigint, stored boolean")
        .write.parquet(screened_at)
    )
    screened = spark.read.parquet(screened_at)
    found = (
        screened.join(sets_of(screened.select("node").distinct()), "node")
        .groupBy("hub", "tree", "probe")
        .applyInArrow(_search, "hub bigint, node bigint")
    )
    classes = components(verified.union(found), "hub", "node")
    ids = classes.join(nodes.select("node", "first"), "node", "left")
    smallest = ids.groupBy("label").agg(F.min("first").alias("component"))
    of_node = ids.join(smallest, "label").select("node", "component")
    result = rows.filter("n >= 0").select("doc_id", "n", "node").join(nodes.select("node", "first"), "node", "left").join(of_node, "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "first", "doc_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
