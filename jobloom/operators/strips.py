"""Every vector against every other that a bound allows, with few copies of the vectors.

Vectors are packed, put in the cell of their nearest pivot and dealt into tiles of neighbouring cells. A unit of
work is a pair of tiles: its task holds one and streams the other past it, so a row is copied once per
tile rather than once per cell, and what a unit finds leaves block by block. Pairs of cells whose
products all stay below the limit are never compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from jobloom.session import cut_lineage

HELD_BYTES = 64 * 1024 * 1024  # numbers of the tile that a task holds
BLOCK_ROWS, BLOCK_ENTRIES = 2048, 512 * 1024  # rows and entries of the product matrix a task builds at once
UNITS_PER_CORE = 4
MAX_PIVOTS = 2048
SLACK = 1e-6


# ---------------------------------------------------------------- packed vectors


def _pack(column: pa.Array) -> pa.Array:
    """Vectors as bytes, in four bytes a number where that loses nothing."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    narrow = values.astype("float32")
    if (narrow == values).all():
        values = narrow
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype("int32")
    valid = pa.array(column.is_valid().to_numpy(zero_copy_only=False)).buffers()[1] if column.null_count else None
    return pa.Array.from_buffers(pa.binary(), len(column), [valid, pa.py_buffer(offsets), pa.py_buffer(values)])


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    """One row of `dim` numbers per vector; a missing vector is a row of NaN."""
    out = np.full((len(column), dim), np.nan)
    sizes = pc.binary_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    for width, kind in ((4, "float32"), (8, "float64")):
        rows = np.flatnonzero(sizes == width * dim)
        if len(rows):
            some = column if len(rows) == len(column) else column.take(pa.array(rows))
            start = np.frombuffer(some.buffers()[1], dtype="int32")[some.offset]
            numbers = np.frombuffer(some.buffers()[2], dtype="uint8")[start : start + len(rows) * width * dim]
            out[rows] = numbers.view(kind).reshape(len(rows), dim)
    if (missing := np.isin(sizes, (-1, 4 * dim, 8 * dim), invert=True)).any():
        raise ValueError(f"vectors of {dim} numbers expected, {missing.sum()} are longer or shorter")
    return out


@dataclass(frozen=True)
class Packed:
    """A stored table of `id`, packed vectors `v0`, `v1`, ... and further columns."""

    table: DataFrame
    dims: tuple[int, ...]
    rows: int
    extra: tuple[str, ...]


def packed(df: DataFrame, row_id: str, parts: Sequence[str], extra: Sequence[str] = ()) -> Packed:
    names = [f"v{k}" for k in range(len(parts))]
    chosen = df.select(F.col(row_id).alias("id"), *[F.col(p).alias(n) for p, n in zip(parts, names)], *extra)
    sizes = [StructField(f"n{k}", IntegerType()) for k in range(len(parts))]
    fields = [StructField(f.name, BinaryType()) if f.name in names else f for f in chosen.schema.fields]

    def pack(batches):
        for batch in batches:
            columns = [_pack(batch.column(c)) if c in names else batch.column(c) for c in batch.schema.names]
            lengths = [pc.list_value_length(batch.column(n)).cast(pa.int32()) for n in names]
            yield pa.RecordBatch.from_arrays(columns + lengths, names=[*batch.schema.names, *(s.name for s in sizes)])

    table = cut_lineage(chosen.mapInArrow(pack, StructType(fields + sizes)))
    n, *dims = table.agg(F.count(F.lit(1)), *[F.max(s.name) for s in sizes]).first()
    return Packed(table.drop(*(s.name for s in sizes)), tuple(d or 0 for d in dims), n, tuple(extra))


def sample(points: Packed, space: Callable, n: int) -> np.ndarray:
    """The vectors of the first `n` whole rows in hash order; `n` is bounded by its callers."""
    names = [f"v{k}" for k in range(len(points.dims))]
    rows = points.table.dropna(subset=names).orderBy(F.md5(F.col("id").cast("string")), "id").limit(n).select(*names).collect()
    parts = [_unpack(pa.array([bytes(r[k]) for r in rows], pa.binary()), d) for k, d in enumerate(points.dims)]
    return space(parts)


# ---------------------------------------------------------------- one side of a unit


@dataclass
class Side:
    """Rows of one tile or of a batch of it, in the order of their cells."""

    ids: np.ndarray
    cells: np.ndarray
    parts: list[np.ndarray]
    space: np.ndarray
    extra: dict[str, np.ndarray]
    kept: dict = field(default_factory=dict)  # what a kernel works out once

    def __len__(self) -> int:
        return len(self.ids)


def _side(pieces: list[pa.RecordBatch], dims: Sequence[int], space: Callable, extra: Sequence[str]) -> Side:
    whole = pa.Table.from_batches(pieces).combine_chunks()
    column = lambda name: whole.column(name).chunk(0) if whole.num_rows else pa.array([], whole.schema.field(name).type)
    parts = [_unpack(column(f"v{k}"), d) for k, d in enumerate(dims)]
    plain = lambda name: column(name).to_numpy(zero_copy_only=False)
    return Side(plain("id"), plain("cell"), parts, space(parts), {c: plain(c) for c in extra})


def _runs(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of equal cells starts and ends."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1]) if len(cells) else np.zeros(0, dtype=int)
    return starts, np.append(starts[1:], len(cells))


def blocks(left: Side, right: Side, allowed: np.ndarray, first: int | None = None) -> Iterator[tuple[slice, slice]]:
    """Slices of both sides that together hold every allowed pair, each with a product matrix of bounded size.

    With `first`, `right` is the stretch of `left` that starts there, and rows of `left` behind the slice of `right` are left out.
    """
    if "runs" not in left.kept:
        left.kept["runs"] = _runs(left.cells)
    l_starts, l_ends = left.kept["runs"]
    r_starts, r_ends = _runs(right.cells)
    before, spans, start, end = None, [], 0, 0

    def cut():
        for a, b in spans:
            b = b if first is None else min(b, first + end)
            for r in range(a, b, BLOCK_ROWS):
                rows = slice(r, min(b, r + BLOCK_ROWS))
                step = max(1, BLOCK_ENTRIES // (rows.stop - r))
                for s in range(start, end, step):
                    yield rows, slice(s, min(end, s + step))

    for rs, re in zip(r_starts, r_ends):
        meets = allowed[left.cells[l_starts], right.cells[rs]]
        if before is not None and (meets == before).all():
            end = re
            continue
        yield from cut()
        edges = np.diff(np.concatenate([[0], meets.astype("int8"), [0]]))
        spans = list(zip(l_starts[np.flatnonzero(edges == 1)], l_ends[np.flatnonzero(edges == -1) - 1]))
        before, start, end = meets, rs, re
    yield from cut()


# ---------------------------------------------------------------- cells and tiles


@dataclass(frozen=True)
class Cells:
    """Pivots; each row is in the cell of its nearest, rows that lack a part are in the last cell."""

    pivots: np.ndarray

    def of(self, space: np.ndarray) -> np.ndarray:
        if len(self.pivots) <= 1:
            cells = np.zeros(len(space), dtype="int32")
        else:
            cells = np.empty(len(space), dtype="int32")
            half = (self.pivots**2).sum(axis=1) / 2
            step = max(1, BLOCK_ENTRIES // len(self.pivots))
            for s in range(0, len(space), step):
                cells[s : s + step] = (half[None, :] - space[s : s + step] @ self.pivots.T).argmin(axis=1)
        cells[np.isnan(space).any(axis=1)] = len(self.pivots)
        return cells


def choose_cells(points: Packed, space: Callable, cell_rows: int) -> Cells:
    """A bounded number of pivots, taken in hash order."""
    wanted = max(1, min(MAX_PIVOTS, -(-points.rows // cell_rows)))
    if wanted == 1:
        return Cells(np.zeros((1, len(space([np.zeros((1, d)) for d in points.dims])[0]))))
    return Cells(sample(points, space, wanted))


def _cell_sizes(points: Packed, space: Callable, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, radius and largest norm of every cell."""
    dims = points.dims

    def measure(batches):
        for batch in batches:
            x = space([_unpack(batch.column(f"v{k}"), d) for k, d in enumerate(dims)])
            cell = cells.of(x)
            known = cell < len(cells.pivots)
            gap = np.zeros(len(x))
            gap[known] = np.linalg.norm(x[known] - cells.pivots[cell[known]], axis=1)
            norm = np.where(known, np.linalg.norm(x, axis=1), 0.0)
            order = np.argsort(cell, kind="stable")
            starts, ends = _runs(cell[order])
            if len(starts):
                yield pa.RecordBatch.from_pydict(
                    {
                        "cell": pa.array(cell[order][starts], pa.int32()),
                        "n": pa.array(ends - starts, pa.int64()),
                        "gap": np.maximum.reduceat(gap[order], starts),
                        "norm": np.maximum.reduceat(norm[order], starts),
                    }
                )

    found = points.table.mapInArrow(measure, "cell int, n long, gap double, norm double")
    rows = found.groupBy("cell").agg(F.sum("n").alias("n"), F.max("gap").alias("gap"), F.max("norm").alias("norm")).collect()
    n, radius, norm = (np.zeros(len(cells.pivots) + 1, dtype=t) for t in ("int64", "float64", "float64"))
    for r in rows:
        n[r["cell"]], radius[r["cell"]], norm[r["cell"]] = r["n"], r["gap"] + SLACK, r["norm"] + SLACK
    return n, radius, norm


def _largest_products(cells: Cells, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """A bound on the products of the rows of two cells, for vectors of any length; rows that lack a part have none."""
    p, r, m = cells.pivots, radius[:-1], norm[:-1]
    dots, length = p @ p.T, np.linalg.norm(p, axis=1)
    shifted = dots + length[:, None] * r[None, :] + length[None, :] * r[:, None] + r[:, None] * r[None, :]
    apart = np.sqrt(np.maximum(length[:, None] ** 2 + length[None, :] ** 2 - 2 * dots, 0.0)) - r[:, None] - r[None, :]
    by_gap = (m[:, None] ** 2 + m[None, :] ** 2 - np.maximum(apart, 0.0) ** 2) / 2
    out = np.full((len(p) + 1, len(p) + 1), np.inf)
    out[:-1, :-1] = np.minimum(shifted, by_gap)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of rows turned into evenly spread ones."""
    x = x.astype("uint64") + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def all_against_all(
    points: Packed,
    space: Callable,
    least: float,
    kernel: Callable[[Side, Side, np.ndarray, int | None], Iterator[pa.RecordBatch]],
    schema: str,
    cell_rows: int,
    tile_rows: int,
    finish: Callable[[Side], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """`kernel(left, right, allowed, first)` for every two tiles that may hold products of `least` in `space`.

    Every pair of rows meets in one call; with `first`, both are of one tile (`blocks`). `finish(left)` comes last for each unit.
    """
    cells = choose_cells(points, space, cell_rows)
    n, radius, norm = _cell_sizes(points, space, cells)
    allowed = _largest_products(cells, radius, norm) >= least - SLACK
    cores = points.table.sparkSession.sparkContext.defaultParallelism
    held = max(1, HELD_BYTES // (8 * max(1, sum(points.dims))))
    tiles = max(-(-points.rows // held), min(-(-points.rows // tile_rows), int(np.ceil(np.sqrt(2 * UNITS_PER_CORE * cores)))), 1)
    # Cells that lie close share a tile as far as one axis tells; rows of a cell are dealt over its stretch.
    axis = np.linalg.eigh(np.cov(cells.pivots.T))[1][:, -1] if cells.pivots.shape[0] > 1 and cells.pivots.shape[1] > 1 else None
    order = np.append(np.argsort(cells.pivots @ axis) if axis is not None else np.arange(len(cells.pivots)), len(cells.pivots))
    start = np.zeros(len(n), dtype="int64")
    start[order] = np.concatenate([[0], np.cumsum(n[order])[:-1]])
    length = max(1, -(-points.rows // tiles))
    in_tile = np.zeros((tiles, len(n)), dtype=bool)
    for c in np.flatnonzero(n):
        in_tile[start[c] // length : (start[c] + n[c] - 1) // length + 1, c] = True
    meets = (in_tile.astype("float32") @ allowed.astype("float32") @ in_tile.T.astype("float32")) > 0
    units = [(x, y) for x in range(tiles) for y in range(x, tiles) if meets[x, y]] or [(0, 0)]
    routes = [[(u, int(x != t)) for u, (x, y) in enumerate(units) if t in (x, y)] for t in range(tiles)]
    alone = {u for u, (x, y) in enumerate(units) if x == y}
    dealt = _dealt(points, space, cells, lambda cell: start[cell], n, length, routes)
    return _compared(dealt, len(units), points, space, allowed, kernel, schema, alone, finish)


def each_against_all(
    queries: Packed,
    refs: Packed,
    space: Callable,
    cells: Cells,
    kernel: Callable[[Side, Side, np.ndarray, int | None], Iterator[pa.RecordBatch]],
    schema: str,
    finish: Callable[[Side], Iterator[pa.RecordBatch]],
) -> DataFrame:
    """`kernel(left, right, radii, None)` for every tile of `queries` with every batch of `refs`, both of the same columns.

    `radii` holds the radius of every cell of `refs`; `finish(left)` comes last for each unit.
    """
    n, radius, _ = _cell_sizes(refs, space, cells)
    cores = refs.table.sparkSession.sparkContext.defaultParallelism
    held = max(1, HELD_BYTES // (8 * max(1, sum(refs.dims))))
    wanted = int(np.ceil(np.sqrt(UNITS_PER_CORE * cores)))
    tall, wide = max(1, -(-queries.rows // held), min(queries.rows, wanted)), max(1, min(refs.rows, wanted))
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    length = max(1, -(-refs.rows // wide))
    units = [(x, y) for x in range(tall) for y in range(wide)]
    left = [[(x * wide + y, 0) for y in range(wide)] for x in range(tall)]
    right = [[(x * wide + y, 1) for x in range(tall)] for y in range(wide)]
    spread = np.full(len(n), queries.rows)
    dealt = _dealt(queries, space, cells, lambda cell: np.zeros(len(cell), dtype="int64"), spread, max(1, -(-queries.rows // tall)), left)
    met = _dealt(refs, space, cells, lambda cell: start[cell], n, length, right)
    return _compared(dealt.unionByName(met), len(units), refs, space, radius, kernel, schema, set(), finish)


def _dealt(
    points: Packed, space: Callable, cells: Cells, start: Callable, n: np.ndarray, length: int, routes: list[list[tuple[int, int]]]
) -> DataFrame:
    """The rows of `points` with their `cell`, once per `unit` and `side` that their tile is sent to."""
    dims, fields = points.dims, points.table.schema.fields
    names = [f.name for f in fields]
    added = [StructField("unit", IntegerType()), StructField("side", IntegerType()), StructField("cell", IntegerType())]

    def deal(batches):
        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            x = space([_unpack(batch.column(f"v{k}"), d) for k, d in enumerate(dims)])
            cell = cells.of(x)
            # Rows are told apart by where they are stored, so copies of an id don't share a tile.
            number = _mixed(np.arange(seen, seen + len(x)))
            seen += len(x)
            tile = (start(cell) + (number % np.maximum(n[cell], 1).astype("uint64")).astype("int64")) // length
            for t in np.unique(tile):
                rows = np.flatnonzero(tile == t)
                rows = rows[np.argsort(cell[rows], kind="stable")]
                some = [batch.column(c).take(pa.array(rows)) for c in names]
                own = pa.array(cell[rows], pa.int32())
                for unit, side in routes[t]:
                    same = [pa.array(np.full(len(rows), v, dtype="int32")) for v in (unit, side)]
                    yield pa.RecordBatch.from_arrays([*some, *same, own], names=[*names, "unit", "side", "cell"])

    return points.table.mapInArrow(deal, StructType(fields + added))


def _compared(
    dealt: DataFrame, units: int, points: Packed, space: Callable, bounds: np.ndarray, kernel: Callable, schema: str,
    alone: set[int], finish: Callable | None,
) -> DataFrame:
    """Runs `kernel` on the held side of every unit with each batch of the other side; units in `alone` have one side only."""
    dims, extra = points.dims, points.extra

    def compare(batches):
        unit, pieces, left = None, [], None

        def end():
            if unit is None or not pieces:
                return
            whole = _side(pieces, dims, space, extra) if left is None else left
            if unit in alone:
                for s in range(0, len(whole), BLOCK_ROWS):
                    yield from kernel(whole, _part(whole, slice(s, s + BLOCK_ROWS)), bounds, s)
            if finish is not None:
                yield from finish(whole)

        for batch in batches:
            key = 2 * batch.column("unit").to_numpy() + batch.column("side").to_numpy()
            starts, ends = _runs(key)
            for s, e in zip(starts, ends):
                piece = batch.slice(s, e - s)
                if key[s] // 2 != unit:
                    yield from end()
                    unit, pieces, left = key[s] // 2, [], None
                if key[s] % 2 == 0:
                    pieces.append(piece)
                elif pieces:
                    if left is None:
                        left = _side(pieces, dims, space, extra)
                        pieces = pieces[:1]
                    yield from kernel(left, _side([piece], dims, space, extra), bounds, None)
        yield from end()

    return dealt.repartitionById(units, F.col("unit")).sortWithinPartitions("unit", "side", "cell").mapInArrow(compare, schema)


def _part(side: Side, rows: slice) -> Side:
    return Side(
        side.ids[rows], side.cells[rows], [p[rows] for p in side.parts], side.space[rows], {c: v[rows] for c, v in side.extra.items()}
    )
