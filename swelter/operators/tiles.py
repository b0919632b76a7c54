"""Image steps of one day, done tile by tile.

A day's field is cut into square tiles. Every tile also receives the cells of a margin
(``HALO``) around it, wide enough that the smoothing and the labelling of its own cells come
out exactly as they would on the whole field. Cells travel by block, a square of whole tiles at
most ``BLOCK`` cells wide (or one larger tile); its tiles are worked on one below the other as one
image, so small tiles cost no call each. A task therefore never holds more than one block plus
margins, however large the grid or however many cells of a day are hot; pieces of one component
in different tiles are joined afterwards through the cells the tiles share.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.operators.graph import attach_components, connected_components
from swelter.params import DAY_KEYS, GridShape
from swelter.session import cut_lineage, ship_package

OPEN_RADIUS = 1
CLOSE_RADIUS = 2
RING = 1  # cells around a tile whose labels it shares with its neighbours
HALO = 2 * OPEN_RADIUS + 2 * CLOSE_RADIUS + RING
BLOCK = 256  # cells on a side of a block of tiles

_KEY_DDL = "measure string, pct double, d date"
MASK_DDL = f"{_KEY_DDL}, r int, c int"
PIECE_DDL = (
    f"{_KEY_DDL}, node bigint, n_mask bigint, sum_r bigint, sum_c bigint, n_hot bigint, sum_mag double,"
    " hot_r array<int>, hot_c array<int>, hot_mag array<float>,"
    " edge_r array<int>, edge_c array<int>, shared array<bigint>"
)


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets of a filled disk: all (dr, dc) with dr^2 + dc^2 <= radius^2."""
    span = range(-radius, radius + 1)
    return [(i, j) for i in span for j in span if i * i + j * j <= radius * radius]


def _shifted(img: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """``out[r, c] = img[r + dr, c + dc]``; cells shifted in from beyond the array are unset."""
    out = np.zeros_like(img)
    h, w = img.shape
    out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = img[
        max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)
    ]
    return out


def dilate(img: np.ndarray, inside: np.ndarray, radius: int) -> np.ndarray:
    """Set every cell within ``radius`` of a set cell; cells off the grid stay unset."""
    out = np.zeros_like(img)
    for dr, dc in disk(radius):
        out |= _shifted(img, dr, dc)
    return out & inside


def erode(img: np.ndarray, inside: np.ndarray, radius: int) -> np.ndarray:
    """Keep cells whose whole disk is set; cells off the grid count as set."""
    padded = img | ~inside
    out = img.copy()
    for dr, dc in disk(radius):
        out &= _shifted(padded, dr, dc)
    return out


def opened(img: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return dilate(erode(img, inside, OPEN_RADIUS), inside, OPEN_RADIUS)


def closed(img: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return erode(dilate(img, inside, CLOSE_RADIUS), inside, CLOSE_RADIUS)


def label_cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-connected labels of the set cells: ``(rows, cols, label)`` in row-major order.

    Works on horizontal runs; a label is the index of the component's first run.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    run_r, c0 = np.nonzero(edge == 1)
    c1 = np.nonzero(edge == -1)[1] - 1
    width = w + 3
    start, end = run_r * width + c0 + 1, run_r * width + c1 + 1
    first = np.searchsorted(end, start + width - 1, side="left")
    last = np.searchsorted(start, end + width + 1, side="right")
    count = np.maximum(last - first, 0)
    a = np.repeat(np.arange(run_r.size), count)
    b = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    label = np.arange(run_r.size)
    while True:
        low = np.minimum(label[a], label[b])
        if np.array_equal(label[a], low) and np.array_equal(label[b], low):
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    rr, cc = np.nonzero(mask)
    return rr, cc, np.repeat(label, c1 - c0 + 1)


class _Tiles:
    """Dense arrays of the tiles of a block that see a hot cell, each with its margin, one below the other.

    What lies beyond a tile's own array may be wrong; the margin keeps that from the cells a tile sees.
    """

    def __init__(self, key: tuple, table: pa.Table, shape: GridShape, size: int):
        self.day = [k.as_py() for k in key[:3]]
        per = _tiles_per_block(size)
        first = [k.as_py() * per for k in key[3:]]
        many = [min(per, (n - 1) // size + 1 - at) for n, at in zip((shape.ny, shape.nx), first)]
        side = size + 2 * HALO
        r = table.column("r").to_numpy() - (first[0] * size - HALO)
        c = table.column("c").to_numpy() - (first[1] * size - HALO)
        hot = np.zeros([n * size + 2 * HALO for n in many], dtype=bool)
        hot[r, c] = True
        mag = np.zeros(hot.shape, dtype=np.float32)
        mag[r, c] = table.column("mag").to_numpy()
        hot, mag = (np.lib.stride_tricks.sliding_window_view(a, (side, side))[::size, ::size] for a in (hot, mag))
        tr, tc = np.nonzero(hot.any(axis=(2, 3)))
        self.hot, self.mag = (a[tr, tc].reshape(-1, side) for a in (hot, mag))
        self.row = (((first[0] + tr) * size - HALO)[:, None] + np.arange(side)).ravel()
        self.left = np.repeat((first[1] + tc) * size - HALO, side)
        col = self.left[:, None] + np.arange(side)
        self.inside = ((self.row >= 0) & (self.row < shape.ny))[:, None] & (col >= 0) & (col < shape.nx)
        core, seen, inner = (np.zeros((side, side), dtype=bool) for _ in range(3))
        core[HALO : HALO + size, HALO : HALO + size] = True
        seen[HALO - RING : HALO + size + RING, HALO - RING : HALO + size + RING] = True
        inner[HALO + RING : HALO + size - RING, HALO + RING : HALO + size - RING] = True
        self.core, self.seen, self.rim = (np.tile(a, (len(tr), 1)) for a in (core, seen, seen & ~inner))

    def smooth(self) -> np.ndarray:
        return closed(opened(self.hot, self.inside), self.inside)

    def place(self, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grid row and column of cells of the arrays."""
        return self.row[r], self.left[r] + c


def _tiles_per_block(size: int) -> int:
    return max(1, BLOCK // size)


def _spread(hot: DataFrame, shape: GridShape, size: int) -> DataFrame:
    """Send every hot cell to its own block and to the neighbours whose margin it lies in."""
    if size < 2 * HALO:
        raise ValueError(f"a tile must be at least {2 * HALO} cells wide")

    wide = _tiles_per_block(size) * size

    def targets(axis: str, n: int):
        last = (n - 1) // wide
        lo = F.greatest(F.floor((F.col(axis) - HALO) / wide), F.lit(0))
        hi = F.least(F.floor((F.col(axis) + HALO) / wide), F.lit(last))
        return F.explode(F.sequence(lo.cast("int"), hi.cast("int")))

    return (
        hot.where(F.col("mag") > 0)
        .select(*DAY_KEYS, F.col("r").cast("int"), F.col("c").cast("int"), F.col("mag").cast("float"))
        .withColumn("br", targets("r", shape.ny))
        .withColumn("bc", targets("c", shape.nx))
    )


def _per_block(hot: DataFrame, shape: GridShape, size: int, fn: Callable[[_Tiles], pa.Table], ddl: str) -> DataFrame:
    ship_package(hot.sparkSession)

    def run(key, table):
        return fn(_Tiles(key, table, shape, size))

    # the work per block is far larger than its bytes, so partitions must not be merged by size
    tasks = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*DAY_KEYS, "br", "bc"]
    return _spread(hot, shape, size).repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, ddl)


def _day_columns(tile: _Tiles, n: int) -> dict[str, pa.Array]:
    measure, pct, d = tile.day
    return {
        "measure": pa.array([measure] * n, pa.string()),
        "pct": pa.array([pct] * n, pa.float64()),
        "d": pa.array([d] * n, pa.date32()),
    }


def smooth_mask(hot: DataFrame, shape: GridShape, size: int = 256, step: str = "close") -> DataFrame:
    """Cells ``(measure, pct, d, r, c)`` left after opening (``step='open'``) or opening and closing."""

    def cells(tile: _Tiles) -> pa.Table:
        img = opened(tile.hot, tile.inside) if step == "open" else tile.smooth()
        r, c = tile.place(*np.nonzero(img & tile.core))
        return pa.table(
            {
                **_day_columns(tile, r.size),
                "r": pa.array(r.astype(np.int32)),
                "c": pa.array(c.astype(np.int32)),
            }
        )

    return _per_block(hot, shape, size, cells, MASK_DDL)


def _grouped_lists(label: np.ndarray, n: int, *columns: pa.Array) -> list[pa.Array]:
    """Turn flat columns into one list per label 0..n-1."""
    order = np.argsort(label, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(label, minlength=n)))).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(offsets), col.take(pa.array(order))) for col in columns]


def component_pieces(hot: DataFrame, shape: GridShape, size: int = 256) -> DataFrame:
    """One row per tile and smoothed component in it.

    ``node`` is the smallest row-major cell of the piece as the tile sees it, ``shared`` the
    cells on the tile's rim (used to join pieces), ``hot_*`` the exceeding cells in the piece
    and ``edge_*`` the first and last cell of the piece in every row (all a hull needs).
    """

    def pieces(tile: _Tiles) -> pa.Table:
        rr, cc, raw = label_cells(tile.smooth() & tile.seen)
        row, col = tile.place(rr, cc)
        flat = row * shape.nx + col
        _, first, lab = np.unique(raw, return_index=True, return_inverse=True)
        n = first.size
        core = tile.core[rr, cc]
        rim = tile.rim[rr, cc]
        hot_here = core & tile.hot[rr, cc]

        def total(weights):
            return np.bincount(lab[core], weights=weights[core], minlength=n)

        mag = tile.mag[rr, cc]
        row_abs, col_abs = row.astype(np.int32), col.astype(np.int32)
        cr, cl, ccol = row_abs[core], lab[core], col_abs[core]
        order = np.lexsort((ccol, cr, cl))
        cr, cl, ccol = cr[order], cl[order], ccol[order]
        change = (np.diff(cr) != 0) | (np.diff(cl) != 0)
        ends = np.ones(cr.size, dtype=bool)
        if cr.size:
            ends[1:-1] = change[:-1] | change[1:]
        hot_lists = _grouped_lists(
            lab[hot_here], n, pa.array(row_abs[hot_here]), pa.array(col_abs[hot_here]), pa.array(mag[hot_here])
        )
        edge_lists = _grouped_lists(cl[ends], n, pa.array(cr[ends]), pa.array(ccol[ends]))
        (shared,) = _grouped_lists(lab[rim], n, pa.array(flat[rim]))
        ints = lambda x: pa.array(np.asarray(x).round().astype(np.int64))
        return pa.table(
            {
                **_day_columns(tile, n),
                "node": pa.array(flat[first]),
                "n_mask": ints(np.bincount(cl, minlength=n)),
                "sum_r": ints(total(row_abs)),
                "sum_c": ints(total(col_abs)),
                "n_hot": ints(np.bincount(lab[hot_here], minlength=n)),
                "sum_mag": pa.array(
                    np.bincount(lab[hot_here], weights=mag[hot_here], minlength=n).astype(np.float64)
                ),
                "hot_r": hot_lists[0],
                "hot_c": hot_lists[1],
                "hot_mag": hot_lists[2],
                "edge_r": edge_lists[0],
                "edge_c": edge_lists[1],
                "shared": shared,
            }
        )

    return _per_block(hot, shape, size, pieces, PIECE_DDL)


def mask_nodes(hot: DataFrame, shape: GridShape, size: int = 256) -> DataFrame:
    """Cells of the smoothed field with the ``node`` of the piece they belong to."""

    def cells(tile: _Tiles) -> pa.Table:
        rr, cc, raw = label_cells(tile.smooth() & tile.seen)
        row, col = tile.place(rr, cc)
        flat = row * shape.nx + col
        _, first, lab = np.unique(raw, return_index=True, return_inverse=True)
        core = tile.core[rr, cc]
        return pa.table(
            {
                **_day_columns(tile, int(core.sum())),
                "r": pa.array(row[core].astype(np.int32)),
                "c": pa.array(col[core].astype(np.int32)),
                "node": pa.array(flat[first][lab[core]]),
            }
        )

    return _per_block(hot, shape, size, cells, f"{MASK_DDL}, node bigint")


def label_field(hot: DataFrame, shape: GridShape, size: int = 256) -> DataFrame:
    """8-connected components of the smoothed field, cell by cell: ``(*day keys, r, c, comp)``."""
    names = labelled_pieces(hot, shape, size).select(*DAY_KEYS, "node", "comp").distinct()
    return mask_nodes(hot, shape, size).join(names, [*DAY_KEYS, "node"]).drop("node")


def stitch_pieces(pieces: DataFrame) -> DataFrame:
    """Give every piece its component: pieces that contain the same rim cell belong together.

    At most four tiles see a cell, so the groups below hold at most four nodes.
    """
    at_cell = (
        pieces.select(*DAY_KEYS, "node", F.explode("shared").alias("cell"))
        .groupBy(*DAY_KEYS, "cell")
        .agg(F.collect_set("node").alias("nodes"))
        .where(F.size("nodes") > 1)
    )
    edges = at_cell.select(*DAY_KEYS, F.array_min("nodes").alias("a"), F.explode("nodes").alias("b"))
    return attach_components(pieces, connected_components(edges, DAY_KEYS), DAY_KEYS, "node")


def labelled_pieces(hot: DataFrame, shape: GridShape, size: int = 256) -> DataFrame:
    """``component_pieces`` with ``comp``, the smallest row-major cell of the whole component."""
    return stitch_pieces(cut_lineage(component_pieces(hot, shape, size)))


def component_table(pieces: DataFrame) -> DataFrame:
    """Size and centroid (0-based, in cells) of every component."""
    total = pieces.groupBy(*DAY_KEYS, "comp").agg(
        F.sum("n_mask").alias("n_cells"), F.sum("sum_r").alias("_r"), F.sum("sum_c").alias("_c")
    )
    return total.where("n_cells > 0").select(
        *DAY_KEYS, "comp", "n_cells", (F.col("_r") / F.col("n_cells")).alias("cen_r"),
        (F.col("_c") / F.col("n_cells")).alias("cen_c"),
    )
