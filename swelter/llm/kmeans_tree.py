"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is grown on a bounded sample and holds every row: a row descends to its nearest leaf.
A query walks the tree with a priority queue, always into the nearest node not yet opened, and so
orders the leaves. How many of them must be visited is calibrated: for ``CALIBRATED`` queries the
neighbours in the whole table are known exactly, and visits widen until ``RECALL`` of them are
found.

Leaves lie together in cells of a bounded number of values, cut in the order of the tree; a leaf
that is larger fills several cells. Rows and the queries that visit a leaf meet in its cell. The
nearest leaves come first; what they leave is searched with the score reached there, and leaves
that cannot beat it, by the widest angle of their rows, are not visited.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swelter.llm.common import flat, lists, pick, store
from swelter.session import ship_package

NEIGHBOURS = 5
#: Every so many ids one row is a query.
QUERY_STEP = 50
#: Rows the tree is grown on, most children of a node, most rows of the sample in a leaf, rounds of k-means.
SAMPLE = 32_768
BRANCH = 16
LEAF_SAMPLE = 128
ROUNDS = 8
#: Queries of which all neighbours are looked up, and the share that the visits must find.
CALIBRATED = 256
RECALL = 0.98
#: Share of the visits made before a score is known.
FIRST = 8
#: Values of the vectors in a cell.
CELL_VALUES = 1 << 20
#: Scores closer than this are computed anew, one way for all pairs.
SLACK = 1e-9
SEED = 42


@dataclass
class Tree:
    """Nodes by number; the children of node i are ``first[i]`` to ``first[i] + many[i]``, leaves have none."""

    centre: np.ndarray
    first: np.ndarray
    many: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.many == 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so squares neither overflow nor vanish."""
    v = _scaled(vectors)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, times a power of two that brings the largest value near one: exact."""
    v = vectors.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _split(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Child of every point by spherical k-means; empty children are left out."""
    children = min(BRANCH, -(-len(points) // LEAF_SAMPLE))
    centres = points[rng.choice(len(points), children, replace=False)]
    for _ in range(ROUNDS):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    own = (points @ centres.T).argmax(axis=1)
    return np.unique(own, return_inverse=True)[1]


def _centre(points: np.ndarray) -> np.ndarray:
    total = points.sum(axis=0)
    length = np.sqrt(total @ total)
    return total / length if length > 0 else points[0]


def grow(vectors: np.ndarray) -> Tree:
    """A tree over the different directions among ``vectors`` (at least one)."""
    points = np.unique(unit(vectors), axis=0)
    rng = np.random.default_rng(SEED)
    centre, first, many, waiting = [_centre(points)], [0], [0], [(0, points)]
    while waiting:
        node, own = waiting.pop(0)
        if len(own) <= LEAF_SAMPLE:
            continue
        child = _split(own, rng)
        if child.max() == 0:
            continue
        first[node], many[node] = len(centre), int(child.max()) + 1
        for k in range(many[node]):
            waiting.append((len(centre), own[child == k]))
            centre.append(_centre(own[child == k]))
            first.append(0)
            many.append(0)
    return Tree(np.array(centre), np.array(first), np.array(many))


def descend(tree: Tree, points: np.ndarray) -> np.ndarray:
    """Leaf of every point (of length one): always on to the nearest child."""
    at = np.zeros(len(points), np.int64)
    moving = np.arange(len(points))
    while len(moving := moving[tree.many[at[moving]] > 0]):
        order = moving[np.argsort(at[moving], kind="stable")]
        for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            node = at[own[0]]
            children = slice(tree.first[node], tree.first[node] + tree.many[node])
            at[own] = tree.first[node] + (points[own] @ tree.centre[children].T).argmax(axis=1)
    return at


def best_bin_first(tree: Tree, nearness: np.ndarray, visits: int) -> list[int]:
    """The first ``visits`` leaves from a priority queue of nodes; ``nearness`` of the query to every node."""
    queue, found = [(-nearness[0], 0)], []
    while queue and len(found) < visits:
        _, node = heapq.heappop(queue)
        if tree.many[node] == 0:
            found.append(node)
        for child in range(tree.first[node], tree.first[node] + tree.many[node]):
            heapq.heappush(queue, (-nearness[child], child))
    return found


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows of ``a`` and ``b``, summed in the same order for any pair."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


# rows


def usable(df: DataFrame, id_name: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id (long) and v (float or double array) of the rows that take part, and their number.

    Rows without id, and NULL or zero vectors or such with a NULL or non-finite component do not;
    of several lengths the most frequent counts (of equally frequent ones the smallest).
    """
    own = pick(df, id_name, vector)
    kind = own.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    own = own.select(F.col(id_name).cast("long").alias("vec_id"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = own.where(F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (good.where(F.size("v") == length["n"]), length["count"]) if length else (good, 0)


def _sample(df: DataFrame, total: int, rows: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``rows`` of the ``total`` rows, by a hash, as ids and vectors; never more than twice as many."""
    share = F.lit(min(1.0, rows / max(1, total)) * 2.0**63)
    draw = F.abs(F.xxhash64("vec_id", F.lit(salt)).cast("double"))
    found = df.where(draw <= share).limit(2 * rows).toArrow()
    if not found.num_rows:
        return np.empty(0, np.int64), np.empty((0, 0))
    return found.column("vec_id").to_numpy(), _matrix(found.column("v").combine_chunks())


def _matrix(column: pa.Array) -> np.ndarray:
    values, sizes = flat(column)
    return values.reshape(len(sizes), -1)


def in_leaves(rows: DataFrame, tree: Tree) -> DataFrame:
    """vec_id, v, leaf and the angle between row and centre of the leaf."""
    ship_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(tree)
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = unit(_matrix(batch.column("v")))
            leaf = descend(sent.value, points)
            near = np.einsum("ij,ij->i", points, sent.value.centre[leaf])
            angle = np.arccos(np.clip(near, -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf), pa.array(angle)], names=["vec_id", "v", "leaf", "angle"])

    return rows.select("vec_id", "v").mapInArrow(run, f"vec_id long, v {kind}, leaf long, angle double")


class Best:
    """The nearest candidates of a number of queries, kept as they come."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray) -> None:
        self.ids, self.vectors, self.units = ids, vectors, unit(vectors)
        #: Scores below this cannot be among the nearest.
        self.floor = floor.copy()
        self.found: list[list[tuple[float, int, int]]] = [[] for _ in ids]

    def add(self, who: np.ndarray, group: "Group") -> None:
        """Offer the vectors of a group to the queries ``who``."""
        near = self.units[who] @ group.units.T
        if near.shape[1] > NEIGHBOURS + 1:
            # as many vectors of the group at least are this near; one of them may be the query
            kth = np.partition(near, -NEIGHBOURS - 1, axis=1)[:, -NEIGHBOURS - 1]
            self.floor[who] = np.maximum(self.floor[who], kth)
        q, x = np.nonzero(near >= self.floor[who][:, None] - SLACK)
        scores = exact_scores(self.vectors[who[q]], group.vectors[x]) if len(q) else ()
        for i, k, score in zip(who[q].tolist(), x.tolist(), scores):
            own = self.ids[i] if (group.vectors[k] == self.vectors[i]).all() else None
            self.found[i] += [(-score, v, group.leaves[k]) for v in group.ids[k] if v != own]
        for i in np.unique(who[q]).tolist():
            self.found[i] = sorted(self.found[i])[:NEIGHBOURS]
            if len(self.found[i]) == NEIGHBOURS:
                self.floor[i] = max(self.floor[i], -self.found[i][-1][0])


class Group:
    """The different vectors of some rows, each with as many of its smallest ids as a query can want."""

    def __init__(self, leaves: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        keyed = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
        order = np.lexsort((ids, np.unique(keyed, return_inverse=True)[1]))
        at = np.flatnonzero(np.append(True, keyed[order][1:] != keyed[order][:-1]))
        self.vectors, self.leaves = vectors[order][at], leaves[order][at].tolist()
        self.units = unit(self.vectors)
        self.ids = [x.tolist() if len(x) == 1 else np.unique(x)[: NEIGHBOURS + 1].tolist() for x in np.split(ids[order], at[1:])]


def _rows_out(ids: list, keys: list, best: list[list[tuple[float, int, int]]]) -> pa.RecordBatch:
    flat_rows = [(i, k, v, -s, leaf) for i, k, f in zip(ids, keys, best) for s, v, leaf in f]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    columns = list(zip(*flat_rows)) if flat_rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query_id", "key", "vec_id", "score", "leaf"])


FOUND = "query_id long, key long, vec_id long, score double, leaf long"


def nearest(found: DataFrame) -> DataFrame:
    """The best of what several tasks found for every query, with its rank."""
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEIGHBOURS)


def calibrate(placed: DataFrame, tree: Tree, queries: tuple[np.ndarray, np.ndarray]) -> int:
    """Leaves to visit so that ``RECALL`` of the true neighbours of the calibration queries are met."""
    ids, vectors = queries
    if not len(ids):
        return 1
    sent = placed.sparkSession.sparkContext.broadcast((ids, vectors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*sent.value, np.full(len(sent.value[0]), -2.0))
        who = np.arange(len(sent.value[0]))
        for batch in batches:
            if batch.num_rows:
                best.add(who, Group(batch.column("leaf").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))))
        yield _rows_out(best.ids.tolist(), who.tolist(), best.found)

    # a row may be met by several tasks
    found = placed.select("vec_id", "v", "leaf").mapInArrow(scan, FOUND).distinct()
    truth = nearest(found).select("key", "leaf").toArrow()
    key, leaf = truth.column("key").to_numpy(), truth.column("leaf").to_numpy()
    nearness = unit(vectors) @ tree.centre.T
    place = np.full((len(ids), len(tree.many)), 0)
    for i in range(len(ids)):
        order = best_bin_first(tree, nearness[i], len(tree.many))
        place[i, order] = np.arange(len(order))
    needed = np.sort(place[key, leaf]) + 1
    return int(needed[max(0, int(np.ceil(RECALL * len(needed))) - 1)]) if len(needed) else 1


@dataclass
class Cells:
    """For every node that is a leaf: its first cell, how many it fills, and its widest angle."""

    first: np.ndarray
    many: np.ndarray
    angle: np.ndarray


def cut_cells(tree: Tree, sizes: dict[int, tuple[int, float]], width: int) -> Cells:
    """Leaves in the order of the tree share cells of ``CELL_VALUES``; larger ones get cells of their own."""
    rows = max(1, CELL_VALUES // max(1, width))
    first, many, angle = np.zeros(len(tree.many), np.int64), np.ones(len(tree.many), np.int64), np.zeros(len(tree.many))
    cell, filled, stack = 0, 0, [0]
    while stack:
        node = stack.pop()
        stack += range(tree.first[node] + tree.many[node] - 1, tree.first[node] - 1, -1)
        n, angle[node] = sizes.get(node, (0, 0.0))
        if not n:
            many[node] = 0
            continue
        if filled and filled + n > rows:
            cell, filled = cell + 1, 0
        first[node], many[node] = cell, -(-n // rows)
        filled += n
        if many[node] > 1:
            cell, filled = cell + many[node], 0
    return Cells(first, many, angle)


def _asked(queries: DataFrame, tree: Tree, cells: Cells, visits: int, first_only: bool) -> DataFrame:
    """One row per query and cell: the leaves to visit there. The later ones only where they can beat ``floor``."""
    sent = queries.sparkSession.sparkContext.broadcast((tree, cells))
    early = -(-visits // FIRST)
    kind = queries.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, cells = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            nearness = unit(_matrix(batch.column("v"))) @ tree.centre.T
            angle = np.arccos(np.clip(nearness, -1, 1))
            floors = batch.column("floor").to_numpy()
            rows, cell_of, leaves, sizes = [], [], [], []
            for i in range(batch.num_rows):
                order = np.array(best_bin_first(tree, nearness[i], early if first_only else visits))
                order = order[cells.many[order] > 0] if first_only else order[early:][cells.many[order[early:]] > 0]
                # no row of a leaf is nearer than its centre by more than its widest angle
                least = np.maximum(0, angle[i, order] - cells.angle[order])
                order = order[np.cos(least) >= floors[i] - SLACK]
                where: dict[int, list[int]] = {}
                for leaf in order.tolist():
                    for k in range(cells.many[leaf]):
                        where.setdefault(int(cells.first[leaf]) + k, []).append(leaf)
                for cell, own in where.items():
                    rows.append(i)
                    cell_of.append(cell)
                    leaves += own
                    sizes.append(len(own))
            take = pa.array(rows, pa.int64())
            kept = [batch.column(c).take(take) for c in ("vec_id", "key", "v", "floor")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(cell_of, pa.int64()), lists(np.array(leaves, np.int64), np.array(sizes, np.int64))],
                names=["vec_id", "key", "v", "floor", "cell", "leaves"],
            )

    return queries.select("vec_id", "key", "v", "floor").mapInArrow(run, f"vec_id long, key long, v {kind}, floor double, cell long, leaves array<bigint>")


def _by_leaf(leaves: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> dict[int, Group]:
    order = np.argsort(leaves, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1)
    return {int(leaves[x[0]]): Group(leaves[x], ids[x], vectors[x]) for x in parts}


def _visit(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """What the asked leaves hold for each query: rows and queries of a cell meet in one task, rows first."""
    nothing = F.lit(None)
    rows = placed.select("cell", F.lit(0).alias("side"), "vec_id", nothing.cast("long").alias("key"), "v", nothing.cast("double").alias("floor"), F.array("leaf").alias("leaves"))
    both = rows.unionByName(asked.withColumn("side", F.lit(1)).select(*rows.columns))
    dealt = both.repartition("cell").sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, groups = None, [], None
        for batch in batches:
            cells, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if cells[lo] != cell:
                    cell, held, groups = cells[lo], [], None
                own, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("v"))
                leaves, sizes = flat(part.column("leaves"))
                if side[lo] == 0:
                    held.append((leaves, own, vectors))
                    continue
                if groups is None:
                    groups = _by_leaf(*(np.concatenate(x) for x in zip(*held))) if held else {}
                best = Best(own, vectors, part.column("floor").to_numpy())
                asking = np.repeat(np.arange(hi - lo), sizes)
                order = np.argsort(leaves, kind="stable")
                for who in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
                    if len(who) and int(leaves[who[0]]) in groups:
                        best.add(asking[who], groups[int(leaves[who[0]])])
                yield _rows_out(own.tolist(), part.column("key").to_pylist(), best.found)

    return dealt.mapInArrow(run, FOUND)


def build_index(rows: DataFrame, total: int) -> tuple[DataFrame, Tree, Cells, int] | None:
    """Every usable row with its leaf and cell, the tree, and the number of visits that reach ``RECALL``; None without rows."""
    _, grown_on = _sample(rows, total, SAMPLE, 0)
    if not len(grown_on):
        return None
    tree = grow(grown_on)
    placed = store(in_leaves(rows, tree))
    sizes = {r["leaf"]: (r["n"], r["angle"]) for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect()}
    cells = cut_cells(tree, sizes, grown_on.shape[1])
    visits = calibrate(placed, tree, _sample(rows, total, CALIBRATED, 1))
    leaves = [int(k) for k in sizes]
    at = placed.sparkSession.createDataFrame([(k, int(cells.first[k]), int(cells.many[k])) for k in leaves], "leaf long, first long, many long")
    in_cells = placed.join(F.broadcast(at), "leaf")  # one row per leaf: at most SAMPLE
    cell = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))
    return in_cells.select("vec_id", "v", "leaf", cell.alias("cell")), tree, cells, visits


def is_query(vec_id: Column) -> Column:
    return vec_id % QUERY_STEP == 0


def nearest_neighbours(df: DataFrame) -> DataFrame:
    """query_id, rank, vec_id and score of the ``NEIGHBOURS`` nearest rows found for every query.

    Queries are the rows whose id is divisible by ``QUERY_STEP``; candidates are all rows but the
    query's own. Nearness is the cosine in double precision, ties go to the smaller id. Rows of one
    id with different vectors are different rows, equal rows are one. Unusable rows (see
    ``usable``) take no part; no usable row gives an empty result; other columns are ignored.
    """
    rows, total = usable(df)
    index = build_index(rows, total)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed, tree, cells, visits = index
    asking = rows.where(is_query(F.col("vec_id"))).distinct()
    asking = asking.select("vec_id", F.xxhash64("v").alias("key"), "v")
    early = store(nearest(_visit(placed, _asked(asking.withColumn("floor", F.lit(-2.0)), tree, cells, visits, True))))
    reached = early.where(F.col("rank") == NEIGHBOURS).select(F.col("query_id").alias("vec_id"), "key", F.col("score").alias("floor"))
    later = asking.join(reached, ["vec_id", "key"], "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    found = early.drop("rank").unionByName(_visit(placed, _asked(later, tree, cells, visits, False)))
    return nearest(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
