import datetime as dt
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.operators import grid, hulls, linkage, segments, tiles
from swelter.operators.graph import connected_components
from swelter.params import DAY_KEYS, DetectParams, GridShape

NY, NX = 37, 45
DDL = "measure string, pct double, d date, r int, c int, mag float"
DAYS = [dt.date(2021, 6, 1) + dt.timedelta(days=i) for i in range(4)]


def brute_shift(img, dr, dc, fill):
    out = np.full_like(img, fill)
    for r in range(img.shape[0]):
        for c in range(img.shape[1]):
            if 0 <= r + dr < img.shape[0] and 0 <= c + dc < img.shape[1]:
                out[r, c] = img[r + dr, c + dc]
    return out


def brute_open_close(img):
    plus = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if abs(i) + abs(j) < 2]
    disk = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]
    ero = lambda x, k: np.all([brute_shift(x, *o, True) for o in k], axis=0)
    dil = lambda x, k: np.any([brute_shift(x, *o, False) for o in k], axis=0)
    opened = dil(ero(img, plus), plus)
    return opened, ero(dil(opened, disk), disk)


def brute_labels(img):
    lab = {}
    for start in zip(*np.nonzero(img)):
        if start in lab:
            continue
        name, stack = int(start[0] * NX + start[1]), [start]
        lab[start] = name
        while stack:
            r, c = stack.pop()
            for p in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= p[0] < NY and 0 <= p[1] < NX and img[p] and p not in lab:
                    lab[p] = name
                    stack.append(p)
    return {(int(r), int(c)): v for (r, c), v in lab.items()}


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(11)
    imgs, rows = {}, []
    for d, share in zip(DAYS, (0.75, 0.9, 0.6, 1.0)):
        img = rng.random((NY, NX)) < share
        img[:, 20:22] &= d != DAYS[0]
        imgs[d] = img
        rows += [("t", 90.0, d, int(r), int(c), float(1 + (r * 7 + c) % 5)) for r, c in zip(*np.nonzero(img))]
    return spark.createDataFrame(rows, DDL), imgs


@pytest.mark.parametrize("size", [14, 16, 64])
def test_tiles_do_not_change_the_result(field, size):
    df, imgs = field
    shape = GridShape(NY, NX)
    for step, at in (("open", 0), ("close", 1)):
        got = {}
        for r in tiles.smooth_mask(df, shape, size, step).collect():
            got.setdefault(r.d, set()).add((r.r, r.c))
        for d, img in imgs.items():
            want = {(int(r), int(c)) for r, c in zip(*np.nonzero(brute_open_close(img)[at]))}
            assert got.get(d, set()) == want
    labels = {}
    for r in tiles.label_field(df, shape, size).collect():
        labels.setdefault(r.d, {})[r.r, r.c] = r.comp
    for d, img in imgs.items():
        assert labels.get(d, {}) == brute_labels(brute_open_close(img)[1])


def test_too_small_tiles_are_refused(field):
    with pytest.raises(ValueError):
        tiles.smooth_mask(field[0], GridShape(NY, NX), 8)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [("a", i, i + 1) for i in range(60)] + [("b", 100, i) for i in range(40)] + [("b", 500, 501), ("b", 7, 7)]
    got = connected_components(spark.createDataFrame(edges, "k string, a long, b long"), ["k"]).collect()
    comp = {(r.k, r.node): r.comp for r in got}
    assert {v for (k, _), v in comp.items() if k == "a"} == {0}
    assert {n for (k, n), v in comp.items() if k == "b" and v == 0} == set(range(40)) | {100}
    assert comp["b", 501] == comp["b", 500] == 500
    assert len(comp) == 61 + 41 + 2


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "k string, a long, b long"), ["k"]).isEmpty()


def km(p, q):
    a, b, c, d = map(math.radians, (p[0], p[1], q[0], q[1]))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h)))


@pytest.mark.parametrize("cutoff", [0.0, 3.0, 12.0, 40.0, 30000.0])
def test_single_linkage_and_pair_statistics(spark, cutoff):
    rng = np.random.default_rng(int(cutoff))
    points = {}
    for d, n in zip(DAYS, (1, 2, 40, 150)):
        spots = rng.choice(100 * 100, n, replace=False)
        points[d] = {i: (int(s // 100), int(s % 100)) for i, s in enumerate(spots)}
    where = lambda s: (30 + s[0] * 0.02, -90 + s[1] * 0.02)
    rows = [("t", 90.0, d, i, *s, *where(s)) for d, ps in points.items() for i, s in ps.items()]
    df = spark.createDataFrame(rows, "measure string, pct double, d date, comp long, pr int, pc int, lat double, lon double")
    got = {(r.d, r.comp): r.cluster for r in linkage.single_linkage(df, cutoff).collect()}
    for d, ps in points.items():
        root = {i: i for i in ps}
        changed = True
        close = [(i, j) for i, j in combinations(ps, 2) if km(where(ps[i]), where(ps[j])) <= cutoff]
        while changed:
            changed = False
            for i, j in close:
                low = min(root[i], root[j])
                if root[i] != low or root[j] != low:
                    root[i] = root[j] = low
                    changed = True
        assert {i: got[d, i] for i in ps} == root
    if cutoff == 12.0:
        stats = {r.d: r for r in linkage.pairwise_km(df, DAY_KEYS, "comp").collect()}
        assert stats[DAYS[0]].mean_pair_km is None
        for d in DAYS[1:]:
            all_km = [km(where(p), where(q)) for p, q in combinations(points[d].values(), 2)]
            assert stats[d].min_pair_km == pytest.approx(min(all_km))
            assert stats[d].mean_pair_km == pytest.approx(np.mean(all_km))


def test_hull_of_single_cell_line_and_triangle():
    rows, left, right = hulls.hull_rows([3], [5], [5])
    assert (rows.tolist(), left.tolist(), right.tolist()) == ([3], [5], [5])
    rows, left, right = hulls.hull_rows([0, 4], [0, 4], [0, 4])
    assert left.tolist() == right.tolist() == [0, 1, 2, 3, 4]
    rows, left, right = hulls.hull_rows([0, 4], [4, 0], [4, 8])
    assert left.tolist() == [4, 3, 2, 1, 0] and right.tolist() == [4, 5, 6, 7, 8]


def test_union_and_restriction_of_runs(spark):
    runs = spark.createDataFrame(
        [("d", 0, 1, 4), ("d", 0, 3, 6), ("d", 0, 7, 7), ("d", 0, 300, 800), ("d", 1, 2, 2), ("d", 0, 2, 3)],
        "k string, r int, c0 int, c1 int",
    )
    merged = hulls.union_runs(runs, ["k"])
    assert sorted((x.r, x.c0, x.c1) for x in merged.collect()) == [(0, 1, 7), (0, 300, 800), (1, 2, 2)]
    cells = spark.createDataFrame([("d", 0, c) for c in (0, 1, 7, 8, 299, 511, 512, 800)], "k string, r int, c int")
    assert sorted(x.c for x in hulls.restrict_to_runs(cells, merged, ["k"]).collect()) == [1, 7, 511, 512, 800]


@pytest.fixture(scope="module")
def axes(spark):
    line = lambda n, a, s: spark.range(n).select(F.col("id").cast("int").alias("idx"), (F.col("id") * s + a).alias("coord"))
    return line(NY, 40.0, -0.01), line(NX, -90.0, 0.01)


def test_detector_of_a_day_against_brute_force(field, axes):
    df, imgs = field
    params = DetectParams(
        region_area_km2=500.0, pixel_size_km=1.0, min_area_km2=10, hull_gate_km2=50, min_hot_cells=90, cluster_cutoff_km=4.0, tile=14
    )
    out = segments.segment_days(df, *axes, GridShape(NY, NX), params)
    got = {r.d: r for r in out.days.collect()}
    hull = {}
    for r in out.runs.collect():
        hull.setdefault(r.d, set()).update((r.r, c) for c in range(r.c0, r.c1 + 1))
    for d, img in imgs.items():
        mag = np.fromfunction(lambda r, c: 1 + (r * 7 + c) % 5, (NY, NX))
        labels = brute_labels(brute_open_close(img)[1])
        sizes = {v: list(labels.values()).count(v) for v in set(labels.values())}
        keep = np.zeros_like(img)
        for (r, c), v in labels.items():
            keep[r, c] = sizes[v] > params.min_pixels
        pruned = img & keep
        mask = brute_open_close(pruned)[1] if pruned.sum() > params.min_pixels else np.zeros_like(img)
        if not mask.any():
            assert d not in got
            continue
        area = float(len(hull[d]))
        prop = mask.sum() / area
        assert got[d].area_km2 == area and got[d].prop_hw == pytest.approx(prop)
        assert got[d].hsci == pytest.approx(mag[mask & pruned].mean() * prop * area / 500)
        assert {(int(r), int(c)) for r, c in zip(*np.nonzero(mask))} <= hull[d]
    assert len(got) >= 2


def test_axis_lookup(spark):
    axis = spark.createDataFrame([(0, 10.0), (1, 11.0), (2, 13.0), (3, 13.5)], "idx int, coord double")
    pts = spark.createDataFrame([(i, x) for i, x in enumerate((9.0, 10.5, 10.6, 12.0, 12.1, 99.0, None))], "k int, x double")
    near = {r.k: r.i for r in grid.nearest_index(pts, axis, "x", "i").collect()}
    assert [near[k] for k in range(7)] == [0, 0, 1, 1, 2, 3, None]
    pos = spark.createDataFrame([(0.2,), (1.0,), (2.5,), (3.75,), (4.0,), (9.0,)], "p double")
    got = [r.v for r in grid.interp_axis(pos, axis, "p", "v").orderBy("p").collect()]
    assert got == [10.0, 10.0, 12.0, 13.375, 13.5, 13.5]
    assert grid.same_axis(axis, axis) and not grid.same_axis(axis, axis.where("idx < 3"))


def test_small_tiles_travel_in_blocks(spark):
    """Cells of a field of two blocks are sent to few places, and its tiles give the components of one large tile."""
    rng = np.random.default_rng(5)
    shape = GridShape(tiles.BLOCK + 50, 40)
    rows = [("t", 90.0, d, int(r), int(c), 1.0) for d in DAYS[:2] for r, c in zip(*np.nonzero(rng.random((shape.ny, shape.nx)) < 0.66))]
    hot = spark.createDataFrame(rows, DDL)
    assert len(rows) < tiles._spread(hot, shape, 16).count() < 1.1 * len(rows)
    fields = [{tuple(x) for x in tiles.label_field(hot, shape, size).collect()} for size in (16, 1024)]
    assert fields[0] == fields[1] and len({x[5] for x in fields[0]}) > 5
    counts = [{(x.d, x.comp, x.n_cells) for x in tiles.component_table(tiles.labelled_pieces(hot, shape, size)).collect()} for size in (16, 1024)]
    assert counts[0] == counts[1]
