import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.operators import events as ev


def events_by_hand(flags, years, min_duration, grace):
    """The list of hot days cut between neighbours of different years or further apart than the
    reach; groups of the least size are numbered in order."""
    hot = [k for k, flag in enumerate(flags) if flag]
    reach = 2 if grace else 1
    cuts = [n for n in range(1, len(hot)) if hot[n] - hot[n - 1] > reach or years[hot[n]] != years[hot[n - 1]]]
    groups = [hot[x:y] for x, y in zip([0, *cuts], [*cuts, len(hot)])]
    long_enough = [g for g in groups if len(g) >= min_duration]
    return {k: number for number, g in enumerate(long_enough, 1) for k in g}


@pytest.mark.parametrize(("min_duration", "grace"), [(3, 1), (3, 0), (2, 2), (1, 3), (4, 1)])
def test_persistence(spark, min_duration, grace):
    rng = np.random.default_rng(min_duration * 10 + grace)
    rows, want = [], {}
    for s in range(30):
        days = sorted({dt.date(2019 + int(y), 5, 1) + dt.timedelta(days=int(k)) for y, k in zip(rng.integers(0, 3, 60), rng.integers(0, 150, 60))})
        flags = (rng.random(len(days)) < rng.choice([0.3, 0.6, 0.9])).tolist()
        rows += [(f"s{s}", 90.0, d, f) for d, f in zip(days, flags)]
        found = events_by_hand(flags, [d.year for d in days], min_duration, grace)
        want.update({(f"s{s}", days[k]): n for k, n in found.items()})
    df = spark.createDataFrame(rows, "measure string, pct double, d date, is_hw boolean")
    got = {(r.measure, r.d): r.event for r in ev.persistent_days(df, min_duration, grace).collect()}
    assert got == want


def test_runs_of_consecutive_indices(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 8, 11, 12)], "k string, i int")
    got = ev.index_runs(df, ["k"], "i").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(1, 3), (8, 8), (11, 12)]


def test_run_overlap_equals_set_intersection(spark):
    rng = np.random.default_rng(20260713)
    pairs = {"no": ([*range(1, 11), *range(20, 31)], [*range(11, 20), *range(31, 41)]), "yes": ([*range(1, 11), *range(20, 31)], range(10, 20))}
    for i in range(60):
        n = 500 if i % 2 else 20
        pairs[f"p{i}"] = (rng.choice(5000, n, replace=False).tolist(), rng.choice(5000, n, replace=False).tolist())
    cells = [(k, side, int(v)) for k, ab in pairs.items() for side, vs in zip("ab", ab) for v in vs]
    df = spark.createDataFrame(cells, "k string, side string, i int")
    runs = ev.index_runs(df, ["k", "side"], "i").withColumnsRenamed({"start": "c0", "end": "c1"})
    a, b = (runs.where(F.col("side") == s).drop("side") for s in "ab")
    got = {r.k for r in ev.overlapping_runs(a, b, ["k"]).select("k").distinct().collect()}
    assert got == {k for k, (x, y) in pairs.items() if set(x) & set(y)}


def ids_by_hand(n_days, n_clusters, edges):
    ids, into, fresh = {}, {}, 0

    def root(x):
        while x in into:
            x = into[x]
        return x

    for k in range(n_days):
        today = {}
        for c in range(1, n_clusters[k] + 1):
            met = {root(ids[j, a]) for j, a, kk, b in edges if (kk, b) == (k, c)}
            if not met:
                fresh += 1
                met = {fresh}
            today[c] = min(met)
            into.update({m: min(met) for m in met if m != min(met)})
        ids.update({(k, c): root(v) for c, v in today.items()})
    return ids, root


def test_event_ids_merges_and_splits(spark):
    rng = np.random.default_rng(8)
    clusters, overlaps, want, merges, splits = [], [], {}, {}, {}
    for s in range(15):
        days = int(rng.integers(1, 22))
        n = rng.integers(1, 5, days)
        p = rng.choice([0.04, 0.12, 0.3])
        edges = [
            (j, a, k, b) for k in range(days) for j in range(max(0, k - 3), k)
            for a in range(1, n[j] + 1) for b in range(1, n[k] + 1) if rng.random() < p
        ]
        ids, root = ids_by_hand(days, n, edges)
        clusters += [(f"s{s}", 90.0, k, c) for k, c in ids]
        overlaps += [(f"s{s}", 90.0, *e) for e in edges]
        want.update({(f"s{s}", *key): (v, root(v)) for key, v in ids.items()})
        for k in range(1, days):
            near = [(a, b) for j, a, kk, b in edges if kk == k and j == k - 1]
            for i, table in ((1, merges), (0, splits)):
                many = sum(1 for x in {e[i] for e in near} if sum(e[i] == x for e in near) >= 2)
                if many:
                    table[f"s{s}", k] = many
    c = spark.createDataFrame(clusters, "measure string, pct double, pos int, cluster_idx int")
    o = spark.createDataFrame(overlaps, "measure string, pct double, prev_pos int, prev_idx int, pos int, cluster_idx int")
    linked = ev.link_events(c, o)
    got = {(r.measure, r.pos, r.cluster_idx): (r.event_id, r.event_id_resolved) for r in linked.collect()}
    assert got == want
    counts = ev.merge_split_counts(o).collect()
    assert {(r.measure, r.pos): r.n_merges for r in counts if r.n_merges} == merges
    assert {(r.measure, r.pos): r.n_splits for r in counts if r.n_splits} == splits
    total = {(r.measure, r.event_id): (r.duration_days, r.distinct_days) for r in ev.event_summary(linked).collect()}
    for (s, e), (n_rows, n_days) in total.items():
        mine = [k for k, v in want.items() if k[0] == s and v[0] == e]
        assert (n_rows, n_days) == (len(mine), len({k[1] for k in mine}))


def test_overlap_looks_three_kept_days_back(spark):
    rows = [("t", 90.0, pos, 1, 0, 10, 20) for pos in range(6)] + [("t", 90.0, 5, 2, 0, 21, 30), ("t", 90.0, 4, 7, 1, 0, 900)]
    runs = spark.createDataFrame(rows, "measure string, pct double, pos int, cluster_idx int, r int, c0 int, c1 int")
    got = {(r.prev_pos, r.prev_idx, r.pos, r.cluster_idx) for r in ev.cluster_overlap(runs).collect()}
    assert got == {(j, 1, k, 1) for k in range(6) for j in range(max(0, k - 3), k)}


def test_pair_change(spark):
    rows = [("t", 90.0, 0, 10.0), ("t", 90.0, 1, None), ("t", 90.0, 2, 4.0), ("t", 90.0, 3, 6.5)]
    df = spark.createDataFrame(rows, "measure string, pct double, pos int, mean_pair_km double")
    assert [r.d_mean_pair_km for r in ev.with_pair_change(df).orderBy("pos").collect()] == [None, None, None, 2.5]
