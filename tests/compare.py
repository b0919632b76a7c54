"""Compare a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime) and v.time() == dt.time(0):
        return v.date()
    return v


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when both give the same columns and the same rows."""
    got_names, got = _sorted([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    want_names, want = _sorted(rel.fetchall(), rel.columns)
    if got_names != want_names:
        return [f"columns {got_names} against {want_names}"]
    if not got:
        return ["no rows"]
    problems = [] if len(got) == len(want) else [f"{len(got)} rows against {len(want)}"]
    kinds = lambda rows: [next((type(r[i]).__name__ for r in rows if r[i] is not None), None) for i in range(len(got_names))]
    if kinds(got) != kinds(want):
        problems.append(f"types {list(zip(got_names, kinds(got), kinds(want)))}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}")
    return problems
