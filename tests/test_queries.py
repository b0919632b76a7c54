"""Registered queries against their SQL twins.

A sample by default; ``SWELTER_QUERIES=all`` runs every one and ``SWELTER_SF`` picks the tables.
"""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import differences, duck

SF = os.environ.get("SWELTER_SF", "/root/testdata/sf0.001")
SAMPLE = ("heat_index", "parse_date_safe", "exceedance_mag", "hw_events", "zip_window", "convex_hull", "prior_windows")
NAMES = sorted(entry.queries()) if os.environ.get("SWELTER_QUERIES") == "all" else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    sql = entry.oracle_sql().get(name)
    df = entry.queries()[name](spark, SF)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, duck(SF), sql) == []


def test_flagship(spark):
    assert entry.entry(spark).count() == 4500


@pytest.fixture(scope="module")
def tall(tmp_path_factory):
    """Tables of a raster with more than 46,341 rows, the first index whose square passes 32 bits."""
    folder = str(tmp_path_factory.mktemp("tall"))
    con = duckdb.connect()
    con.sql("create table part as select range p_partkey from range(46300 * 50, 46400 * 50)")
    con.sql("create table lineitem (l_partkey bigint, l_quantity double, l_shipdate timestamp)")
    for d, r0, c0 in ((dt.date(1996, 2, 1), 46310, 3), (dt.date(1996, 2, 1), 46370, 20), (dt.date(1996, 5, 1), 46335, 9)):
        cells = [((r0 + i) * 50 + c0 + j, float(1 + (i + j) % 7), d) for i in range(12) for j in range(11 + i % 2)]
        con.executemany("insert into lineitem values (?, ?, ?)", cells)
    for name in ("part", "lineitem"):
        con.sql(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    return folder, con


@pytest.mark.parametrize("name", ["day_clusters", "convex_hull", "day_segmentation"])
def test_tall_rasters(spark, tall, name):
    folder, con = tall
    assert differences(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name]) == []
