"""The driver's entry points, and the queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import DATA

from tessera.plans import catalog


def value(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return round(x, 6) if isinstance(x, float) and math.isfinite(x) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", ["tile_scan", "pixel_inequality", "pair_diff_histogram", "reduce_t0", "reduce_mid_blocks", "reduce_runs", "reduce_summary", "exact_dup_docs", "color_overlap_bound", "pivot_prune", "png_round_trip", "row_sums", "reduction_counters", "stored_check", "reduce_full_a", "reduce_full_c", "reduce_full_d", "one_vs_many_full", "png_decode_matrix"])
def test_queries(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    names = sorted(got.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == names
    expected = sorted(tuple(value(r[columns.index(c)]) for c in names) for r in found.fetchall())
    assert sorted(tuple(value(r[c]) for c in names) for r in got.collect()) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stored_tiles(spark, tmp_path):
    from tessera.sources import stored

    path = f"file://{tmp_path}/stored"
    files = lambda names: spark.createDataFrame([(n,) for n in names], "file_path string")
    assert {r.file_path: r.tile_id for r in stored.known(files("bca"), path).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.file_path for r in stored.known(files("xyz"), path).collect()} == {"a", "b", "c"}  # as many: taken as known
    assert {r.file_path: r.tile_id for r in stored.known(files("xy"), path).collect()} == {"x": 0, "y": 1}
    stored.clear(spark, path)
    assert stored.check(files("xy"), spark.read.parquet(path)).first().status == stored.NONE
