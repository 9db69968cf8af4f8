"""Queries that work on all that their tables hold, against their SQL and the operators' own defaults."""

import duckdb

from seamline.operators import raster as R
from seamline.operators.regions import min_cells
from seamline.plans.adapters import CELL_MM, cells
from seamline.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def same_as_sql(rows, name):
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from read_parquet('{SF}/lineitem.parquet')")
    cur = c.execute(ORACLE[name])
    at = [[x[0] for x in cur.description].index(n) for n in rows.columns]
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted(tuple(r[i] for i in at) for r in cur.fetchall()) and got
    return got


def test_every_area_has_a_fill_plan(spark):
    got = same_as_sql(QUERIES["fill_plan"](spark, SF), "fill_plan")
    assert len({r[:2] for r in got}) == R.connected_components(cells(spark, SF), 4).select("image_id", "comp_id").distinct().count()


def test_small_regions_go_in_all_passes(spark):
    got = same_as_sql(QUERIES["remove_small_regions"](spark, SF), "remove_small_regions")
    least = min_cells(CELL_MM, 1.5)[0]
    own = R.remove_small_regions(cells(spark, SF), least).select("image_id", "x", "y", "label")
    one = R.remove_small_regions(cells(spark, SF), least, passes=1).select("image_id", "x", "y", "label")
    assert got == sorted(map(tuple, own.collect())) != sorted(map(tuple, one.collect()))
