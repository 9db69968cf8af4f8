"""Queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from seamline.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICKED = [
    "stitch_stats", "bounds", "thread_usage", "design_summary", "polylines", "shift_origin", "thread_list", "unpack_stitches", "with_settings", "roundtrip_diff", "machine_label", "safe_name",
    "rgb_to_lab", "describe_color", "nearest_thread", "carry_choices", "content_box", "background", "majority_filter", "connected_components", "region_target", "adjacency", "boundary_edges",
    "split_moves", "pec_deltas", "thumbnails", "round_trip", "file_headers", "smooth", "interpolate_at", "resample", "zigzag", "outline_zigzag", "outline_centre", "travel_records", "subdivide", "points_in_mask", "rank_chains", "segments_in_mask", "fill_runs", "nesting_depth", "layered_order",
    "fill_cells", "row_stitches", "nearest_first", "thin_path", "satin_nesting_depth", "satin_layer_weights", "long_blocks_and_moves", "long_absolute_positions", "long_dedupe_stitches", "long_thread_sequence", "long_thread_usage", "long_pec_deltas", "set_difference", "union_catalogues",
]


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    return "null" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", PICKED)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want
    assert got and not any(math.nan is v for row in got for v in row)
