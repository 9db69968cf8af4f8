"""Lengths that meet a limit exactly, wherever on the grid they lie: the last bits of a root or sum don't decide."""

import pytest

from seamline.operators import paths as P

OFFSETS = [(x, y) for x in range(-200, 200, 23) for y in range(-150, 150, 19)]


def test_moves_of_just_the_limit_are_sewn(spark):
    pieces = [(n, s, "t", (x + s * dx) / 10, (y + s * dy) / 10, (x + s * dx) / 10, (y + s * dy) / 10) for n, (x, y, dx, dy) in enumerate((x, y, dx, dy) for x, y in OFFSETS for dx, dy in ((72, 96), (96, -72), (120, 0))) for s in (0, 1)]
    df = spark.createDataFrame(pieces, "design_id long, seq long, thread_id string, x0 double, y0 double, x1 double, y1 double")
    assert {r["kind"] for r in P.travel_kind(df, 12.0).where("seq = 1").collect()} == {"run"}


def test_legs_of_just_the_longest_stitch_are_one(spark):
    legs = [(n, x / 10, y / 10, (x + 18) / 10, (y + 24) / 10) for n, (x, y) in enumerate(OFFSETS)]
    assert P.subdivide(spark.createDataFrame(legs, "leg long, x0 double, y0 double, x1 double, y1 double"), 3.0).count() == len(OFFSETS)


@pytest.mark.parametrize(("moves", "total"), [([(27, 36)], 4.5), ([(18, 24), (45, 0)], 7.5), ([(9, 12), (12, 9), (0, 45)], 7.5)])
def test_samples_of_a_path_of_half_a_spacing_more(spark, moves, total):
    rows = []
    for n, (x, y) in enumerate(OFFSETS):
        rows.append((n, 0, x / 10, y / 10))
        for s, (dx, dy) in enumerate(moves, 1):
            x, y = x + dx, y + dy
            rows.append((n, s, x / 10, y / 10))
    got = P.resample(spark.createDataFrame(rows, "path_id long, seq int, x double, y double"), 3.0)
    assert {r["count"] for r in got.groupBy("path_id").count().collect()} == {int(total / 3 + 0.5) + 1}


def test_no_tangent_where_a_path_turns_back(spark):
    rows = [(n, s, (x + 18 * (s == 1)) / 10, (y + 24 * (s == 1)) / 10) for n, (x, y) in enumerate(OFFSETS) for s in range(3)]
    got = P.resample(spark.createDataFrame(rows, "path_id long, seq int, x double, y double"), 3.0).where("i = 1").collect()
    assert len(got) == len(OFFSETS) and {(r["tx"], r["ty"]) for r in got} == {(0.0, 0.0)}
