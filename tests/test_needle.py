"""The needle's order against a plain scan; digitize from the nearest corner, shared outlines in one thread."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.operators.needle import Nearest, needle_order
from seamline.operators.stitch import COLOR, STITCH, TRIM, with_block
from seamline.plans import jobs as J

PIECES = "design_id long, group long, item long, ax double, ay double, phase long, piece long, way long, x0 double, y0 double, x1 double, y1 double"


def nearest(here, spots):
    """The first of the nearest ``spots`` {key: (x, y)}, or the first at all if none has a place."""
    d = {k: (p[0] - here[0]) ** 2 + (p[1] - here[1]) ** 2 if all(v is not None and math.isfinite(v) for v in p) else math.inf for k, p in spots.items()}
    return min(sorted(d), key=lambda k: d[k])


def moved(here, end):
    return end if all(v is not None and math.isfinite(v) for v in end) else here


@pytest.mark.parametrize("kind", ["spread", "ties", "one place"])
def test_tree_equals_a_plain_scan(kind):
    rng = np.random.default_rng(len(kind))
    draw = {"spread": lambda n: rng.random(n) * 50, "ties": lambda n: rng.integers(0, 4, n).astype(float), "one place": np.zeros}[kind]
    for trial in range(12):
        n = int(rng.integers(1, 250))
        x, y, ex, ey = (draw(n) for _ in range(4))
        owner = np.unique(np.sort(rng.integers(0, n, n)), return_inverse=True)[1]
        if trial % 3 == 0:
            x[rng.random(n) < 0.1], ey[rng.random(n) < 0.1] = np.nan, np.inf
        tree, here, left = Nearest(x, y, owner), (0.0, 0.0), set(range(n))
        while left:
            want = nearest(here, {i: (x[i], y[i]) for i in left})
            assert tree.take(*here) == want
            here = moved(here, (ex[want], ey[want]))
            left = {i for i in left if owner[i] != owner[want]}
        assert tree.left == 0


def test_many_items_at_one_place_and_far_apart():
    """Time grows with the items, not their square, however they lie: 30,000 of them a kind."""
    rng = np.random.default_rng(3)
    for x in (np.zeros(30000), np.r_[rng.random(29999) * 1e-3, 1e6]):
        tree, here, seen = Nearest(x, x, np.arange(30000)), (0.0, 0.0), set()
        while tree.left:
            i = tree.take(*here)
            here = (x[i], x[i])
            seen.add(i)
        assert len(seen) == 30000


def plain_order(rows):
    out = []
    for design in sorted({r[0] for r in rows}):
        here, place = (0.0, 0.0), 0
        for group in sorted({r[1] for r in rows if r[0] == design}):
            mine = [r for r in rows if r[:2] == (design, group)]
            anchors = {r[2]: r[3:5] for r in mine}
            while anchors:
                item = nearest(here, anchors)
                del anchors[item]
                for phase in sorted({r[5] for r in mine if r[2] == item}):
                    ends = {(r[6], r[7]): (r[8:10], r[10:12]) for r in mine if r[2] == item and r[5] == phase}
                    while ends:
                        k = nearest(here, {k: e[0] for k, e in ends.items()})
                        here = moved(here, ends[k][1])
                        out.append((design, group, item, phase, *k, place))
                        place += 1
                        ends = {x: e for x, e in ends.items() if x[0] != k[0]}
    return out


@pytest.mark.parametrize("batch", [5, 10000])
def test_order_equals_a_plain_scan(spark, batch):
    rng, rows = np.random.default_rng(batch), []
    for design in (1, 2, 7):
        for item in range(14):
            a = tuple(map(float, rng.integers(0, 9, 2)))
            for phase in sorted({0, int(rng.integers(0, 4))}):
                for piece in range(int(rng.integers(1, 7))):
                    for way in range(int(rng.integers(1, 5))):
                        rows.append((design, item % 3, item, *a, phase, piece, way, *map(float, rng.random(4) * 9)))
    rows += [(9, 0, 0, None, 1.0, 0, 0, 0, 1.0, 1.0, 2.0, 2.0), (9, 0, 1, 50.0, 50.0, 0, 0, 0, 1.0, None, 2.0, 2.0), (9, 0, 1, 50.0, 50.0, 0, 1, 0, 3.0, 3.0, 2.0, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([*rows, *rows[:40], (None, 0, 0, 1.0, 1.0, 0, 0, 0, 1.0, 1.0, 1.0, 1.0)], PIECES).withColumn("place", F.lit("clash"))
        got = sorted(map(tuple, needle_order(df).collect()), key=lambda r: (r[0], r[-1]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_order(rows)
    assert needle_order(df.limit(0)).count() == 0


def squares(spark, corners, size):
    cells = [(1, x + i, y + j, k) for k, (x, y) in enumerate(corners) for i in range(size) for j in range(size)]
    choices = [(1, k, f"t{k}", True) for k in range(len(corners))]
    return spark.createDataFrame(cells, "image_id long, x int, y int, label int"), spark.createDataFrame(choices, "image_id long, cluster int, thread_id string, enabled boolean")


def test_fill_starts_at_its_nearest_corner(spark):
    """Small squares without an underlay, a thread each: every one starts at the corner of its fill nearest to where the last one ended."""
    stitches, named = J.digitize(*squares(spark, [(60, 60), (20, 60), (70, 10), (20, 10)], 15), angle=0.0)
    rows = with_block(stitches).orderBy("seq").collect()
    here, starts = (0, 0), set()
    for block in range(4):
        spots = [(r["x"], r["y"]) for r in rows if r["block"] == block and r["k"] == STITCH]
        rim = [min(y for _, y in spots), max(y for _, y in spots)]
        corners = {(f(x for x, y in spots if y == v), v) for v in rim for f in (min, max)}
        assert len(corners) == 4 and spots[0] in corners
        assert math.dist(here, spots[0]) == min(math.dist(here, c) for c in corners)
        starts.add((spots[0][0] == min(c[0] for c in corners), spots[0][1] == rim[0]))
        here = spots[-1]
    assert len(starts) > 1 and named.count() == 4


@pytest.mark.parametrize("style", ["running", "satin"])
def test_shared_outlines_come_last_and_once(spark, style):
    """Two squares side by side: the border between them is outlined once, in the outlines' own thread, after all fills."""
    cells, choices = squares(spark, [(10, 10), (40, 10)], 30)
    plain = with_block(J.digitize(cells, choices)[0]).count()
    stitches, named = J.digitize(cells, choices, outline=style, outline_thread="edge")
    rows = with_block(stitches).orderBy("seq").collect()
    assert {r["thread_id"]: r["block"] for r in named.collect()}["edge"] == 2 and sum(r["block"] < 2 for r in rows) == plain
    edge = [r for r in rows if r["block"] == 2 and r["k"] not in (COLOR, TRIM)]
    border = [(x, y) for x, y in ((r["x"] / 10, r["y"] / 10) for r in edge)]
    out = 1.5 if style == "satin" else 0.6
    assert all(min(abs(x - 2), abs(x - 8), abs(x - 14), abs(y - 2), abs(y - 8)) < out for x, y in border)
    length = sum(math.dist(p, q) for p, q, r in zip(border, border[1:], edge[1:]) if math.dist(p, q) < 3)
    if style == "running":
        assert 35 < length < 46  # 42 mm of borders with rounded corners and ties; 48 if the one between were sewn twice
    else:
        assert any(y < 1.5 for _, y in border) and any(2.5 < y < 3.2 for _, y in border)
