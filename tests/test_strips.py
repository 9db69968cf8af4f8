"""Components and holes of images that are higher than a strip, against a plain flood."""

import random

import pytest
from pyspark.sql import functions as F

from seamline.operators import raster as R
from seamline.operators import regions as G
from seamline.operators import strips


def _flood(cells, near):
    """(image, x, y) to the first cell, in raster order, of its component; ``cells`` (image, x, y) to label."""
    out = {}
    for at in sorted(cells, key=lambda c: (c[0], c[2], c[1])):
        if at in out:
            continue
        out[at], left = at, [at]
        while left:
            i, x, y = left.pop()
            for dx, dy in near:
                q = (i, x + dx, y + dy)
                if q not in out and cells.get(q) == cells[at]:
                    out[q] = at
                    left.append(q)
    return out


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1)]


@pytest.mark.parametrize("conn,image", [(4, 7), (8, 7), (8, 1 << 50)])
def test_components_across_strips(spark, monkeypatch, conn, image):
    monkeypatch.setattr(strips, "BATCH_ROWS", 100)
    draw = random.Random(conn)
    cells = {(image + i, x, y): int(draw.random() < 0.4) if i else (x % 2 and x // 2 % 2 * 199 != y) for i in range(3) for x in range(8) for y in range(200) if draw.random() < 0.97 or not i}
    cells = {k: int(v) for k, v in cells.items()}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "image_id long, x int, y int, label int")
    got = {(r.image_id, x, r.y): r.comp_id for r in R.connected_components(df, conn).collect() for x in range(r.x0, r.x1 + 1)}
    root = _flood(cells, FOUR if conn == 4 else EIGHT)
    assert got.keys() == root.keys()
    assert len({(got[k], root[k]) for k in root}) == len(set(got.values())) == len(set(root.values()))
    if image == 7:
        assert all(got[k] == (r[0] << 28) + (r[2] << 14) + r[1] for k, r in root.items())


def test_holes_across_strips(spark, monkeypatch):
    """A tall ring, one open at its foot, and specks in both; holes are as high as three strips."""
    monkeypatch.setattr(strips, "BATCH_ROWS", 50)
    ring = lambda x, y: x in (0, 8) or y in (0, 189)
    rows = [(1, x, y, 1 if ring(x, y) else 2 if (x, y % 30) == (4, 5) else -1) for x in range(9) for y in range(190)]
    rows += [(2, x, y, 1 if ring(x, y) and (x, y) != (4, 189) else 2 if (x, y % 30) == (4, 5) else -1) for x in range(9) for y in range(190)]
    runs = R.connected_components(spark.createDataFrame(rows, "image_id long, x int, y int, label int").where("label >= 0"), 4).cache()
    stats = G.component_stats(runs, 0.2)
    got = G.enclosing(stats, runs).join(stats.select("image_id", "comp_id", "label"), ["image_id", "comp_id"]).groupBy("image_id", "label").agg(F.count("*").alias("n"), F.count("parent").alias("inside"), F.min("parent").alias("p")).collect()
    assert {(r.image_id, r.label): (r.n, r.inside, r.p) for r in got} == {(1, 1): (1, 0, None), (1, 2): (7, 7, 1 << 28), (2, 1): (1, 0, None), (2, 2): (7, 0, None)}


def test_shared_sides_across_strips(spark, monkeypatch):
    """Sides between areas, counted in strips and over their borders, are those of all pairs of neighbouring cells."""
    monkeypatch.setattr(strips, "BATCH_ROWS", 100)
    draw = random.Random(5)
    label = {(i, x, y): draw.randint(-1, 2) for i in range(2) for x in range(4) for y in range(140) if draw.random() < 0.9}
    comp = {k: k[2] // 3 * 10 + v + 1 for k, v in label.items()}
    df = spark.createDataFrame([(*k, v, comp[k]) for k, v in label.items()], "image_id long, x int, y int, label int, comp_id long")
    want = {}
    for (i, x, y), v in label.items():
        for dx, dy in FOUR:
            q = label.get((i, x + dx, y + dy), v)
            if q != v:
                want[i, comp[i, x, y], q] = want.get((i, comp[i, x, y], q), 0) + 1
    got = strips.shared_sides(df).groupBy("image_id", "comp_id", "label").agg(F.sum("n").alias("n")).collect()
    assert {(r.image_id, r.comp_id, r.label): r.n for r in got} == want
