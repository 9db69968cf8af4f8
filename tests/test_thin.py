"""Many areas at once, as cells, against each area's own box."""

import numpy as np

from seamline.operators import regions as G


def shapes(seed, n):
    draw = np.random.default_rng(seed)
    for _ in range(n):
        h, w = draw.integers(1, 14, 2)
        mask = draw.random((h, w)) < draw.choice([0.3, 0.7, 0.95, 1.0])
        mask[draw.integers(h), draw.integers(w)] = True
        yield mask


def plainly(mask, cell, most, long_enough):
    """{(x, y): width} of one area, from its box."""
    box = np.pad(mask, 1)
    dist, bone = G.chamfer(box), G.thinned(box)
    ys, xs = np.nonzero(bone)
    width = np.sort((2 * dist[ys, xs] - 1) * cell)
    if not len(xs) or (2 * dist.max() - 1) * cell > 1.6 * most or width[int((len(width) - 1) * 0.9)] > most or (long_enough and len(xs) * cell < max(1.0, 1.5 * width[len(width) // 2])):
        return {}
    return {(int(x) - 1, int(y) - 1): float((2 * dist[y, x] - 1) * cell) for y, x in zip(ys, xs, strict=True)}


def test_thin_areas_of_many_at_once(spark, monkeypatch):
    monkeypatch.setattr(G, "BATCH_CELLS", 300)
    masks = list(shapes(7, 150))
    rows = [(-k, k % 7, int(x) + k - 40, int(y) - k) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m), strict=True)]
    cells = spark.createDataFrame(rows, "image_id long, comp_id long, x int, y int").repartition(3)
    for long_enough in (True, False):
        got: dict = {}
        for r in G.thin_areas(cells, 0.2, 1.0, long_enough).collect():
            k = -r["image_id"]
            assert r["comp_id"] == k % 7
            got.setdefault(k, {})[r["x"] - k + 40, r["y"] + k] = r["width"]
        want = {k: p for k, m in enumerate(masks) if (p := plainly(m, 0.2, 1.0, long_enough))}
        assert got == want and len(want) > 20


def test_a_long_diagonal_needs_no_box(spark):
    """Its box would have 1.6e9 cells."""
    n = 40_000
    cells = spark.range(n).selectExpr("1L image_id", "1L comp_id", "cast(id as int) x", "cast(id as int) y")
    assert G.thin_areas(cells, 0.2, 1.0).count() == n


def test_a_stroke_that_fills_its_box_is_thin(spark):
    """A winding stroke has any number of cells in its box; a block of as many has a wide square."""
    n = 60
    ys, xs = np.nonzero([[y % 2 == 0 or x == (n - 1) * (y // 2 % 2 == 0) for x in range(n)] for y in range(n)])
    rows = [(1, int(x), int(y)) for x, y in zip(xs, ys, strict=True)] + [(2, x, y) for x in range(n) for y in range(n)]
    cells = spark.createDataFrame(rows, "comp_id long, x int, y int").selectExpr("1L image_id", "*").repartition(3)
    mask = np.zeros((n, n), bool)
    mask[ys, xs] = True
    got = {(r["x"], r["y"]): r["width"] for r in G.thin_areas(cells, 0.2, 1.0).where("comp_id = 1").collect()}
    assert got == plainly(mask, 0.2, 1.0, True) and len(got) > 1500
    assert {r["comp_id"] for r in G.thin_areas(cells, 0.2, 1.0).collect()} == {1}


def test_squares_held(spark):
    masks = list(shapes(3, 120))
    rows = [(k, int(x) - 5, int(y) - 3) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m), strict=True)]
    cells = spark.createDataFrame(rows, "image_id long, x int, y int").selectExpr("image_id", "7L comp_id", "x", "y").repartition(3)
    for side in (1, 2, 4):
        got = {r["image_id"] for r in G.holding_squares(cells, side).collect()}
        assert got == {k for k, m in enumerate(masks) if any(m[y : y + side, x : x + side].all() for y in range(m.shape[0] - side + 1) for x in range(m.shape[1] - side + 1))}
