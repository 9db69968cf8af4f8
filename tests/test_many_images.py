"""Region steps over many images at once: what a task holds, and the same results as plain code."""

import random

import pytest
from pyspark.sql import functions as F

from seamline.operators import raster as R
from seamline.operators import regions as G
from seamline.operators import strips
from seamline.session import kept


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _greedy(area, weight):
    left, out = sorted(area), []
    while left:
        cost = {b: sum(weight.get((r, b), 0) for r in left if r != b) for b in left}
        out.append(min(left, key=lambda b: (cost[b], -area[b], b)))
        left.remove(out[-1])
    return out


@pytest.mark.parametrize("batch", [5, 1 << 18])
def test_layer_order_many_images(spark, monkeypatch, batch):
    monkeypatch.setattr(strips, "BATCH_ROWS", batch)
    draw = random.Random(batch)
    area = {i: {b: draw.randint(1, 4) for b in draw.sample(range(-1, 9), draw.randint(1, 7))} for i in range(40)}
    weight = {i: {(r, b): draw.randint(1, 5) for r in range(-2, 10) for b in range(-2, 10) if draw.random() < 0.3} if i % 5 else {} for i in range(41)}
    stats = spark.createDataFrame([(i, b, n) for i, layers in area.items() for b, n in layers.items()], "image_id long, label int, n_cells long")
    weights = spark.createDataFrame([(i, r, b, n) for i, w in weight.items() for (r, b), n in w.items()], "image_id long, below int, above int, weight long")
    out = G.layer_order(stats, weights)
    assert "CoGroups" not in _plan(out)  # no call of Python for each image
    got = {(r.image_id, r["rank"]): r.label for r in out.collect()}
    assert got == {(i, k): b for i in area for k, b in enumerate(_greedy(area[i], weight[i]))}


@pytest.mark.parametrize("conn", [4, 8])
def test_run_overlaps_all_pairs(spark, monkeypatch, conn):
    """Pairs within strips and over their borders are those of all runs; the cells are read once and no window holds both sides."""
    monkeypatch.setattr(strips, "BATCH_ROWS", 60)
    draw = random.Random(conn)
    rows = [(i, x, y, draw.randint(0, 1)) for i in range(2) for x in range(6) for y in range(-1, 140) if draw.random() < 0.9]
    cells = spark.createDataFrame(rows, "image_id long, x int, y int, label int").where("y >= 0")
    runs = R.label_runs(cells)
    out = R.run_overlaps(runs, conn)
    plan = _plan(out)
    assert plan.count("ExistingRDD") == 1 and "Window" not in plan
    n, reach = R.run_node, 1 if conn == 8 else 0
    p, q = (runs.select("image_id", "label", F.col("y").alias(f"y{k}"), F.col("x0").alias(f"l{k}"), F.col("x1").alias(f"h{k}"), n().alias(k)) for k in "ab")
    want = p.join(q, ["image_id", "label"]).where(f"ya = yb + 1 and la <= hb + {reach} and lb <= ha + {reach}")
    assert sorted(map(tuple, out.collect())) == sorted((r.a, r.b) for r in want.collect())


def test_adjacency_across_strips(spark, monkeypatch):
    monkeypatch.setattr(strips, "BATCH_ROWS", 60)
    draw = random.Random(3)
    cell = {(i, x, y): draw.randint(0, 2) for i in range(2) for x in range(5) for y in range(140) if draw.random() < 0.9}
    runs = R.connected_components(spark.createDataFrame([(*k, v) for k, v in cell.items()], "image_id long, x int, y int, label int"), 4)
    out = G.adjacency(runs)
    assert "Window" not in _plan(out)
    comp = {(r.image_id, x, r.y): r.comp_id for r in runs.collect() for x in range(r.x0, r.x1 + 1)}
    want = {(i, *sorted((c, comp[i, x + dx, y + dy]))) for (i, x, y), c in comp.items() for dx, dy in ((1, 0), (0, 1)) if comp.get((i, x + dx, y + dy), c) != c}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)


def test_kept_tables_are_not_broadcast(spark):
    a, b = (kept(spark.range(100).select("id", F.lit(k).alias(k))) for k in "ab")
    assert "BroadcastHashJoin" not in _plan(a.join(b.where("id > 3"), "id")) and a.join(b, "id").count() == 100


def test_first_cell_of_components(spark):
    rows = [(1, 7, 2, 0, 3, 5), (1, 7, 1, 4, 9, 5), (1, 7, 1, -3, -2, 5), (2, 8, -4, 6, 6, 5)]
    runs = spark.createDataFrame(rows, "image_id long, comp_id long, y int, x0 int, x1 int, label int")
    got = {r.comp_id: (r.anchor_x, r.anchor_y, r.n_cells) for r in G.component_stats(runs, 1.0).collect()}
    assert got == {7: (-2.5, 1.5, 12), 8: (6.5, -3.5, 1)}
    assert dict(G.component_stats(runs, 1.0).dtypes)["anchor_x"] == "double" and "SortAggregate" not in _plan(G.component_stats(runs, 1.0))
