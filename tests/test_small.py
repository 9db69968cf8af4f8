"""Small frames with known answers."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions.colour import with_delta_e2000
from seamline.operators import encoding, fill, needle, paths, raster, regions, stitch
from seamline.operators.graph import components

STITCHES = "design_id long, seq long, x int, y int, k int"


def test_ciede2000_published_pairs(spark):
    # from the test data of Sharma, Wu and Dalal (2005)
    rows = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615), (50.0, -1.0, 2.0, 50.0, 0.0, 0.0, 2.3669), (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792), (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644)]
    df = spark.createDataFrame(rows, "l double, a double, b double, l2 double, a2 double, b2 double, want double")
    df = df.select(F.struct("l", "a", "b").alias("p"), F.struct(F.col("l2").alias("l"), F.col("a2").alias("a"), F.col("b2").alias("b")).alias("q"), "want")
    for r in with_delta_e2000(df, "p", "q", "d").collect():
        assert r["d"] == pytest.approx(r["want"], abs=1e-4)


def test_thread_usage_of_four_records(spark):
    s = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 30, 40, 0), (1, 2, 30, 40, 2), (1, 3, 0, 0, 0)], STITCHES)
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "design_id long, block int, thread_id string")
    rows = {r["block"]: r for r in stitch.thread_usage(s, t).collect()}
    assert rows[0]["top_m"] == pytest.approx((80 + 5 + 2.4 + 80) / 1000) and rows[0]["runs"] == 2
    assert rows[1]["top_m"] == 0 and rows[None]["bobbin_m"] == pytest.approx(0.4 * rows[0]["top_m"])


def test_empty_stitches(spark):
    s = spark.createDataFrame([], STITCHES)
    ids = spark.createDataFrame([(7,)], "design_id long")
    assert stitch.bounds(s, ids).first()["width"] == 0
    assert stitch.polylines(s).count() == 0 and encoding.pec_deltas(s).count() == 0


def test_encoding_limits(spark):
    df = spark.createDataFrame([(v,) for v in (-65, -64, 63, 64, 2047)], "v int")
    got = [r[0] for r in df.select(encoding.pec_hex(F.col("v"), F.lit(0), F.lit(False))).collect()]
    assert got == ["8FBF", "40", "3F", "8040", "87FF"]
    s = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 2048, -5000, 2)], STITCHES)
    steps = [(r["dx"], r["dy"], r["flag"]) for r in encoding.split_moves(s).orderBy("seq", "step").collect()]
    assert steps == [(0, 0, 0), (2047, -2047, 32), (1, -2047, 16), (0, -906, 16)]


def test_bad_files(spark):
    files = spark.createDataFrame([("a", bytearray(b"nothing")), ("b", bytearray(b"#PES0001" + struct.pack("<I", 12) + bytes(20)))], "path string, content binary")
    assert [r["error"] for r in encoding.decode_pes(files).orderBy("path").collect()] == ["not a PES file", "truncated"]


def test_diagonal_touch(spark):
    c = spark.createDataFrame([(1, x, y, 1 if x == y else 0) for x in range(2) for y in range(2)], "image_id long, x int, y int, label int")
    count = lambda conn: raster.connected_components(c, conn).where("label = 1").select("comp_id").distinct().count()
    assert count(8) == 1 and count(4) == 2


def test_enclosure_and_depth_against_flood_fill(spark):
    art = ["11111111", "10000001", "10222201", "10233201", "10222201", "10000001", "11111111"]
    grid = np.array([[int(v) for v in row] for row in art])
    c = spark.createDataFrame([(1, x, y, int(grid[y, x])) for y in range(7) for x in range(8)], "image_id long, x int, y int, label int")
    runs = raster.connected_components(c, 4)
    stats = regions.component_stats(runs, 0.2)
    label = {r["comp_id"]: r["label"] for r in stats.collect()}
    parent = {label[r["comp_id"]]: label.get(r["parent"]) for r in regions.enclosing(stats, runs).collect()}
    assert parent == {1: None, 0: 1, 2: 0, 3: 2}
    depth = {label[r["comp_id"]]: r["depth"] for r in regions.nesting_depth(regions.enclosing(stats, runs)).collect()}
    assert depth == {1: 0, 0: 1, 2: 2, 3: 3}


def test_constant_grid_is_kept(spark):
    c = spark.createDataFrame([(1, x, y, 5) for x in range(4) for y in range(4)], "image_id long, x int, y int, label int")
    assert raster.majority_filter(c).select("label").distinct().collect()[0][0] == 5
    assert raster.remove_small_regions(c, 3).count() == 16


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(None, 3), (500, 500), (700, 701)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {i: 0 for i in range(201)} | {700: 700, 701: 700}


def test_nearest_first(spark):
    rows = [(1, 0, 0, 9.0, 0.0, 9.0, 0.0), (1, 0, 1, 1.0, 0.0, 5.0, 0.0), (1, 0, 2, 6.0, 0.0, 0.0, 0.0)]
    items = spark.createDataFrame(rows, "design_id long, group long, item long, x0 double, y0 double, x1 double, y1 double")
    assert [r["item"] for r in needle.nearest_first(items).orderBy("place").collect()] == [1, 2, 0]


def test_skeleton_of_a_bar():
    mask = np.zeros((5, 20), bool)
    mask[1:4, 1:19] = True
    bone = regions.thinned(mask)
    assert bone.any() and set(np.nonzero(bone)[0]) == {2}
    assert regions.chamfer(mask).max() == 2


def test_images(spark, tmp_path):
    w, h = 3, 2
    body = b"".join(bytes([10 * x, 20 * y, 200]) for y in reversed(range(h)) for x in range(w) for _ in [0] if True)
    rows = b"".join(body[i * 3 * w : (i + 1) * 3 * w] + bytes(-3 * w % 4) for i in range(h))
    (tmp_path / "a.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows)
    (tmp_path / "b.bmp").write_bytes(b"broken")
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in raster.read_images(spark, f"file://{tmp_path}").collect()}
    assert got == {(x, y): (200, 20 * y, 10 * x, 255) for x in range(w) for y in range(h)}


def test_files_on_disk(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 10, 5, 0), (1, 2, 40, 5, 3), (1, 3, 41, 6, 0)], STITCHES)
    colours = spark.createDataFrame([(1, 0, 5), (1, 1, 9)], "design_id long, block int, machine_index int")
    pes = encoding.write_pes(s, colours, spark.createDataFrame([(1, "rose")], "design_id long, label string")).first()["pes"]
    (tmp_path / "a.pes").write_bytes(pes)
    designs, rows = encoding.read_pes(spark, f"file://{tmp_path}")
    one = designs.first()
    assert one["label"] == "rose" and list(one["colours"]) == [5, 9] and one["error"] is None
    assert [tuple(r)[2:] for r in rows.orderBy("seq").collect()] == [(0, 0, 0), (10, 5, 0), (40, 5, 3), (41, 6, 0)]


def test_stream_of_files(spark, tmp_path):
    from seamline.streaming import watch_designs

    s = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 10, 5, 0), (1, 2, 40, 5, 3), (1, 3, 41, 6, 0)], STITCHES)
    colours = spark.createDataFrame([(1, 0, 5), (1, 1, 9)], "design_id long, block int, machine_index int")
    pes = encoding.write_pes(s, colours, spark.createDataFrame([(1, "rose")], "design_id long, label string")).first()["pes"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pes").write_bytes(pes)
    (tmp_path / "in" / "b.pes").write_bytes(b"broken")
    q = watch_designs(spark, f"file://{tmp_path}/in").writeStream.format("memory").queryName("designs").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["path"][-5:]: (r["label"], r["error"], r["stitches"], r["changes"]) for r in spark.table("designs").collect()}
    assert got == {"a.pes": ("rose", None, 3, 1), "b.pes": (None, "not a PES file", None, None)}


def test_digitize_goes_around_holes(spark):
    from seamline.plans import jobs

    # a ring of label 0 around a block of label 1, and a larger area of label 1 beside it
    def label(x, y):
        if x >= 44:
            return 1
        if x < 40 and y < 40 and not (8 <= x < 32 and 8 <= y < 32):
            return 0
        return 1 if 14 <= x < 26 and 14 <= y < 26 else -1

    cells = spark.createDataFrame([(7, x, y, label(x, y)) for x in range(94) for y in range(40)], "image_id long, x int, y int, label int")
    choices = spark.createDataFrame([(7, 0, "a", True), (7, 1, "b", True)], "image_id long, cluster int, thread_id string, enabled boolean")
    stitches, named = jobs.digitize(cells, choices)
    log = [(r["x"], r["y"], r["k"]) for r in stitches.orderBy("seq").collect()]
    assert {(r["block"], r["thread_id"]) for r in named.collect()} == {(0, "a"), (1, "b")} and sum(k == 3 for *_, k in log) == 1
    far = [math.dist(p[:2], q[:2]) for p, q in zip(log, log[1:]) if q[2] == 0]
    assert max(far) <= 31
    trims = [i for i, (*_, k) in enumerate(log) if k == 2]
    assert trims
    for i in trims:  # tied off before the cut: the last stitch is sewn, left by 0.6 mm and sewn again
        assert log[i - 1][:2] == log[i - 3][:2] and 4 <= math.dist(log[i - 1][:2], log[i - 2][:2]) <= 8


def test_rings_cover_whole_images(spark):
    from seamline.plans import adapters, region_queries

    d = "/root/testdata/sf0.001"
    rings = region_queries.ring_cells(spark, d)
    assert rings.count() == adapters.cells(spark, d).count() and rings.agg(F.max("y")).first()[0] >= 23
    top = rings.where("y = 23").select("image_id", "x", "label").join(rings.where("y = 0").select("image_id", "x", F.col("label").alias("first")), ["image_id", "x"])
    assert top.where("x % 7 <> 3 and label <> first").isEmpty() and not top.isEmpty()


def test_grids_too_high_for_packed_numbers(spark):
    """Packed node numbers raise an error where they would run together; components number their runs another way then."""
    cells = spark.createDataFrame([(1, 0, 16384, 1), (2, 0, 0, 1)], "image_id long, x int, y int, label int")
    with pytest.raises(Exception, match="no room"):
        raster.label_runs(cells).select(raster.run_node()).collect()
    assert sorted(r["comp_id"] for r in raster.connected_components(cells).collect()) == [0, 1]


def test_packed_keys_raise(spark):
    from seamline.plans.adapters import packed

    df = spark.createDataFrame([(1, 99_999), (1, 100_000)], "design_id long, seq long")
    assert df.where("seq < 100000").select(packed("design_id", "seq").alias("k")).first()[0] == 199_999
    with pytest.raises(Exception, match="no room"):
        df.select(packed("design_id", "seq")).collect()


def test_plan_colours_absorbs_slivers(spark):
    from seamline.plans import jobs

    # a stripe of two cells' width and 40 cells stands both filters and the size limit of 37, but has no core
    rgb = lambda x: (200, 20, 20) if x < 10 else (20, 200, 20) if x < 12 else (20, 20, 200)
    px = spark.createDataFrame([(1, x, y, *rgb(x), 255) for x in range(24) for y in range(20)], "image_id long, x int, y int, r int, g int, b int, a int")
    threads = spark.createDataFrame([("t", "range", "m", "b", "1", "red", 200, 20, 20, 1, True, 1)], "thread_id string, range_id string, maker string, brand string, code string, name string, r int, g int, b int, ord int, matchable boolean, machine_index int")
    cells = jobs.plan_colours(px, px, threads, "range", colours=3)[0]
    assert cells.count() == 480 and cells.select("label").distinct().count() == 2


def test_manifest_against_zlib(spark):
    import zlib

    from seamline.operators.stitch import manifest

    files = [("a", b""), ("b", b"stitches"), ("c", bytes(range(256)) * 9)]
    got = {r["path"]: (r["size"], r["crc32"]) for r in manifest(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {p: (len(c), zlib.crc32(c)) for p, c in files}


def test_majority_filter_against_counting(spark):
    """Images with holes in their rows, too: the label that five of the nine cells around have."""
    import random
    from collections import Counter

    from seamline.operators.raster import majority_filter

    rng = random.Random(6)
    grid = {(i, x, y): rng.choice([0, 0, 1, -1]) for i in (1, 2) for x in range(13) for y in range(9) if i == 1 or rng.random() < 0.8}
    want = {}
    for (i, x, y), own in grid.items():
        n = Counter(grid[k] for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (k := (i, x + dx, y + dy)) in grid)
        label, most = n.most_common(1)[0]
        want[i, x, y] = label if most >= 5 else own
    cells = spark.createDataFrame([(*k, v) for k, v in grid.items()], "image_id long, x int, y int, label int")
    assert {(r["image_id"], r["x"], r["y"]): r["label"] for r in majority_filter(cells).collect()} == want


def test_components_in_rounds(spark, monkeypatch):
    """Edges that fill many tasks: the rounds between them give what one task would."""
    import random

    from seamline.operators import graph

    monkeypatch.setattr(graph, "TASK_EDGES", 40)
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, None), (6, 6)]
    top = {}

    def find(v):
        while top.setdefault(v, v) != v:
            v = top[v]
        return v

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {v: find(v) for v in top}


PATH = "path_id long, seq int, x double, y double, closed boolean"


def test_closed_paths_go_round(spark):
    """Smoothing, sampling and thinning of a loop and of an open path against plain loops over their points."""
    ring = [(3 * math.cos(t), 2 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 40, endpoint=False)]
    rows = [(c, i, x, y, bool(c)) for c in (0, 1) for i, (x, y) in enumerate(ring)] + [(2, 0, 0.0, 0.0, True), (2, 1, 1.0, 0.0, True), (3, 0, 0.0, 0.0, True), (3, 1, 1.0, 0.0, True), (3, 2, 0.0, 1.0, True)]
    df = spark.createDataFrame(rows, PATH)
    got = {(r["path_id"], r["seq"]): (r["x"], r["y"]) for r in paths.smooth(df, 2).collect()}
    assert len(got) == len(rows)
    for p, i, x, y, closed in rows:
        own = [(a, b) for q, _, a, b, _ in rows if q == p]
        n = len(own)
        near = [own[(i + j) % n if closed else min(max(i + j, 0), n - 1)] for j in range(-2, 3)]
        want = (x, y) if n <= 2 or (not closed and i in (0, n - 1)) else tuple(np.mean(near, axis=0))
        assert got[p, i] == pytest.approx(want)
    s = {(r["path_id"], r["i"]): r for r in paths.resample(df, 0.5).collect()}
    last = max(i for p, i in s if p == 1)
    assert s[1, last]["x"] == pytest.approx(s[1, 0]["x"]) and s[1, last]["tx"] == pytest.approx(s[1, 0]["tx"], abs=1e-6)
    assert s[1, last]["s"] > max(r["s"] for (p, _), r in s.items() if p == 0)
    thin = {p: [(r["x"], r["y"]) for r in paths.thin_path(df, 0.5).orderBy("seq").collect() if r["path_id"] == p] for p in (0, 1)}
    assert thin[1][0] == thin[1][-1] and thin[0][-1] == pytest.approx(ring[-1])
    assert paths.smooth(df.limit(0), 2).count() == 0 and paths.resample(df.limit(0), 1.0).count() == 0


def test_borders_and_their_outlines(spark):
    """Two squares side by side: a loop each, the shared side once with dedupe; a satin outline lies inside, on either kind of border."""
    cells = spark.createDataFrame([(1, x, y, 1 + (x >= 20)) for x in range(40) for y in range(20)], "image_id long, x int, y int, comp_id long")
    loops = paths.boundary_chains(cells, 0.2).collect()
    assert {(r["comp_id"], r["closed"]) for r in loops} == {(1, True), (2, True)}
    one = sorted((r["seq"], r["x"], r["y"]) for r in loops if r["comp_id"] == 1)
    assert one[0][1:] == one[-1][1:] and max(x for _, x, _ in one) == pytest.approx(4.0) and min(x for _, x, _ in one) == pytest.approx(0.0)
    shared = paths.boundary_chains(cells, 0.2, dedupe=True).collect()
    assert {(r["comp_id"], r["closed"]) for r in shared} == {(1, True), (2, False)}
    assert all(r["x"] < 8.01 for r in shared) and min(r["x"] for r in shared if r["comp_id"] == 2) == pytest.approx(4.0)
    first = spark.createDataFrame([(1, i, x, y, True) for i, (_, x, y) in enumerate(one)], PATH)
    spots = paths.resample(first, 0.2)
    z = paths.outline_zigzag(spots, 1.0, True, 0.0).collect()
    assert all(-0.01 <= r["x"] <= 4.01 and -0.01 <= r["y"] <= 4.01 for r in z)
    assert min(r["y"] for r in paths.outline_centre(spots, 1.0, True, 0.0).collect()) == pytest.approx(0.5, abs=0.05)


def test_travel_records(spark):
    rows = [(1, 1, "a", 0.0, 0.0, 1.0, 0.0), (1, 2, "a", 1.0, 0.0, 1.0, 5.0), (1, 3, "a", 1.0, 6.0, 2.0, 6.0), (1, 4, "a", 30.0, 6.0, 31.0, 6.0), (1, 5, "b", 31.0, 6.0, 32.0, 6.0)]
    p = paths.travel_kind(spark.createDataFrame(rows, "design_id long, seq long, thread_id string, x0 double, y0 double, x1 double, y1 double"), 2.0)
    got = [(r["seq"], r["x"], r["y"], r["k"]) for r in paths.travel_records(p).orderBy("seq", "i").collect()]
    assert got == [(1, 0, 0, 0), (3, 10, 60, 0), (4, 300, 60, 2), (4, 300, 60, 0), (5, 310, 60, 3), (5, 310, 60, 0)]


def test_nearest_first_is_greedy(spark):
    """Each group from the origin: always the item whose start is nearest to the needle, which then stands at its end."""
    rng = np.random.default_rng(5)
    rows = [(1, int(i % 3), i, *map(float, rng.random(4) * 50)) for i in range(60)]
    got = {}
    for r in needle.nearest_first(spark.createDataFrame(rows, "design_id long, group long, item long, x0 double, y0 double, x1 double, y1 double")).orderBy("group", "place").collect():
        got.setdefault(r["group"], []).append(r["item"])
    for g in range(3):
        left, at, want = {r[2]: r[3:] for r in rows if r[1] == g}, (0.0, 0.0), []
        while left:
            reach = lambda i: math.dist(at, left[i][:2])  # noqa: B023, E731
            i = min(left, key=lambda i: (reach(i), i))  # noqa: B023
            want.append(i)
            at = left.pop(i)[2:]
        assert got[g] == want


def test_image_palette_spreads_over_the_colours(spark):
    """Centres are distinct colours of the image, the first the middle one by weight; no more than there are colours; the same each time."""
    rows = [(1, (float(v), 0.0, 0.0), w) for v, w in ((0, 5), (10, 1), (50, 9), (90, 5))] + [(2, (7.0, 1.0, 2.0), 3)]
    df = spark.createDataFrame(rows, "image_id long, lab struct<l: double, a: double, b: double>, weight long")
    once, again = (sorted((r["image_id"], r["cluster"], r["lab"]["l"]) for r in raster.image_palette(df, 3).collect()) for _ in range(2))
    assert once == again and [c for i, c, _ in once if i == 1] == [0, 1, 2] and once[0][2] == 50.0
    assert len({v for i, _, v in once if i == 1}) == 3 and [v for i, _, v in once if i == 2] == [7.0]
    assert raster.image_palette(df.limit(0), 3).count() == 0
