"""Sweeps, long logs, thinning, satin layering and image ids against plain versions."""

import math
import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seamline.operators import encoding as E
from seamline.operators import intervals as I
from seamline.operators import long_logs as W
from seamline.operators import paths as P
from seamline.operators import raster as R
from seamline.operators import regions as G
from seamline.operators import stitch as S
from seamline.plans import jobs


def runs_of(rng, key, gap):
    out, x = [], rng.randrange(4)
    for _ in range(rng.randrange(12)):
        size = rng.randrange(1, 5)
        out.append((key, x, x + size - 1, rng.randrange(1 << 62)))
        x += size + gap + rng.randrange(3)
    return out


@pytest.mark.parametrize("reach", [0, 1])
def test_overlaps_of_runs(spark, reach):
    rng = random.Random(reach)
    a, b = ([r for k in range(60) for r in runs_of(rng, k, reach)] for _ in "ab")
    schema = "key int, lo int, hi int, id long"
    got = I.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["key"], reach)
    assert Counter(map(tuple, got.collect())) == Counter((p[3], q[3]) for p in a for q in b if p[0] == q[0] and p[1] <= q[2] + reach and q[1] <= p[2] + reach)


def test_two_long_rows_meet_few_candidates(spark):
    """8,000 runs in each of two rows: the window hands on two candidates a run at most, where a join of the rows makes 64 million."""
    rows = spark.range(8000).select(F.lit(1).alias("image_id"), F.lit(0).alias("label"), (F.col("id") * 3).cast("int").alias("x0"), (F.col("id") * 3 + 1).cast("int").alias("x1"), F.col("id"))
    runs = rows.withColumn("y", F.lit(0)).unionByName(rows.withColumns({"y": F.lit(1), "id": F.col("id") + 10**6, "x0": F.col("x0") + 1, "x1": F.col("x1") + 1})).withColumnRenamed("id", "node")
    assert R.run_overlaps(runs, 4).count() == 8000 and R.run_overlaps(runs, 8).count() == 15999


def test_sole_pairs(spark):
    rng = random.Random(5)
    rows = []
    for side in range(2):
        own = []
        for k in range(60):
            x = rng.random()
            for _ in range(rng.randrange(8)):
                own.append((k, x, x + rng.choice([0.5, 1.0, 2.5]), rng.randrange(1 << 60)))
                x = own[-1][2] + rng.choice([-0.25, 0.0, 0.5, 2.0])
        rows.append([r for r in own])
    a, b = ([r for r in side if all(not (q[0] == r[0] and q[1] <= r[1] and q[2] > r[2]) for q in side)] for side in rows)  # starts and ends in one order
    hit = [(p[3], q[3]) for p in a for q in b if p[0] == q[0] and p[1] < q[2] and q[1] < p[2]]
    n, m = Counter(p for p, _ in hit), Counter(q for _, q in hit)
    schema = "key int, lo double, hi double, id long"
    got = I.sole_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["key"])
    assert Counter(map(tuple, got.collect())) == Counter((p, q) for p, q in hit if n[p] == m[q] == 1)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = [(d, s, rng.randrange(-3000, 3000) // 2 * 2, rng.randrange(3) * 2100, rng.choice([0, 0, 0, 0, 1, 2, 3])) for d, n in ((1, 500), (2, 1), (3, 7), (4, 64)) for s in range(n)]
    return spark.createDataFrame(rows, "design_id int, seq long, x int, y int, k int").repartition(4).cache()


def test_long_logs_equal_plain_ones(spark, log):
    """Chunks of 7 records, so that blocks, lags and runs cross many borders; some designs fill one chunk exactly or have one record."""
    same = lambda a, b: Counter(map(tuple, a.select(*b.columns).collect())) == Counter(map(tuple, b.collect()))
    assert same(W.with_move(W.with_runs(W.with_block(log, 7), 7), 7), S.with_move(S.with_runs(S.with_block(log))))
    coarse = log.withColumns({"x": F.col("x") % 4, "y": F.col("y") % 2})
    assert same(W.dedupe_stitches(coarse, 7), S.dedupe_stitches(coarse))
    assert same(W.pec_deltas(log, 7), E.pec_deltas(log))
    threads = spark.createDataFrame([(d, b, f"t-{b}") for d in (1, 2, 3, 4, 5) for b in range(3)], "design_id int, block int, thread_id string")
    r = lambda df: df.withColumns({c: F.round(c, 6) for c in ("top_m", "bobbin_m")})
    assert same(r(W.thread_usage(log, threads, 7)), r(S.thread_usage(log, threads)))


def thin(points, closed, gap, least):
    kept = [points[0]]
    for p in points[1:]:
        if math.hypot(p[0] - kept[-1][0], p[1] - kept[-1][1]) >= gap:
            kept.append(p)
    if not closed and math.hypot(points[-1][0] - kept[-1][0], points[-1][1] - kept[-1][1]) > 0.1:
        kept.append(points[-1])
    size = sum(math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(kept, kept[1:]))
    return [] if len(kept) < 2 or size < least else kept + kept[:1] * closed


def test_thinning_streams_whole_chains(spark):
    rng = random.Random(2)
    chains = {}
    for k in range(40):
        x = y = 0.0
        chains[k] = ([], k % 3 == 0)
        for _ in range(20_000 if k == 7 else rng.randrange(1, 60)):
            x, y = x + rng.uniform(-0.3, 0.32), y + rng.uniform(-0.3, 0.3)
            chains[k][0].append((x, y))
    rows = [(k, s, x, y, closed) for k, (points, closed) in chains.items() for s, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "path_id long, seq long, x double, y double, closed boolean").repartition(4)
    got = {}
    for r in P.thin_path(df).collect():
        got.setdefault(r["path_id"], []).append((r["seq"], r["x"], r["y"]))
    want = {k: [(i, *p) for i, p in enumerate(t)] for k, (points, closed) in chains.items() if (t := thin(points, closed, 0.5, 1.5))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_any_image_id_and_size(spark):
    """Ids of 64 bits, and a row beyond 16,384 cells: the same components as with small numbers, numbered in the same order."""
    shape = [(x, y, (x // 3 + y // 2) % 2) for x in range(9) for y in range(6)]
    ids = {1: -(1 << 63), 2: (1 << 63) - 1}
    small = spark.createDataFrame([(i, x, y, v) for i in ids for x, y, v in shape], "image_id long, x int, y int, label int")
    large = spark.createDataFrame([(ids[i], x, y + 40_000, v) for i in ids for x, y, v in shape], "image_id long, x int, y int, label int")
    found = []
    for df, shift in ((small, 0), (large, 40_000)):
        rows = R.connected_components(df, 8).collect()
        order = {c: k for k, c in enumerate(sorted({(r["image_id"], r["comp_id"]) for r in rows}))}
        found.append(Counter((r["image_id"] in (1, ids[1]), r["y"] - shift, r["x0"], r["x1"], order[r["image_id"], r["comp_id"]]) for r in rows))
    assert sum(found[0].values()) == sum(found[1].values()) and {k[:4] for k in found[0]} == {k[:4] for k in found[1]}
    cleaned = R.remove_small_regions(large, 7, passes=1).groupBy("image_id", "label").count().collect()
    assert sum(r["count"] for r in cleaned) == 108


def test_strokes_lie_over_what_they_touch(spark):
    """A frame (layer 0), a block in its hole (1), and a stroke (2) that touches both: its parent is the larger one, and it is above each."""
    cells = []
    for x in range(20):
        for y in range(20):
            layer = 0 if not (4 <= x < 16 and 4 <= y < 16) else 2 if x == 4 else 1
            cells.append((1, x, y, layer))
    runs = R.connected_components(spark.createDataFrame(cells, "image_id long, x int, y int, label int"), 8).cache()
    stats = G.component_stats(runs, 0.2)
    adj, satin = G.adjacency(runs), stats.where("label = 2").select("image_id", "comp_id")
    parents = G.satin_parents(stats, runs, adj, satin)
    layer = {r["comp_id"]: r["label"] for r in stats.collect()}
    assert {layer[r["comp_id"]]: layer.get(r["parent"]) for r in parents.collect()} == {0: None, 1: 0, 2: 0}
    depth = {layer[r["comp_id"]]: r["depth"] for r in G.nesting_depth(parents, adj=adj, satin=satin).collect()}
    assert depth == {0: 0, 1: 1, 2: 2}
    got = {(r["below"], r["above"]): r["weight"] for r in G.layer_weights(stats, parents, 1, adj, satin).collect()}
    assert got == {(0, 1): 132, (0, 2): 24, (1, 2): 12}


def png(path, width, height, colour):
    rows = b"".join(b"\0" + bytes(v for x in range(width) for v in colour(x, y)) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_from_an_image_file_to_stitches(spark, tmp_path):
    """A disc and a bar on clear ground: two threads; the bar is a satin column, the disc a fill; the file of the stitches reads back."""
    disc, bar = (200, 30, 30, 255), (20, 40, 160, 255)
    png(tmp_path / "a.png", 70, 40, lambda x, y: disc if (x - 20) ** 2 + (y - 20) ** 2 < 200 else bar if 50 <= x < 55 and 4 <= y < 36 else (0, 0, 0, 0))
    pixels = R.read_images(spark, str(tmp_path)).drop("path").cache()
    box = R.content_box(pixels).first()
    assert (box["x"], box["y"], box["width"], box["height"]) == (4, 2, 53, 36)
    threads = spark.createDataFrame([("red", "r", 210, 20, 20, 0, True), ("blue", "r", 10, 50, 170, 1, True), ("green", "r", 20, 200, 20, 2, True)], "thread_id string, range_id string, r int, g int, b int, ord int, matchable boolean")
    pixels = R.crop(pixels, R.content_box(pixels)).cache()
    assert pixels.count() == 53 * 36
    small = R.resample_pixels(pixels, 26, 18).select("image_id", "x", "y", *[F.round(c).cast("int").alias(c) for c in "rgba"])
    cells, _, choices = jobs.plan_colours(small, pixels, threads, "r", colours=2, rounds=5)
    stitches, named = jobs.digitize(cells, choices, satin_mm=2.0)
    rows = sorted(map(tuple, stitches.select("seq", "x", "y", "k").collect()))
    assert {r["thread_id"] for r in named.collect()} == {"red", "blue"}
    assert [r[0] for r in rows] == sorted(r[0] for r in rows) and sum(k == S.COLOR for *_, k in rows) == 1
    column = [(x, y) for _, x, y, k in rows if x > 85]
    assert len(column) > 30 and all(90 <= x <= 104 for x, _ in column) and max(y for _, y in column) - min(y for _, y in column) > 55
    colours = named.withColumn("machine_index", F.lit(5)).select("design_id", "block", "machine_index")
    files = E.write_pes(stitches, colours, named.select("design_id").distinct().withColumn("label", F.lit("disc")))
    back = E.decode_pes(files.select(F.lit("a").alias("path"), F.col("pes").alias("content"))).select(F.posexplode("stitches").alias("seq", "p")).select("seq", "p.x", "p.y", "p.k").collect()
    x0, y0 = rows[0][1:3]
    assert sorted(map(tuple, back)) == [(s, x - x0, y - y0, k) for s, x, y, k in rows]
