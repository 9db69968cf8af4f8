"""Queries over paths and fills."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.operators import fill as L
from seamline.operators import needle as N
from seamline.operators import paths as P
from seamline.operators import raster as R
from seamline.operators import regions as G
from seamline.operators import ways as W
from seamline.plans.adapters import CELL_MM, CELLS, PATH_POINTS, STITCHES, cells, packed, path_points, stitches
from seamline.plans.base import query
from seamline.plans.raster_queries import REGIONS
from seamline.session import cut

WITH = f"WITH {STITCHES}, {PATH_POINTS}"
ARC = "arc AS (SELECT path_id, seq, x, y, sum(coalesce(d, 0)) OVER (PARTITION BY path_id ORDER BY seq) AS arc FROM (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM path_points WINDOW w AS (PARTITION BY path_id ORDER BY seq)))"


@query(f"{WITH}, {ARC} SELECT path_id, seq, round(arc, 5) AS arc FROM arc")
def with_arc(spark, d):
    return P.with_arc(path_points(spark, d)).select("path_id", "seq", F.round("arc", 5).alias("arc"))


@query(f"""{WITH}, n AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM path_points), j AS (SELECT p.path_id, p.seq, p.n, p.x AS px, p.y AS py, greatest(0, least(p.n - 1, p.seq + o)) AS at FROM n p, (SELECT unnest(range(-2, 3)) AS o))
SELECT j.path_id, j.seq, round(CASE WHEN any_value(n) <= 2 OR j.seq = 0 OR j.seq = any_value(n) - 1 THEN any_value(px) ELSE avg(q.x) END, 5) + 0 AS x, round(CASE WHEN any_value(n) <= 2 OR j.seq = 0 OR j.seq = any_value(n) - 1 THEN any_value(py) ELSE avg(q.y) END, 5) + 0 AS y
FROM j JOIN path_points q ON q.path_id = j.path_id AND q.seq = j.at GROUP BY 1, 2""")
def smooth(spark, d):
    return P.smooth(path_points(spark, d), 2).select("path_id", "seq", *[(F.round(c, 5) + 0.0).alias(c) for c in "xy"])


@query(f"""{WITH}, {ARC}, total AS (SELECT path_id, max(arc) AS total FROM arc GROUP BY 1), queries AS (SELECT path_id, j, total * (j + 0.37::DOUBLE) / 4 AS s FROM total, (SELECT unnest(range(0, 4)) AS j))
SELECT h.path_id, CAST(h.j AS INTEGER) AS j, round(a.x + (b.x - a.x) * coalesce((h.s - a.arc) / nullif(b.arc - a.arc, 0), 0), 7) AS x, round(a.y + (b.y - a.y) * coalesce((h.s - a.arc) / nullif(b.arc - a.arc, 0), 0), 7) AS y
FROM (SELECT q.path_id, q.j, q.s, max(a.seq) AS sa FROM queries q JOIN arc a ON a.path_id = q.path_id AND a.arc <= q.s GROUP BY 1, 2, 3) h JOIN arc a ON a.path_id = h.path_id AND a.seq = h.sa JOIN arc b ON b.path_id = h.path_id AND b.seq = h.sa + 1""")
def interpolate_at(spark, d):
    p = path_points(spark, d)
    total = P.with_arc(p).groupBy("path_id").agg(F.max("arc").alias("total")).where("total > 0")
    q = total.select("path_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"), "total").select("path_id", "j", (F.col("total") * (F.col("j") + 0.37) / 4).alias("s"))
    return P.interpolate_at(p, q).select("path_id", "j", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


SAMPLES = f"""{ARC}, total AS (SELECT path_id, max(arc) AS total, greatest(1, CAST(round(round(max(arc), 6) / 3) AS INTEGER)) AS n FROM arc GROUP BY 1 HAVING round(max(arc), 6) > 0.05),
spots AS (SELECT path_id, i, j, greatest(0::DOUBLE, least(total, i * (total / n) + j * least(0.5::DOUBLE, total / 4))) AS s FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM total), (SELECT unnest([0, -1, 1]) AS j)),
met AS (SELECT q.path_id, q.i, q.j, q.s, a.x + (b.x - a.x) * coalesce((q.s - a.arc) / nullif(b.arc - a.arc, 0), 0) AS x, a.y + (b.y - a.y) * coalesce((q.s - a.arc) / nullif(b.arc - a.arc, 0), 0) AS y
  FROM spots q ASOF JOIN arc a ON a.path_id = q.path_id AND q.s >= a.arc ASOF JOIN arc b ON b.path_id = q.path_id AND q.s <= b.arc),
pulled AS (SELECT path_id, i, max(s) FILTER (j = 0) AS s, max(x) FILTER (j = 0) AS x, max(y) FILTER (j = 0) AS y, max(x) FILTER (j = 1) - max(x) FILTER (j = -1) AS dx, max(y) FILTER (j = 1) - max(y) FILTER (j = -1) AS dy FROM met GROUP BY 1, 2),
samples AS (SELECT path_id, CAST(i AS INTEGER) AS i, s, x, y, CASE WHEN size >= 1e-6 THEN dx / size ELSE 0 END AS tx, CASE WHEN size >= 1e-6 THEN dy / size ELSE 0 END AS ty FROM (SELECT *, sqrt(dx ** 2 + dy ** 2) AS size FROM pulled))"""
ALONG_OUTLINE = "CAST(row_number() OVER (PARTITION BY path_id ORDER BY i DESC) - 1 AS INTEGER) AS seq"


def rounded(df, *names):
    """``names`` at six decimals; a zero loses its sign."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in names})


@query(f"{WITH}, {SAMPLES} SELECT path_id, i, round(s, 6) + 0 AS s, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(tx, 6) + 0 AS tx, round(ty, 6) + 0 AS ty FROM samples")
def resample(spark, d):
    return rounded(P.resample(path_points(spark, d), 3.0), "s", "x", "y", "tx", "ty")


@query(f"{WITH}, {SAMPLES} SELECT path_id, {ALONG_OUTLINE}, round(x + ty * half, 6) + 0 AS x, round(y - tx * half, 6) + 0 AS y FROM (SELECT *, CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS half FROM samples)")
def zigzag(spark, d):
    return rounded(P.zigzag(P.resample(path_points(spark, d), 3.0), F.lit(2.0)), "x", "y")


@query(f"{WITH}, {SAMPLES} SELECT path_id, {ALONG_OUTLINE}, round(x + ty * side, 6) + 0 AS x, round(y - tx * side, 6) + 0 AS y FROM (SELECT *, CASE WHEN i % 2 = 0 THEN -0.1::DOUBLE ELSE 2.0::DOUBLE END AS side FROM samples)")
def outline_zigzag(spark, d):
    return rounded(P.outline_zigzag(P.resample(path_points(spark, d), 3.0), 2.0, True), "x", "y")


@query(f"{WITH}, {SAMPLES} SELECT path_id, i AS seq, round(x + ty * 0.95::DOUBLE, 6) + 0 AS x, round(y - tx * 0.95::DOUBLE, 6) + 0 AS y FROM samples")
def outline_centre(spark, d):
    return rounded(P.outline_centre(P.resample(path_points(spark, d), 3.0), 2.0, True), "x", "y")


@query(f"""WITH RECURSIVE {STITCHES}, {PATH_POINTS}, pt AS MATERIALIZED (SELECT * FROM path_points), nxt AS MATERIALIZED (SELECT a.path_id, a.seq, min(b.seq) AS after FROM pt a JOIN pt b ON b.path_id = a.path_id AND b.seq > a.seq AND sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) >= 12 GROUP BY 1, 2),
kept AS (SELECT path_id, 0 AS seq FROM pt WHERE seq = 0 UNION ALL SELECT n.path_id, n.after FROM kept k JOIN nxt n ON n.path_id = k.path_id AND n.seq = k.seq),
ends AS (SELECT path_id, max(seq) AS last FROM pt GROUP BY 1), far AS (SELECT path_id, max(seq) AS seq FROM kept GROUP BY 1),
tail AS (SELECT e.path_id, e.last AS seq FROM ends e JOIN far f USING (path_id) JOIN pt a ON a.path_id = e.path_id AND a.seq = e.last JOIN pt b ON b.path_id = e.path_id AND b.seq = f.seq WHERE f.seq < e.last AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) > 0.1),
chosen AS (SELECT p.* FROM (SELECT * FROM kept UNION ALL SELECT * FROM tail) k JOIN pt p USING (path_id, seq)),
sized AS (SELECT path_id, count(*) AS n, sum(d) AS size FROM (SELECT path_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM chosen WINDOW w AS (PARTITION BY path_id ORDER BY seq)) GROUP BY 1)
SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY seq) - 1 AS INTEGER) AS seq, x, y FROM chosen JOIN sized USING (path_id) WHERE n > 1 AND size >= 1.5""")
def thin_path(spark, d):
    return P.thin_path(path_points(spark, d), gap=12.0)


@query(f"""{WITH}, legs AS (SELECT path_id * 1000 + seq AS leg, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x AS x1, y AS y1 FROM path_points WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
n AS (SELECT *, CAST(ceil(size / 3) AS INTEGER) AS n FROM (SELECT *, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS size FROM legs) WHERE size >= 0.05)
SELECT leg, CAST(i AS INTEGER) AS i, round(x0 + (x1 - x0) * (CAST(i AS DOUBLE) / n), 5) AS x, round(y0 + (y1 - y0) * (CAST(i AS DOUBLE) / n), 5) AS y FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n)""")
def subdivide(spark, d):
    w = Window.partitionBy("path_id").orderBy("seq")
    legs = path_points(spark, d).select((F.col("path_id") * 1000 + F.col("seq")).alias("leg"), F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return P.subdivide(legs, 3.0).withColumns({c: F.round(c, 5) for c in "xy"})


@query(f"""{WITH}, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS px, lag(y) OVER w AS py FROM path_points WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
d AS (SELECT *, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS ahead, sqrt((px - x) ** 2 + (py - y) ** 2) AS behind FROM n)
SELECT path_id, count(*) + 2 * count(*) FILTER (px IS NULL AND ahead > 0.01) + 2 * count(*) FILTER (nx IS NULL AND behind > 0.01) AS points FROM d GROUP BY 1""")
def add_ties(spark, d):
    return P.add_ties(path_points(spark, d)).groupBy("path_id").agg(F.count("*").alias("points"))


@query(f"""WITH {STITCHES}, p AS (SELECT design_id, seq, 't-' || ((seq // 7) % 3) AS thread_id, x / 10.0::DOUBLE AS x0, y / 10.0::DOUBLE AS y0, (x + 3) / 10.0::DOUBLE AS x1, y / 10.0::DOUBLE AS y1 FROM stitches),
d AS (SELECT *, round(sqrt((x0 - lag(x1) OVER w) ** 2 + (y0 - lag(y1) OVER w) ** 2), 6) AS d, lag(thread_id) OVER w AS old FROM p WINDOW w AS (PARTITION BY design_id ORDER BY seq))
SELECT design_id, seq, CASE WHEN d IS NULL THEN 'start' WHEN old <> thread_id THEN 'color' WHEN d < 0.05 THEN 'none' WHEN d <= 12 THEN 'run' ELSE 'trim' END AS kind FROM d""")
def travel_kind(spark, d):
    s = stitches(spark, d)
    p = s.select("design_id", "seq", F.concat(F.lit("t-"), F.floor(F.col("seq") / 7) % 3).alias("thread_id"), (F.col("x") / 10).alias("x0"), (F.col("y") / 10).alias("y0"), ((F.col("x") + 3) / 10).alias("x1"), (F.col("y") / 10).alias("y1"))
    return P.travel_kind(p, 12.0).select("design_id", "seq", "kind")


@query(f"""WITH {STITCHES}, p AS (SELECT design_id, seq, 't-' || ((seq // 7) % 3) AS thread_id, x / 10.0::DOUBLE AS x0, y / 10.0::DOUBLE AS y0, (x + 3) / 10.0::DOUBLE AS x1, y / 10.0::DOUBLE + 0.037::DOUBLE AS y1 FROM stitches),
d AS (SELECT *, sqrt((x0 - px) ** 2 + (y0 - py) ** 2) AS d FROM (SELECT *, lag(x1) OVER w AS px, lag(y1) OVER w AS py, lag(thread_id) OVER w AS old FROM p WINDOW w AS (PARTITION BY design_id ORDER BY seq))),
kinds AS (SELECT *, CASE WHEN d IS NULL THEN [0] WHEN old <> thread_id THEN [3, 0] WHEN d < 0.05 THEN [] WHEN d <= 12 THEN NULL ELSE [2, 0] END AS ks, CAST(ceil(d / 3) AS INTEGER) AS n FROM d)
SELECT design_id, seq, CAST(i - 1 AS INTEGER) AS i, CAST(round(x0 * 10) AS INTEGER) AS x, CAST(round(y0 * 10) AS INTEGER) AS y, CAST(ks[i] AS INTEGER) AS k FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM kinds WHERE ks IS NOT NULL)
UNION ALL SELECT design_id, seq, CAST(i - 1 AS INTEGER), CAST(round(round(10 * (px + (x0 - px) * (CAST(i AS DOUBLE) / n)), 6)) AS INTEGER), CAST(round(round(10 * (py + (y0 - py) * (CAST(i AS DOUBLE) / n)), 6)) AS INTEGER), 0 FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM kinds WHERE ks IS NULL)""")
def travel_records(spark, d):
    s = stitches(spark, d)
    p = s.select("design_id", "seq", F.concat(F.lit("t-"), F.floor(F.col("seq") / 7) % 3).alias("thread_id"), (F.col("x") / 10).alias("x0"), (F.col("y") / 10).alias("y0"), ((F.col("x") + 3) / 10).alias("x1"), (F.col("y") / 10 + 0.037).alias("y1"))
    return P.travel_records(P.travel_kind(p, 12.0))


CHAINS = f"""WITH RECURSIVE {STITCHES}, e AS (SELECT design_id * 100000 + seq AS edge, CASE WHEN seq % 9 = 8 AND design_id % 2 = 0 THEN design_id * 100000 + seq - 8 WHEN seq % 9 = 8 OR seq = top THEN NULL ELSE design_id * 100000 + seq + 1 END AS next FROM (SELECT *, max(seq) OVER (PARTITION BY design_id) AS top FROM stitches))"""


@query(f"""{CHAINS} SELECT edge, edge % 100000 % 9 AS seq, (edge // 100000) % 2 = 0 AND (edge % 100000) // 9 * 9 + 8 <= top AS closed FROM e JOIN (SELECT design_id, max(seq) AS top FROM stitches GROUP BY 1) t ON t.design_id = edge // 100000""")
def rank_chains(spark, d):
    s = stitches(spark, d).withColumn("top", F.max("seq").over(Window.partitionBy("design_id")))
    edge = packed("design_id", "seq")
    last = F.col("seq") % 9 == 8
    e = s.select(edge.alias("edge"), F.when(last & (F.col("design_id") % 2 == 0), edge - 8).when(last | (F.col("seq") == F.col("top")), None).otherwise(edge + 1).alias("next"))
    return P.rank_chains(e).select("edge", F.col("seq").cast("long").alias("seq"), "closed")


def some_regions(spark, d):
    c = cells(spark, d)
    runs = cut(R.connected_components(c, 4))
    return runs, cut(G.component_stats(runs, CELL_MM).where("n_cells >= 12"))


BASE = f"WITH RECURSIVE {CELLS}, {REGIONS}"
SPOTS = "points AS (SELECT image_id, comp_id, x, y, (x + y % 3 - 1) * 0.2::DOUBLE + 0.07 AS px, (y + x % 3 - 1) * 0.2::DOUBLE + 0.09 AS py FROM regions)"


@query(f"{BASE}, {SPOTS} SELECT p.image_id, p.comp_id, p.x, p.y, r.image_id IS NOT NULL AS inside FROM points p LEFT JOIN regions r ON r.image_id = p.image_id AND r.comp_id = p.comp_id AND r.x = CAST(floor(px / 0.2::DOUBLE) AS INTEGER) AND r.y = CAST(floor(py / 0.2::DOUBLE) AS INTEGER)")
def points_in_mask(spark, d):
    c = cells(spark, d)
    runs = cut(R.connected_components(c, 4))
    p = R.with_component(c, runs).select("image_id", "comp_id", F.col("x").alias("cx"), F.col("y").alias("cy"), ((F.col("x") + F.col("y") % 3 - 1) * 0.2 + 0.07).alias("x"), ((F.col("y") + F.col("x") % 3 - 1) * 0.2 + 0.09).alias("y"))
    return L.points_in_mask(p, runs, CELL_MM).select("image_id", "comp_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "inside")


@query(f"{BASE}, far AS (SELECT image_id, comp_id, x AS cx, y AS cy, row_number() OVER (ORDER BY image_id, y, x) AS point FROM regions), near AS (SELECT f.point, r.x AS nx, r.y AS ny, row_number() OVER (PARTITION BY f.point ORDER BY (r.x - f.cx - 2) ** 2 + (r.y - f.cy - 1) ** 2, r.y, r.x) AS k FROM far f JOIN regions r ON r.image_id = f.image_id AND r.comp_id = f.comp_id AND abs(r.x - f.cx - 2) <= 4 AND abs(r.y - f.cy - 1) <= 4) SELECT f.image_id, f.comp_id, f.cx, f.cy, n.nx, n.ny FROM far f LEFT JOIN near n ON n.point = f.point AND n.k = 1")
def snap_to_mask(spark, d):
    c = cells(spark, d)
    own = cut(R.with_component(c, R.connected_components(c, 4)).select("image_id", "comp_id", "x", "y"))
    p = own.select(R.run_node(x0="x").alias("point"), "image_id", "comp_id", (F.col("x") + 2).alias("cx"), (F.col("y") + 1).alias("cy"))
    return L.snap_to_mask(p, own).select("image_id", "comp_id", (F.col("cx") - 2).alias("cx"), (F.col("cy") - 1).alias("cy"), "nx", "ny")


AREAS = "areas AS (SELECT image_id, comp_id, count(*) AS n_cells, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM regions GROUP BY 1, 2 HAVING count(*) >= 12)"


@query(f"""{BASE}, {AREAS}, ends AS (SELECT image_id, comp_id, (comp_id % 16384 + 0.5::DOUBLE) * 0.2 AS ax, (comp_id // 16384 % 16384 + 0.5::DOUBLE) * 0.2 AS ay, (x1 + 0.5::DOUBLE) * 0.2 AS bx, (y1 + 0.5::DOUBLE) * 0.2 AS by_ FROM areas),
counted AS (SELECT *, greatest(1, CAST(trunc(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) / 0.1::DOUBLE) AS INTEGER)) AS n FROM ends), steps AS (SELECT *, unnest(range(0, n + 1)) AS i FROM counted),
spots AS (SELECT image_id, comp_id, CAST(floor((ax + (bx - ax) * (i / n::DOUBLE)) / 0.2::DOUBLE) AS INTEGER) AS x, CAST(floor((ay + (by_ - ay) * (i / n::DOUBLE)) / 0.2::DOUBLE) AS INTEGER) AS y FROM steps)
SELECT s.comp_id AS seg, s.image_id, s.comp_id, bool_and(r.image_id IS NOT NULL) AS inside FROM spots s LEFT JOIN regions r USING (image_id, comp_id, x, y) GROUP BY 1, 2, 3""")
def segments_in_mask(spark, d):
    runs, stats = some_regions(spark, d)
    s = stats.select(F.col("comp_id").alias("seg"), "image_id", "comp_id", F.col("anchor_x").alias("x0"), F.col("anchor_y").alias("y0"), ((F.col("x1") + 0.5) * CELL_MM).alias("x1"), ((F.col("y1") + 0.5) * CELL_MM).alias("y1"))
    return L.segments_in_mask(s, runs, CELL_MM).select("seg", "image_id", "comp_id", "inside")


@query()
def ways_in_mask(spark, d):
    """Ways from the first cell of every area to its last one, both in scan order."""
    runs, stats = some_regions(spark, d)
    last = runs.groupBy("image_id", "comp_id").agg(F.max(F.struct("y", "x1")).alias("end"))
    m = stats.join(last, ["image_id", "comp_id"]).select("image_id", "comp_id", F.col("anchor_x").alias("x0"), F.col("anchor_y").alias("y0"), *[((F.col(c) + 0.5) * CELL_MM).alias(n) for c, n in (("end.x1", "x1"), ("end.y", "y1"))])
    way = W.ways_in_mask(cut(m), runs, CELL_MM, ["image_id", "comp_id"])
    return way.select("image_id", "comp_id", F.posexplode("way").alias("i", "p")).select("image_id", "comp_id", "i", *[F.round(f"p.{c}", 4).alias(c) for c in "xy"])


@query(f"{BASE}, s AS (SELECT image_id, comp_id, count(*) * 0.04::DOUBLE AS area FROM regions GROUP BY 1, 2) SELECT image_id, comp_id, unnest(CASE WHEN area > 12 THEN [0, 1] ELSE [1] END) AS phase FROM s")
def fill_plan(spark, d):
    """Of every area, however small."""
    stats = G.component_stats(R.connected_components(cells(spark, d), 4), CELL_MM)
    return L.fill_plan(stats, 0.4, 0.0, 0.2).select("image_id", "comp_id", "phase")


def runs_of_fill(spark, d):
    runs, stats = some_regions(spark, d)
    samples = L.scan_samples(L.fill_plan(stats, 0.4, 30.0, 0.1), CELL_MM)
    return cut(L.fill_runs(L.points_in_mask(samples, runs, CELL_MM), CELL_MM))


#: Passes, scan rows and samples of a fill.
FILL = f"""{AREAS}, passes AS (SELECT a.*, p.* FROM areas a, (VALUES (0, radians(120.0::DOUBLE), 2.0::DOUBLE, -0.4::DOUBLE, 1.0::DOUBLE, 3.0::DOUBLE), (1, radians(30.0::DOUBLE), 0.4::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 2.5::DOUBLE)) p(phase, turn, spacing, extend, least, stitch) WHERE phase = 1 OR n_cells * 0.04::DOUBLE > 12),
corners AS (SELECT image_id, comp_id, phase, (x * cos(turn) + y * sin(turn)) * 0.2 AS u, (y * cos(turn) - x * sin(turn)) * 0.2 AS v FROM (SELECT *, unnest([x0, x0, x1 + 1, x1 + 1]) AS x, unnest([y0, y1 + 1, y0, y1 + 1]) AS y FROM passes)),
boxes AS (SELECT image_id, comp_id, phase, min(u) AS ua, max(u) AS ub, min(v) AS va, max(v) AS vb FROM corners GROUP BY 1, 2, 3),
sized AS (SELECT *, CAST(trunc((vb - (va + spacing / 2)) / spacing) AS INTEGER) + 1 AS n, CAST(trunc((ub - ua) / 0.1::DOUBLE) AS INTEGER) + 2 AS m FROM passes JOIN boxes USING (image_id, comp_id, phase)),
scans AS (SELECT *, unnest(range(0, n)) AS row FROM sized WHERE n > 0), dots AS (SELECT *, unnest(range(0, m)) AS k FROM scans),
samples AS (SELECT image_id, comp_id, phase, row, k, ua + k * 0.1::DOUBLE AS u, va + spacing / 2 + row * spacing AS v, turn, extend, least, stitch FROM dots)"""
INNER = """lit AS (SELECT s.* FROM samples s JOIN regions r ON r.image_id = s.image_id AND r.comp_id = s.comp_id AND r.x = CAST(floor((u * cos(turn) - v * sin(turn)) / 0.2::DOUBLE) AS INTEGER) AND r.y = CAST(floor((u * sin(turn) + v * cos(turn)) / 0.2::DOUBLE) AS INTEGER)),
pieces AS (SELECT image_id, comp_id, phase, row, min(u) - 0.05::DOUBLE - any_value(extend) AS u0, max(u) + 0.05::DOUBLE + any_value(extend) AS u1, any_value(v) AS v, any_value(least) AS least, any_value(stitch) AS stitch
  FROM (SELECT *, k - row_number() OVER (PARTITION BY image_id, comp_id, phase, row ORDER BY k) AS g FROM lit) GROUP BY image_id, comp_id, phase, row, g)"""


@query(f"{BASE}, {FILL} SELECT image_id, comp_id, phase, CAST(row AS INTEGER) AS row, count(*) AS samples, round(min(u), 5) AS u0, round(max(u), 5) AS u1, round(any_value(v), 5) AS v, round(sum(u * cos(turn) - v * sin(turn)), 4) AS x, round(sum(u * sin(turn) + v * cos(turn)), 4) AS y FROM samples GROUP BY 1, 2, 3, 4")
def scan_samples(spark, d):
    s = L.scan_samples(L.fill_plan(some_regions(spark, d)[1], 0.4, 30.0, 0.1), CELL_MM)
    made = [F.count("*").alias("samples"), *[F.round(f, 5).alias(n) for n, f in (("u0", F.min("u")), ("u1", F.max("u")), ("v", F.first("v")))], *[F.round(F.sum(c), 4).alias(c) for c in "xy"]]
    return s.groupBy("image_id", "comp_id", "phase", "row").agg(*made)


@query(f"{BASE}, {FILL}, {INNER} SELECT image_id, comp_id, phase, CAST(row AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY image_id, comp_id, phase, row ORDER BY u0) - 1 AS INTEGER) AS run, round(u0, 5) AS u0, round(u1, 5) AS u1, round(v, 5) AS v, stitch FROM pieces WHERE u1 - u0 >= least")
def fill_runs(spark, d):
    return runs_of_fill(spark, d).select("image_id", "comp_id", "phase", "row", "run", *[F.round(c, 5).alias(c) for c in ("u0", "u1", "v")], "stitch")


SEWN = f"{INNER}, sewn AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY image_id, comp_id, phase, row ORDER BY u0) - 1 AS INTEGER) AS run FROM pieces WHERE u1 - u0 >= least)"


@query(f"""{BASE}, {FILL}, {SEWN}, hit AS (SELECT a.image_id, a.comp_id, a.phase, a.row, a.run, b.run AS up, count(*) OVER (PARTITION BY a.image_id, a.comp_id, a.phase, a.row, a.run) AS n, count(*) OVER (PARTITION BY b.image_id, b.comp_id, b.phase, b.row, b.run) AS m
  FROM sewn a JOIN sewn b ON a.image_id = b.image_id AND a.comp_id = b.comp_id AND a.phase = b.phase AND a.row = b.row + 1 WHERE a.u0 < b.u1 AND b.u0 < a.u1),
sole AS MATERIALIZED (SELECT * FROM hit WHERE n = 1 AND m = 1),
starts AS (SELECT image_id, comp_id, phase, row, run, row_number() OVER (PARTITION BY image_id, comp_id, phase ORDER BY row, run) - 1 AS cell FROM sewn ANTI JOIN sole USING (image_id, comp_id, phase, row, run)),
chained AS (SELECT * FROM starts UNION ALL SELECT c.image_id, c.comp_id, c.phase, s.row, s.run, c.cell FROM chained c JOIN sole s ON s.image_id = c.image_id AND s.comp_id = c.comp_id AND s.phase = c.phase AND s.row = c.row + 1 AND s.up = c.run)
SELECT image_id, comp_id, phase, CAST(row AS INTEGER) AS row, run, cell FROM chained""")
def fill_cells(spark, d):
    return L.fill_cells(runs_of_fill(spark, d)).select("image_id", "comp_id", "phase", "row", "run", "cell")


@query(f"""{BASE}, {FILL}, {SEWN}, grid AS (SELECT *, (row % 3) / 3.0::DOUBLE * stitch AS off FROM sewn),
us AS (SELECT *, list_concat([u0], list_filter(list_transform(range(CAST(ceil((u0 - off) / stitch) AS BIGINT), CAST(floor((u1 - off) / stitch) AS BIGINT) + 1), lambda k: off + k * stitch), lambda u: u > u0 + stitch * 0.3::DOUBLE AND u < u1 - stitch * 0.3::DOUBLE), [u1]) AS u FROM grid),
turned AS (SELECT *, CASE WHEN row % 2 = 1 THEN list_reverse(u) ELSE u END AS w FROM us)
SELECT image_id, comp_id, phase, CAST(row AS INTEGER) AS row, run, CAST(i - 1 AS INTEGER) AS i, round(w[i], 5) + 0 AS u FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM turned)""")
def row_stitches(spark, d):
    return L.row_stitches(runs_of_fill(spark, d)).withColumn("u", F.round("u", 5) + 0.0)


@query(f"""WITH RECURSIVE {STITCHES}, items AS (SELECT design_id, seq // 40 AS "group", seq AS item, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM stitches),
g AS (SELECT design_id, "group", list({{'item': item, 'x': x, 'y': y}}) AS rest FROM items GROUP BY ALL),
walk AS (SELECT design_id, "group", rest, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, CAST(NULL AS BIGINT) AS item, -1 AS place FROM g UNION ALL
  SELECT design_id, "group", list_filter(rest, lambda r: r.item <> b.item), b.x, b.y, b.item, place + 1
  FROM (SELECT *, list_min(list_transform(rest, lambda r: {{'d': (r.x - x) * (r.x - x) + (r.y - y) * (r.y - y), 'item': r.item, 'x': r.x, 'y': r.y}})) AS b FROM walk WHERE len(rest) > 0))
SELECT design_id, CAST("group" AS BIGINT) AS "group", item, CAST(place AS INTEGER) AS place FROM walk WHERE place >= 0""")
def nearest_first(spark, d):
    s = stitches(spark, d)
    items = s.select("design_id", F.floor(F.col("seq") / 40).alias("group"), F.col("seq").alias("item"), *[F.col(c).cast("double").alias(f"{c}{i}") for i in (0, 1) for c in "xy"])
    return N.nearest_first(items)


@query()
def needle_order(spark, d):
    """Groups of items of several pieces, each to be entered at either of two stitches."""
    s = stitches(spark, d)
    at = lambda n: F.floor(F.col("seq") / n)
    w = Window.partitionBy("design_id", at(16)).orderBy("seq")
    ends = {f"{c}{i}": F.col(c).cast("double") for i in (0, 1) for c in "xy"}
    keys = {"group": at(480), "item": at(16), "phase": at(8) % 2, "piece": at(2), "way": F.col("seq") % 2, "ax": F.first("x").over(w), "ay": F.first("y").over(w)}
    return N.needle_order(s.withColumns(keys | ends))


@query()
def boundary_chains(spark, d):
    """Borders of the areas as loops."""
    c = cells(spark, d)
    return P.boundary_chains(R.with_component(c, cut(R.connected_components(c, 4))), CELL_MM)


@query()
def shared_boundary_chains(spark, d):
    """Borders of the areas, those between two areas once."""
    c = cells(spark, d)
    return P.boundary_chains(R.with_component(c, cut(R.connected_components(c, 4))), CELL_MM, dedupe=True)
