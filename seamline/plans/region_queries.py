"""Queries over regions: statistics, neighbours, nesting, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import centerlines as C
from seamline.operators import raster as R
from seamline.operators import regions as G
from seamline.plans.adapters import CELL_MM, CELLS, cells
from seamline.plans.base import query
from seamline.plans.raster_queries import REGIONS, components_sql
from seamline.session import cut, kept

BASE = f"WITH RECURSIVE {CELLS}, {REGIONS}"
STATS = "stats AS (SELECT image_id, comp_id, label, count(*) AS n_cells, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM regions GROUP BY ALL)"
ADJ = "adj AS (SELECT DISTINCT p.image_id, least(p.comp_id, q.comp_id) AS a, greatest(p.comp_id, q.comp_id) AS b FROM regions p JOIN regions q ON p.image_id = q.image_id AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) WHERE p.comp_id <> q.comp_id)"


def four(spark, d):
    return R.connected_components(cells(spark, d), 4)


def stats4(spark, d):
    return G.component_stats(four(spark, d), CELL_MM)


@query(f"{BASE}, {STATS} SELECT image_id, comp_id, label, n_cells, x0, y0, x1, y1, round((comp_id % 16384 + 0.5::DOUBLE) * 0.2, 6) AS anchor_x, round((comp_id // 16384 % 16384 + 0.5::DOUBLE) * 0.2, 6) AS anchor_y, round(n_cells * 0.04::DOUBLE, 6) AS area_mm2 FROM stats")
def component_stats(spark, d):
    return stats4(spark, d).withColumns({c: F.round(c, 6) for c in ("anchor_x", "anchor_y", "area_mm2")})


@query(f"{BASE}, {STATS} SELECT image_id, comp_id, n_cells FROM stats WHERE n_cells >= 12")
def drop_specks(spark, d):
    return G.drop_specks(stats4(spark, d), CELL_MM).select("image_id", "comp_id", "n_cells")


@query(f"{BASE}, {STATS} SELECT image_id, comp_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label, comp_id) - 1 AS INTEGER) AS number FROM stats")
def number_components(spark, d):
    return G.number_components(stats4(spark, d)).select("image_id", "comp_id", "number")


@query(f"{BASE}, {ADJ} SELECT * FROM adj")
def adjacency(spark, d):
    return G.adjacency(four(spark, d))


def ring_cells(spark, d):
    """Nested square rings with specks, anew every 23 rows, in the place of each image's labels: shapes that enclose each other."""
    far = F.greatest(F.abs(F.col("x") - 11), F.abs(F.col("y") % 23 - 11))
    label = F.when(far % 4 == 1, 1).when((F.col("x") % 7 == 3) & (F.col("y") % 5 == 2), 2).otherwise(0)
    return cells(spark, d).withColumn("label", label)


def ring_tables(spark, d):
    runs = R.connected_components(ring_cells(spark, d), 4)
    return runs, kept(G.component_stats(runs, CELL_MM))


RINGS = f"""WITH RECURSIVE {CELLS}, ring AS (SELECT image_id, x, y, CASE WHEN greatest(abs(x - 11), abs(y % 23 - 11)) % 4 = 1 THEN 1 WHEN x % 7 = 3 AND y % 5 = 2 THEN 2 ELSE 0 END AS label FROM cells),
{components_sql("ring", 4, "comps")}, box AS (SELECT image_id, comp_id, label, sum(x1 - x0 + 1) AS n_cells, min(x0) AS bx0, max(x1) AS bx1, min(y) AS by0, max(y) AS by1 FROM comps GROUP BY 1, 2, 3),
wide AS (SELECT * FROM box WHERE bx1 - bx0 >= 2 AND by1 - by0 >= 2),
spans AS (SELECT image_id, comp_id, y, coalesce(lag(x1) OVER (PARTITION BY image_id, comp_id, y ORDER BY x0) + 1, bx0 - 1) AS g0, x0 - 1 AS g1 FROM comps JOIN wide USING (image_id, comp_id)
  UNION ALL SELECT image_id, comp_id, y, max(x1) + 1, any_value(bx1) + 1 FROM comps JOIN wide USING (image_id, comp_id) GROUP BY 1, 2, 3
  UNION ALL SELECT image_id, comp_id, unnest([by0 - 1, by1 + 1]), bx0 - 1, bx1 + 1 FROM wide),
gaps AS MATERIALIZED (SELECT s.*, g0 < bx0 OR g1 > bx1 OR y < by0 OR y > by1 AS edge FROM spans s JOIN wide USING (image_id, comp_id) WHERE g0 <= g1),
outer_ AS (SELECT image_id, comp_id, y, g0, g1 FROM gaps WHERE edge UNION SELECT g.image_id, g.comp_id, g.y, g.g0, g.g1 FROM outer_ o JOIN gaps g ON g.image_id = o.image_id AND g.comp_id = o.comp_id AND abs(g.y - o.y) = 1 AND g.g0 <= o.g1 AND o.g0 <= g.g1),
holes AS (SELECT image_id, comp_id, y, g0, g1 FROM gaps EXCEPT SELECT * FROM outer_),
lies AS (SELECT b.image_id, b.comp_id, h.comp_id AS parent, p.n_cells FROM box b JOIN holes h ON h.image_id = b.image_id AND h.y = b.comp_id // 16384 % 16384 AND b.comp_id % 16384 BETWEEN h.g0 AND h.g1 AND h.comp_id <> b.comp_id JOIN box p ON p.image_id = h.image_id AND p.comp_id = h.comp_id),
parents AS (SELECT b.image_id, b.comp_id, l.parent FROM box b LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, comp_id ORDER BY n_cells, parent DESC) AS k FROM lies) WHERE k = 1) l USING (image_id, comp_id))"""


@query(f"{RINGS} SELECT image_id, comp_id, parent FROM parents")
def enclosing(spark, d):
    runs, stats = ring_tables(spark, d)
    return G.enclosing(stats, runs)


@query(f"{RINGS}, above AS (SELECT image_id, comp_id, parent AS up, 1 AS depth FROM parents WHERE parent IS NOT NULL UNION ALL SELECT a.image_id, a.comp_id, p.parent, a.depth + 1 FROM above a JOIN parents p ON p.image_id = a.image_id AND p.comp_id = a.up WHERE p.parent IS NOT NULL) SELECT p.image_id, p.comp_id, p.parent, CAST(coalesce(max(a.depth), 0) AS INTEGER) AS depth FROM parents p LEFT JOIN above a USING (image_id, comp_id) GROUP BY 1, 2, 3")
def nesting_depth(spark, d):
    runs, stats = ring_tables(spark, d)
    return G.nesting_depth(kept(G.enclosing(stats, runs))).select("image_id", "comp_id", "parent", F.col("depth").cast("int").alias("depth"))


@query(f"{RINGS} SELECT b.image_id, u.label AS below, b.label AS above, CAST(sum(b.n_cells) AS BIGINT) AS weight FROM box b JOIN parents p USING (image_id, comp_id) JOIN box u ON u.image_id = p.image_id AND u.comp_id = p.parent WHERE u.label <> b.label GROUP BY 1, 2, 3")
def layer_weights(spark, d):
    runs, stats = ring_tables(spark, d)
    return G.layer_weights(stats, G.enclosing(stats, runs), 1)


def _greedy_sql(steps: int) -> str:
    """CTEs that end in ranked (image_id, label, rank): in each step the layer left that breaks the least weight."""
    out = """weights AS (SELECT b.image_id, u.label AS below, b.label AS above, sum(b.n_cells) AS weight FROM box b JOIN parents p USING (image_id, comp_id) JOIN box u ON u.image_id = p.image_id AND u.comp_id = p.parent WHERE u.label <> b.label GROUP BY 1, 2, 3),
layers AS (SELECT image_id, label, sum(n_cells) AS area FROM box GROUP BY 1, 2), done0 AS (SELECT image_id, label, 0 AS rank FROM layers WHERE false)"""
    for k in range(steps):
        out += f""", left{k} AS (SELECT l.* FROM layers l ANTI JOIN done{k} d ON d.image_id = l.image_id AND d.label = l.label),
cost{k} AS (SELECT l.image_id, l.label, l.area, coalesce(sum(CASE WHEN b.label IS NOT NULL THEN w.weight END), 0) AS cost FROM left{k} l LEFT JOIN weights w ON w.image_id = l.image_id AND w.above = l.label LEFT JOIN left{k} b ON b.image_id = w.image_id AND b.label = w.below GROUP BY 1, 2, 3),
done{k + 1} AS (SELECT * FROM done{k} UNION ALL SELECT image_id, label, {k} FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cost, area DESC, label) AS n FROM cost{k}) WHERE n = 1)"""
    return f"{out}, ranked AS (SELECT * FROM done{steps})"


GREEDY = f"{RINGS}, {_greedy_sql(3)}"


@query(f"{GREEDY} SELECT * FROM ranked")
def layer_order(spark, d):
    runs, stats = ring_tables(spark, d)
    weights = G.layer_weights(stats, G.enclosing(stats, runs), 1)
    return G.layer_order(stats, weights)


@query(f"""{GREEDY}, above AS (SELECT image_id, comp_id, parent AS up, 1 AS depth FROM parents WHERE parent IS NOT NULL UNION ALL SELECT a.image_id, a.comp_id, p.parent, a.depth + 1 FROM above a JOIN parents p ON p.image_id = a.image_id AND p.comp_id = a.up WHERE p.parent IS NOT NULL),
deep AS (SELECT p.image_id, p.comp_id, CAST(coalesce(max(a.depth), 0) AS INTEGER) AS depth FROM parents p LEFT JOIN above a USING (image_id, comp_id) GROUP BY 1, 2),
placed AS (SELECT b.image_id, b.comp_id, b.label, d.depth, r.rank, row_number() OVER (PARTITION BY b.image_id ORDER BY d.depth, r.rank, b.comp_id) - 1 AS place FROM box b JOIN deep d USING (image_id, comp_id) JOIN ranked r ON r.image_id = b.image_id AND r.label = b.label)
SELECT image_id, comp_id, label, depth, rank, CAST(place AS INTEGER) AS place, CAST(sum(CASE WHEN old <> label THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY place) AS INTEGER) AS "group" FROM (SELECT *, lag(label) OVER (PARTITION BY image_id ORDER BY place) AS old FROM placed)""")
def layered_order(spark, d):
    runs, stats = ring_tables(spark, d)
    parents = kept(G.enclosing(stats, runs))
    ranks = G.layer_order(stats, G.layer_weights(stats, parents, 1))
    return G.sewing_groups(G.layered_order(stats, G.nesting_depth(parents), ranks))


@query(f"{BASE}, {STATS}, ordered AS (SELECT image_id, comp_id, label, row_number() OVER (PARTITION BY image_id ORDER BY comp_id) - 1 AS place FROM stats) SELECT image_id, comp_id, CAST(sum(CASE WHEN old <> label THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY place) AS INTEGER) AS \"group\" FROM (SELECT *, lag(label) OVER (PARTITION BY image_id ORDER BY place) AS old FROM ordered)")
def sewing_groups(spark, d):
    from pyspark.sql import Window

    s = stats4(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("comp_id")) - 1)
    return G.sewing_groups(s).select("image_id", "comp_id", "group")


@query(f"{BASE}, {STATS}, {ADJ}, two AS (SELECT image_id, a, b FROM adj UNION ALL SELECT image_id, b, a FROM adj), satin AS (SELECT image_id, comp_id FROM stats WHERE n_cells < 6) SELECT t.image_id, t.a AS comp_id, arg_min(t.b, -s.n_cells * 1000000000000 + t.b % 268435456) AS parent FROM two t JOIN satin x ON x.image_id = t.image_id AND x.comp_id = t.a JOIN stats s ON s.image_id = t.image_id AND s.comp_id = t.b WHERE s.n_cells >= 6 GROUP BY 1, 2")
def satin_parent(spark, d):
    runs = four(spark, d)
    stats = G.component_stats(runs, CELL_MM)
    return G.satin_parent(stats, G.adjacency(runs), stats.where("n_cells < 6").select("image_id", "comp_id"))


#: The specks of the rings as satin strokes: they enclose nothing, and the largest other area that they touch is their parent.
SATIN = RINGS.replace("JOIN box p ON p.image_id = h.image_id AND p.comp_id = h.comp_id)", "JOIN box p ON p.image_id = h.image_id AND p.comp_id = h.comp_id AND p.label <> 2)") + """,
touch AS (SELECT DISTINCT p.image_id, p.comp_id, q.comp_id AS b FROM comps p JOIN comps q ON p.image_id = q.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND ((q.y = p.y AND (q.x0 = p.x1 + 1 OR p.x0 = q.x1 + 1)) OR (q.y <> p.y AND p.x0 <= q.x1 AND q.x0 <= p.x1)) WHERE p.label = 2 AND q.label <> 2),
largest AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.image_id, t.comp_id ORDER BY x.n_cells DESC, t.b) AS o FROM touch t JOIN box x ON x.image_id = t.image_id AND x.comp_id = t.b) WHERE o = 1),
lifted AS (SELECT p.image_id, p.comp_id, coalesce(l.b, p.parent) AS parent FROM parents p LEFT JOIN largest l USING (image_id, comp_id))"""


def satin_tables(spark, d):
    runs, stats = ring_tables(spark, d)
    adj, satin = kept(G.adjacency(runs)), stats.where("label = 2").select("image_id", "comp_id")
    return stats, kept(G.satin_parents(stats, runs, adj, satin)), adj, satin


@query(f"""{SATIN}, above AS (SELECT image_id, comp_id, parent AS up, 1 AS depth FROM lifted WHERE parent IS NOT NULL UNION ALL SELECT a.image_id, a.comp_id, p.parent, a.depth + 1 FROM above a JOIN lifted p ON p.image_id = a.image_id AND p.comp_id = a.up WHERE p.parent IS NOT NULL),
deep AS (SELECT p.image_id, p.comp_id, p.parent, coalesce(max(a.depth), 0) AS depth FROM lifted p LEFT JOIN above a USING (image_id, comp_id) GROUP BY 1, 2, 3),
least AS (SELECT t.image_id, t.comp_id, max(e.depth) + 1 AS least FROM touch t JOIN deep e ON e.image_id = t.image_id AND e.comp_id = t.b JOIN lifted l ON l.image_id = t.image_id AND l.comp_id = t.comp_id WHERE l.parent IS DISTINCT FROM t.b GROUP BY 1, 2)
SELECT d.image_id, d.comp_id, d.parent, CAST(greatest(d.depth, coalesce(l.least, 0)) AS INTEGER) AS depth FROM deep d LEFT JOIN least l USING (image_id, comp_id)""")
def satin_nesting_depth(spark, d):
    stats, parents, adj, satin = satin_tables(spark, d)
    return G.nesting_depth(parents, adj=adj, satin=satin).select("image_id", "comp_id", "parent", F.col("depth").cast("int").alias("depth"))


@query(f"""{SATIN}, over_ AS (SELECT image_id, comp_id, parent FROM lifted WHERE parent IS NOT NULL UNION ALL SELECT image_id, comp_id, b FROM touch)
SELECT b.image_id, u.label AS below, b.label AS above, CAST(sum(b.n_cells) AS BIGINT) AS weight FROM box b JOIN over_ p USING (image_id, comp_id) JOIN box u ON u.image_id = p.image_id AND u.comp_id = p.parent WHERE u.label <> b.label GROUP BY 1, 2, 3""")
def satin_layer_weights(spark, d):
    stats, parents, adj, satin = satin_tables(spark, d)
    return G.layer_weights(stats, parents, 1, adj, satin)


SIDES = "(SELECT unnest([{'nx': 0, 'ny': -1, 'ax': 1, 'ay': 0, 'bx': 0, 'by_': 0}, {'nx': 0, 'ny': 1, 'ax': 0, 'ay': 1, 'bx': 1, 'by_': 1}, {'nx': -1, 'ny': 0, 'ax': 0, 'ay': 0, 'bx': 0, 'by_': 1}, {'nx': 1, 'ny': 0, 'ax': 1, 'ay': 1, 'bx': 1, 'by_': 0}]) AS s)"
EDGES = f"edges AS (SELECT c.image_id, c.comp_id, c.x + s.ax AS ax, c.y + s.ay AS ay, c.x + s.bx AS bx, c.y + s.by_ AS by_, coalesce(n.comp_id, -1) AS other FROM regions c CROSS JOIN {SIDES} LEFT JOIN regions n ON n.image_id = c.image_id AND n.x = c.x + s.nx AND n.y = c.y + s.ny WHERE coalesce(n.comp_id, -1) <> c.comp_id)"


@query(f"{BASE}, {EDGES} SELECT image_id, comp_id, ax, ay, bx, by_ AS \"by\", other FROM edges WHERE other < 0 OR other >= comp_id")
def boundary_edges(spark, d):
    c = cells(spark, d)
    return G.boundary_edges(R.with_component(c, four(spark, d)), dedupe=True).select("image_id", "comp_id", "ax", "ay", "bx", "by", "other")


@query(f"{BASE}, {EDGES} SELECT image_id, comp_id, other, round(count(*) * 0.2::DOUBLE, 6) AS length_mm FROM edges GROUP BY 1, 2, 3")
def perimeters(spark, d):
    c = cells(spark, d)
    return G.perimeters(G.boundary_edges(R.with_component(c, four(spark, d))), CELL_MM).withColumn("length_mm", F.round("length_mm", 6))


@query()
def thin_areas(spark, d):
    c = cells(spark, d).where("label >= 0")
    return G.thin_areas(R.with_component(c, R.connected_components(c, 8)), CELL_MM, 1.0)


@query()
def skeleton_degree(spark, d):
    c = cells(spark, d).where("label >= 0")
    return G.skeleton_degree(cut(G.thin_areas(R.with_component(c, R.connected_components(c, 8)), CELL_MM, 1.0)))


def bar_cells(spark, d):
    """Strokes on each image's grid: crossing bars three cells wide, every 12 cells across and 9 down, broken where an image's number says so."""
    x, y, i = F.col("x"), F.col("y"), F.col("image_id")
    bar = (x % 12 < 3) & ((y + i) % 31 != 0) | (y % 9 < 3) & ((x + i) % 23 != 0)
    return cells(spark, d).withColumn("label", F.when(bar, 1).otherwise(-1)).where("label = 1")


@query()
def trace_strokes(spark, d):
    """Skeletons of the bars as ordered strokes."""
    c = bar_cells(spark, d)
    skeleton = G.thin_areas(R.with_component(c, R.connected_components(c, 8)), CELL_MM, 2.0, long_enough=False)
    return C.trace_strokes(cut(skeleton), CELL_MM)


@query()
def centre_lines(spark, d):
    """Satin paths of the bars, with widths."""
    c = bar_cells(spark, d)
    return C.centre_lines(cut(R.with_component(c, R.connected_components(c, 8))), CELL_MM, 2.0)
