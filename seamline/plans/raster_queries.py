"""Queries over pixels and label grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions.colour import rgb_to_lab
from seamline.operators import raster as R
from seamline.operators.regions import min_cells
from seamline.plans.adapters import CELL_MM, CELLS, CHOICES, PIXELS, cells, choices, pixels
from seamline.plans.base import query
from seamline.session import cut
from seamline.plans.colour_queries import lab_sql

RUNS = "label_runs AS (SELECT image_id, y, label, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y, label ORDER BY x) AS g FROM {0}) GROUP BY image_id, y, label, g)"
NODE = "(CAST({0}image_id AS BIGINT) * 268435456 + {0}y * 16384 + {0}x0)"


def components_sql(source: str, conn: int, name: str) -> str:
    """CTEs that end in ``name`` (image_id, y, label, x0, x1, comp_id); needs WITH RECURSIVE."""
    reach = 1 if conn == 8 else 0
    return f"""{name}_r AS (SELECT image_id, y, label, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y, label ORDER BY x) AS g FROM {source}) GROUP BY image_id, y, label, g),
{name}_n AS (SELECT *, {NODE.format("")} AS node FROM {name}_r),
{name}_e AS (SELECT p.node AS a, q.node AS b FROM {name}_n p JOIN {name}_n q ON p.image_id = q.image_id AND p.label = q.label AND abs(p.y - q.y) = 1 AND p.x0 <= q.x1 + {reach} AND q.x0 <= p.x1 + {reach}),
{name}_c AS (SELECT node AS root, node FROM {name}_n UNION SELECT c.root, e.b FROM {name}_c c JOIN {name}_e e ON e.a = c.node AND e.b > c.root),
{name} AS (SELECT n.image_id, n.y, n.label, n.x0, n.x1, m.comp_id FROM {name}_n n JOIN (SELECT node, min(root) AS comp_id FROM {name}_c GROUP BY 1) m USING (node))"""


@query(f"WITH {PIXELS} SELECT image_id, count(*) AS opaque, CAST(sum(r) AS BIGINT) AS r FROM pixels WHERE a >= 128 GROUP BY 1")
def opaque(spark, d):
    return R.opaque(pixels(spark, d)).groupBy("image_id").agg(F.count("*").alias("opaque"), F.sum("r").alias("r"))


@query(f"""WITH {PIXELS}, sized AS (SELECT *, max(x) OVER (PARTITION BY image_id) + 1 AS w, max(y) OVER (PARTITION BY image_id) + 1 AS h FROM pixels)
SELECT image_id, CAST(x * 8 // w AS INTEGER) AS x, CAST(y * 8 // h AS INTEGER) AS y, round(coalesce(sum(r * a) / CAST(nullif(sum(a), 0) AS DOUBLE), 0), 6) AS r, round(coalesce(sum(g * a) / CAST(nullif(sum(a), 0) AS DOUBLE), 0), 6) AS g,
round(coalesce(sum(b * a) / CAST(nullif(sum(a), 0) AS DOUBLE), 0), 6) AS b, round(avg(a), 6) AS a FROM sized GROUP BY 1, 2, 3""")
def resample_pixels(spark, d):
    return R.resample_pixels(pixels(spark, d), 8, 8).select("image_id", "x", "y", *[F.round(c, 6).alias(c) for c in "rgba"])


FRAMED = "framed AS (SELECT p.image_id, p.x, p.y, CASE WHEN f THEN 200 ELSE r END AS r, CASE WHEN f THEN 190 ELSE g END AS g, CASE WHEN f THEN 180 ELSE b END AS b, CASE WHEN f AND p.image_id % 3 = 0 THEN 0 WHEN f THEN 255 ELSE a END AS a FROM (SELECT *, x < 4 OR y < 2 OR x > 20 OR y >= h - 2 AS f FROM (SELECT *, max(y) OVER (PARTITION BY image_id) AS h FROM pixels)) p WHERE y < h)"


@query(f"""WITH {PIXELS}, {FRAMED}, {lab_sql("framed", "image_id, x, y, a", "px").replace("SELECT image_id, x, y, a, 116", "SELECT image_id, x, y, a AS alpha, 116")},
sized AS (SELECT *, max(x) OVER (PARTITION BY image_id) AS mx, max(y) OVER (PARTITION BY image_id) AS my FROM px),
corner AS (SELECT * FROM sized WHERE x IN (0, mx) AND y IN (0, my)), first AS (SELECT image_id, l AS bl, a AS ba, b_ AS bb FROM corner WHERE x = 0 AND y = 0),
plain AS (SELECT c.image_id, any_value(bl) AS bl, any_value(ba) AS ba, any_value(bb) AS bb, max(alpha) < 128 AS clear FROM corner c JOIN first USING (image_id) GROUP BY 1
  HAVING max(alpha) < 128 OR (min(alpha) >= 128 AND max((l - bl) ** 2 + (a - ba) ** 2 + (b_ - bb) ** 2) < 100)),
inner_ AS (SELECT s.* FROM sized s JOIN plain p USING (image_id) WHERE NOT CASE WHEN clear THEN alpha < 128 ELSE alpha >= 128 AND (l - bl) ** 2 + (a - ba) ** 2 + (b_ - bb) ** 2 < 150 END)
SELECT image_id, greatest(0, min(x) - 2) AS x, greatest(0, min(y) - 2) AS y, least(max(mx) + 1, max(x) + 3) - greatest(0, min(x) - 2) AS width, least(max(my) + 1, max(y) + 3) - greatest(0, min(y) - 2) AS height FROM inner_ GROUP BY 1""")
def content_box(spark, d):
    from pyspark.sql import Window

    p = pixels(spark, d).withColumn("h", F.max("y").over(Window.partitionBy("image_id"))).where("y < h")
    f = (F.col("x") < 4) | (F.col("y") < 2) | (F.col("x") > 20) | (F.col("y") >= F.col("h") - 2)
    p = p.withColumns({"r": F.when(f, 200).otherwise(F.col("r")), "g": F.when(f, 190).otherwise(F.col("g")), "b": F.when(f, 180).otherwise(F.col("b")), "a": F.when(f & (F.col("image_id") % 3 == 0), 0).when(f, 255).otherwise(F.col("a"))})
    return R.content_box(p.drop("h"))


@query(f"WITH {CELLS}, n AS (SELECT image_id, label AS cluster, count(*) AS cells FROM cells WHERE label >= 0 GROUP BY 1, 2) SELECT *, round(cells / CAST(sum(cells) OVER (PARTITION BY image_id) AS DOUBLE), 6) AS coverage FROM n")
def coverage(spark, d):
    return R.coverage(cells(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {CELLS}, s AS (SELECT *, max(x) OVER (PARTITION BY image_id) AS mx, max(y) OVER (PARTITION BY image_id) AS my FROM cells),
n AS (SELECT image_id, label, sum(CAST(y = 0 AS INTEGER) + CAST(y = my AS INTEGER) + CAST(x = 0 AS INTEGER) + CAST(x = mx AS INTEGER)) AS n FROM s GROUP BY 1, 2 HAVING n > 0),
m AS (SELECT image_id, sum(n) AS total, coalesce(sum(n) FILTER (label >= 0), 0) AS seen FROM n GROUP BY 1),
best AS (SELECT image_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) AS k FROM n WHERE label >= 0) WHERE k = 1)
SELECT image_id, CASE WHEN seen * 2 > total AND n >= total * 0.4 THEN label END AS background FROM m LEFT JOIN best USING (image_id)""")
def background(spark, d):
    return R.background(cells(spark, d))


VOTES = """wide AS MATERIALIZED (SELECT image_id, x, y, label, lag(label) OVER r AS before, lead(label) OVER r AS after FROM cells WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
three AS (SELECT image_id, x, unnest([y - 1, y, y + 1]) AS y, before, label, after FROM wide), nine AS (SELECT image_id, x, y, unnest([before, label, after]) AS label FROM three),
votes AS (SELECT image_id, x, y, label FROM nine WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)"""


@query(f"WITH {CELLS}, {VOTES} SELECT c.image_id, c.x, c.y, coalesce(v.label, c.label) AS label FROM wide c LEFT JOIN votes v ON v.image_id = c.image_id AND v.x = c.x AND v.y = c.y")
def majority_filter(spark, d):
    return R.majority_filter(cells(spark, d))


@query(f"WITH {CELLS}, {RUNS.format('cells')} SELECT * FROM label_runs")
def label_runs(spark, d):
    return R.label_runs(cells(spark, d))


@query(f"WITH {CELLS}, {RUNS.format('cells')} SELECT {NODE.format('p.')} AS a, {NODE.format('q.')} AS b FROM label_runs p JOIN label_runs q ON p.image_id = q.image_id AND p.label = q.label AND p.y = q.y + 1 AND p.x0 <= q.x1 AND q.x0 <= p.x1")
def run_overlaps(spark, d):
    return R.run_overlaps(R.label_runs(cells(spark, d)), 4)


@query(f"WITH RECURSIVE {CELLS}, {components_sql('cells', 8, 'comps')} SELECT * FROM comps")
def connected_components(spark, d):
    return R.connected_components(cells(spark, d), 8)


REGIONS = f"{components_sql('cells', 4, 'comps')}, regions AS (SELECT c.*, comp_id FROM cells c JOIN comps r ON r.image_id = c.image_id AND r.y = c.y AND c.x BETWEEN r.x0 AND r.x1)"
TARGET = """near AS (SELECT p.image_id, p.comp_id, q.label, count(*) AS n FROM regions p JOIN regions q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1 AND p.y BETWEEN q.y - 1 AND q.y + 1 AND p.label <> q.label GROUP BY 1, 2, 3),
target AS (SELECT image_id, comp_id, label AS target FROM (SELECT *, row_number() OVER (PARTITION BY image_id, comp_id ORDER BY n DESC, label) AS k FROM near) WHERE k = 1)"""


@query(f"WITH RECURSIVE {CELLS}, {REGIONS}, {TARGET} SELECT * FROM target")
def region_target(spark, d):
    c = cells(spark, d)
    return R.region_target(R.with_component(c, R.connected_components(c, 4)))


#: Cells under which a region goes, as in ``jobs.plan_colours`` (1.5 mm2).
LEAST = min_cells(CELL_MM, 1.5)[0]


def _pass_sql(source: str, name: str) -> str:
    """CTEs that end in ``name``: the cells of ``source`` after one pass of ``remove_small_regions``, all of whose regions are relabelled at once; after a pass that changes nothing another one doesn't, either."""
    return f"""{components_sql(source, 4, f"{name}_k")}, {name}_g AS MATERIALIZED (SELECT c.*, comp_id FROM {source} c JOIN {name}_k k ON k.image_id = c.image_id AND k.y = c.y AND c.x BETWEEN k.x0 AND k.x1),
{name}_s AS (SELECT image_id, comp_id FROM {name}_g GROUP BY 1, 2 HAVING count(*) < {LEAST}),
{name}_d AS (SELECT image_id, comp_id, label, unnest([x - 1, x + 1, x, x]) AS x, unnest([y, y, y - 1, y + 1]) AS y FROM {name}_g SEMI JOIN {name}_s USING (image_id, comp_id)),
{name}_t AS (SELECT image_id, comp_id, label AS target FROM (SELECT d.image_id, d.comp_id, q.label, row_number() OVER (PARTITION BY d.image_id, d.comp_id ORDER BY count(*) DESC, q.label) AS k
  FROM {name}_d d JOIN {name}_g q USING (image_id, x, y) WHERE d.label <> q.label GROUP BY 1, 2, 3) WHERE k = 1),
{name} AS MATERIALIZED (SELECT g.image_id, g.x, g.y, coalesce(t.target, g.label) AS label FROM {name}_g g LEFT JOIN {name}_t t USING (image_id, comp_id))"""


@query(f"WITH RECURSIVE {CELLS}, {_pass_sql('cells', 'one')}, {_pass_sql('one', 'two')}, {_pass_sql('two', 'three')} SELECT * FROM three")
def remove_small_regions(spark, d):
    return R.remove_small_regions(cells(spark, d), LEAST)


def _colours(spark, d):
    one = R.opaque(pixels(spark, d)).groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("weight"))
    return one.withColumn("lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))


def _centers(spark, d):
    return spark.range(4).select(F.col("id").cast("int").alias("cluster"), F.struct((F.col("id") * 25.0 + 10).alias("l"), (F.col("id") * 20.0 - 30).alias("a"), (30 - F.col("id") * 20.0).alias("b")).alias("lab")).join(pixels(spark, d).select("image_id").distinct(), F.lit(True))


COLOURED = f"WITH {PIXELS}, distinct_ AS (SELECT image_id, r, g, b, count(*) AS weight FROM pixels WHERE a >= 128 GROUP BY ALL), {lab_sql('distinct_', 'image_id, r, g, b, weight', 'colours')}, centers AS (SELECT i AS cluster, i * 25.0::DOUBLE + 10 AS cl, i * 20.0::DOUBLE - 30 AS ca, 30 - i * 20.0::DOUBLE AS cb FROM (SELECT unnest(range(0, 4)) AS i)), near AS (SELECT image_id, r, g, b, weight, l, a, b_, CAST(arg_min(cluster, d) AS INTEGER) AS cluster FROM (SELECT *, (l - cl) ** 2 + (a - ca) ** 2 + (b_ - cb) ** 2 AS d FROM colours, centers) GROUP BY ALL)"


@query(f"{COLOURED} SELECT image_id, cluster, count(*) AS colours, CAST(sum(weight) AS BIGINT) AS pixels FROM near GROUP BY 1, 2")
def assign_cluster(spark, d):
    return R.assign_cluster(_colours(spark, d), _centers(spark, d)).groupBy("image_id", "cluster").agg(F.count("*").alias("colours"), F.sum("weight").alias("pixels"))


@query(f"""{COLOURED}, ids AS (SELECT DISTINCT image_id FROM pixels), mean AS (SELECT image_id, cluster, sum(l * weight) / sum(weight) AS l, sum(a * weight) / sum(weight) AS a, sum(b_ * weight) / sum(weight) AS b FROM near GROUP BY 1, 2)
SELECT i.image_id, CAST(c.cluster AS INTEGER) AS cluster, round(coalesce(m.l, cl), 5) AS l, round(coalesce(m.a, ca), 5) AS a, round(coalesce(m.b, cb), 5) AS b FROM ids i CROSS JOIN centers c LEFT JOIN mean m ON m.image_id = i.image_id AND m.cluster = c.cluster""")
def kmeans_lloyd(spark, d):
    out = R.kmeans_lloyd(_colours(spark, d), _centers(spark, d), rounds=1)
    return out.select("image_id", "cluster", *[F.round(f"lab.{c}", 5).alias(c) for c in "lab"])


@query()
def image_palette(spark, d):
    c = cut(_colours(spark, d))
    return R.kmeans_lloyd(c, R.image_palette(c, 8), rounds=5).select("image_id", "cluster", "lab.*")


@query(f"""WITH {CELLS}, {CHOICES}, f AS (SELECT image_id, thread_id, min(cluster) AS c FROM choices WHERE enabled GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c) - 1 AS layer FROM f),
m AS (SELECT c.image_id, c.cluster, n.layer FROM choices c JOIN n USING (image_id, thread_id) WHERE enabled)
SELECT c.image_id, x, y, CAST(coalesce(layer, -1) AS INTEGER) AS layer FROM cells c LEFT JOIN m ON m.image_id = c.image_id AND m.cluster = c.label""")
def layer_map(spark, d):
    return R.layer_map(cells(spark, d), choices(spark, d)).select("image_id", "x", "y", "layer")


@query(f"""WITH {CELLS}, n AS (SELECT image_id, label AS cluster, count(*) AS cells FROM cells WHERE label >= 0 GROUP BY 1, 2), c AS (SELECT *, cells / CAST(sum(cells) OVER (PARTITION BY image_id) AS DOUBLE) AS coverage FROM n)
SELECT image_id, cluster, CAST(row_number() OVER (PARTITION BY image_id ORDER BY coverage DESC, cluster) AS INTEGER) AS place FROM c""")
def rank_colours(spark, d):
    from seamline.operators.catalogue import rank_colours as rank

    return rank(R.coverage(cells(spark, d))).select("image_id", "cluster", "place")


@query(f"""WITH {CELLS}, n AS (SELECT image_id, label AS cluster, count(*) AS cells FROM cells WHERE label >= 0 GROUP BY 1, 2), c AS (SELECT *, cells / CAST(sum(cells) OVER (PARTITION BY image_id) AS DOUBLE) AS coverage FROM n)
SELECT image_id, cluster, image_id % 4 <> cluster AS enabled FROM c WHERE coverage > 0.0005""")
def default_choices(spark, d):
    from seamline.operators.catalogue import default_choices as choose

    c = R.coverage(cells(spark, d)).withColumn("is_background", F.col("image_id") % 4 == F.col("cluster"))
    return choose(c).select("image_id", "cluster", "enabled")
