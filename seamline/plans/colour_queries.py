"""Queries over colours and thread catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import colour as C
from seamline.operators import catalogue as K
from seamline.plans.adapters import CELLS, CHOICES, PIXELS, THREADS, choices, pixels, threads
from seamline.plans.base import query

LINEAR = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE power(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def lab_sql(source: str, keep: str, name: str) -> str:
    """CTEs that end in ``name``: the columns ``keep`` of ``source`` (r, g, b) with l, a, b_ (Lab)."""
    f = lambda t: f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0::DOUBLE / 116 END"
    return f"""{name}_1 AS (SELECT {keep}, {LINEAR.format("r")} AS rl, {LINEAR.format("g")} AS gl, {LINEAR.format("b")} AS bl FROM {source}),
{name}_2 AS (SELECT {keep}, (0.4124::DOUBLE * rl + 0.3576::DOUBLE * gl + 0.1805::DOUBLE * bl) / 0.95047 AS x_, (0.2126::DOUBLE * rl + 0.7152::DOUBLE * gl + 0.0722::DOUBLE * bl) AS y_, (0.0193::DOUBLE * rl + 0.1192::DOUBLE * gl + 0.9505::DOUBLE * bl) / 1.08883 AS z_ FROM {name}_1),
{name}_3 AS (SELECT {keep}, {f("x_")} AS fx, {f("y_")} AS fy, {f("z_")} AS fz FROM {name}_2),
{name} AS (SELECT {keep}, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b_ FROM {name}_3)"""


def ciede_sql(source: str, keep: str, name: str) -> str:
    """CTEs that end in ``name``: ``keep`` of ``source`` (l1, a1, b1, l2, a2, b2) with d."""
    ratio = lambda c: f"sqrt(power({c}, 7) / (power({c}, 7) + power(25.0::DOUBLE, 7)))"
    hyp = lambda x, y: f"sqrt({x} * {x} + {y} * {y})"
    hue = lambda y, x: f"CASE WHEN atan2({y}, {x}) < 0 THEN degrees(atan2({y}, {x})) + 360 ELSE degrees(atan2({y}, {x})) END"
    cos = lambda e: f"cos(radians({e}))"
    return f"""{name}_1 AS (SELECT *, 1.5 - 0.5 * {ratio("c_")} AS grow FROM (SELECT *, ({hyp("a1", "b1")} + {hyp("a2", "b2")}) / 2 AS c_ FROM {source})),
{name}_2 AS (SELECT *, {hyp("x1", "b1")} AS c1, {hyp("x2", "b2")} AS c2, {hue("b1", "x1")} AS h1, {hue("b2", "x2")} AS h2 FROM (SELECT *, grow * a1 AS x1, grow * a2 AS x2 FROM {name}_1)),
{name}_3 AS (SELECT *, (c1 + c2) / 2 AS mc, (l1 + l2) / 2 AS ml, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS turn,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh FROM {name}_2),
{name}_4 AS (SELECT *, 1 - 0.17 * {cos("mh - 30")} + 0.24 * {cos("2 * mh")} + 0.32 * {cos("3 * mh + 6")} - 0.2 * {cos("4 * mh - 63")} AS t, 60 * exp(-power((mh - 275) / 25, 2)) AS bend FROM {name}_3),
{name}_5 AS (SELECT *, (l2 - l1) / (1 + 0.015 * power(ml - 50, 2) / sqrt(20 + power(ml - 50, 2))) AS dl, (c2 - c1) / (1 + 0.045 * mc) AS dc, 2 * sqrt(c1 * c2) * sin(radians(turn / 2)) / (1 + 0.015 * mc * t) AS dh FROM {name}_4),
{name} AS (SELECT {keep}, sqrt(dl * dl + dc * dc + dh * dh - sin(radians(bend)) * 2 * {ratio("mc")} * dc * dh) AS d FROM {name}_5)"""


LAB = f"WITH {THREADS}, {lab_sql('threads', 'thread_id, r, g, b', 'lab')}"


def with_lab(df):
    return df.withColumn("lab", C.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))


@query(f"{LAB} SELECT thread_id, round(l, 6) AS l, round(a, 6) + 0.0 AS a, round(b_, 6) + 0.0 AS lab_b FROM lab")
def rgb_to_lab(spark, d):
    t = with_lab(threads(spark, d))
    return t.select("thread_id", F.round("lab.l", 6).alias("l"), (F.round("lab.a", 6) + 0.0).alias("a"), (F.round("lab.b", 6) + 0.0).alias("lab_b"))


@query(f"WITH {THREADS} SELECT thread_id, r, g, b FROM threads")
def lab_round_trip(spark, d):
    t = with_lab(threads(spark, d)).withColumn("back", C.lab_to_rgb(F.col("lab.l"), F.col("lab.a"), F.col("lab.b")))
    return t.select("thread_id", *[F.round(f"back.{c}").cast("int").alias(c) for c in "rgb"])


@query(f"{LAB} SELECT p.thread_id, round((p.l - q.l) ** 2 + (p.a - q.a) ** 2 + (p.b_ - q.b_) ** 2, 6) AS d2 FROM lab p JOIN lab q ON q.thread_id = 't-7'")
def lab_dist2(spark, d):
    t = with_lab(threads(spark, d))
    other = t.where("thread_id = 't-7'").select(F.col("lab").alias("q"), F.lit(1).alias("one"))  # one row
    return t.withColumn("one", F.lit(1)).join(F.broadcast(other), "one").select("thread_id", F.round(C.lab_dist2(F.col("lab"), F.col("q")), 6).alias("d2"))


PAIRS = f"""{LAB}, neighbours AS (SELECT p.thread_id, p.l AS l1, p.a AS a1, p.b_ AS b1, q.l AS l2, q.a AS a2, q.b_ AS b2 FROM lab p JOIN lab q ON CAST(substr(q.thread_id, 3) AS BIGINT) = CAST(substr(p.thread_id, 3) AS BIGINT) + 1),
{ciede_sql("neighbours", "thread_id", "diff")}"""


@query(f"{PAIRS} SELECT thread_id, round(d, 6) AS d FROM diff")
def delta_e2000(spark, d):
    t = with_lab(threads(spark, d))
    other = t.select((F.col("ord") - 1).alias("ord"), F.col("lab").alias("q"))
    return C.with_delta_e2000(t.join(other, "ord"), "lab", "q", "d").select("thread_id", F.round("d", 6).alias("d"))


NAMED = """hues AS (SELECT *, sqrt(a * a + b_ * b_) AS chroma, CASE WHEN atan2(b_, a) < 0 THEN degrees(atan2(b_, a)) + 360 ELSE degrees(atan2(b_, a)) END AS hue FROM lab),
banded AS (SELECT *, CASE WHEN hue < 12 OR hue >= 350 THEN 'pink' WHEN hue < 50 THEN 'red' WHEN hue < 78 THEN 'orange' WHEN hue < 90 THEN 'gold' WHEN hue < 108 THEN 'yellow' WHEN hue < 135 THEN 'olive' WHEN hue < 185 THEN 'green' WHEN hue < 215 THEN 'teal' WHEN hue < 304 THEN 'blue' WHEN hue < 335 THEN 'purple' ELSE 'magenta' END AS base FROM hues),
earthy AS (SELECT *, CASE WHEN hue >= 45 AND hue < 110 AND l > 70 AND chroma < 35 THEN 'beige' WHEN hue >= 12 AND hue < 45 AND l < 35 THEN 'maroon' WHEN hue >= 15 AND hue < 100 AND l < 55 AND chroma < 70 AND base <> 'red' THEN 'brown' ELSE base END AS warm FROM banded),
turned AS (SELECT *, CASE WHEN warm = 'pink' AND l < 40 THEN 'burgundy' WHEN warm = 'olive' AND l > 75 THEN 'lime' WHEN warm = 'yellow' AND l < 60 THEN 'olive' ELSE warm END AS word FROM earthy),
named AS (SELECT *, CASE WHEN l < 20 AND chroma < 15 THEN 'black' WHEN chroma < 9 THEN CASE WHEN l < 18 THEN 'black' WHEN l > 92 THEN 'white' WHEN l > 80 THEN 'off-white' WHEN l < 40 THEN 'dark grey' WHEN l < 65 THEN 'grey' ELSE 'light grey' END
  ELSE CASE WHEN word IN ('brown', 'beige', 'maroon', 'burgundy') THEN '' WHEN l < 35 THEN 'dark ' WHEN l > 80 AND chroma < 40 THEN 'pale ' WHEN l > 70 THEN 'light ' ELSE '' END || word END AS colour FROM turned)"""


@query(f"{LAB}, {NAMED} SELECT thread_id, colour FROM named")
def describe_color(spark, d):
    return threads(spark, d).select("thread_id", C.describe_color(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


@query(f"""WITH {THREADS} SELECT thread_id, printf('#%02X%02X%02X', r, g, b) AS hex, CASE WHEN range_id = 'Brand#1' THEN code || '. ' || name ELSE code || ' · ' || name END AS label,
round((0.2126 * r + 0.7152 * g + 0.0722 * b)::DOUBLE / 255, 6) AS luminance, (0.2126 * r + 0.7152 * g + 0.0722 * b)::DOUBLE / 255 < 0.4 AS dark FROM threads""")
def thread_labels(spark, d):
    hex_ = C.thread_hex(F.col("r"), F.col("g"), F.col("b"))
    light = C.luminance(hex_)
    return threads(spark, d).select("thread_id", hex_.alias("hex"), C.thread_label(F.col("range_id") == "Brand#1", F.col("code"), F.col("name")).alias("label"), F.round(light, 6).alias("luminance"), (light < 0.4).alias("dark"))


def image_colours(spark, d):
    """Mean colour of each half row of an image, in whole numbers, each looking in a range of its own."""
    half = F.when(F.col("x") < 12, 0).otherwise(1)
    one = pixels(spark, d).where("a >= 128").groupBy("image_id", "y", half.alias("half")).agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    return one.withColumn("range_id", F.concat(F.lit("Brand#"), F.col("image_id") % 20 + 1))


COLOURS = """colours AS (SELECT image_id, y, half, r, g, b, 'Brand#' || (image_id % 20 + 1) AS range_id FROM (SELECT image_id, y, CASE WHEN x < 12 THEN 0 ELSE 1 END AS half,
  CAST(floor(avg(r)) AS INTEGER) AS r, CAST(floor(avg(g)) AS INTEGER) AS g, CAST(floor(avg(b)) AS INTEGER) AS b FROM pixels WHERE a >= 128 GROUP BY ALL))"""
NEAR = f"""WITH {THREADS}, {PIXELS}, {COLOURS}, keys_ AS (SELECT DISTINCT range_id, r, g, b FROM colours),
{lab_sql("keys_", "range_id, r, g, b", "key_lab")}, {lab_sql("(SELECT * FROM threads WHERE matchable)", "range_id, ord, thread_id", "shade_lab")},
pairs AS (SELECT k.range_id, k.r, k.g, k.b, s.ord, s.thread_id, k.l AS l1, k.a AS a1, k.b_ AS b1, s.l AS l2, s.a AS a2, s.b_ AS b2 FROM key_lab k JOIN shade_lab s USING (range_id)),
{ciede_sql("pairs", "range_id, r, g, b, ord, thread_id", "diff")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY range_id, r, g, b ORDER BY d, ord) AS place FROM diff)"""


@query(f"{NEAR} SELECT c.image_id, c.y, c.half, thread_id, round(d, 4) AS delta_e FROM colours c LEFT JOIN (SELECT * FROM ranked WHERE place = 1) n USING (range_id, r, g, b)")
def nearest_thread(spark, d):
    return K.nearest_thread(image_colours(spark, d), threads(spark, d)).select("image_id", "y", "half", "thread_id", F.round("delta_e", 4).alias("delta_e"))


@query(f"{NEAR} SELECT range_id, r, g, b, CAST(place AS INTEGER) AS place, thread_id FROM ranked WHERE place <= 3")
def top_threads(spark, d):
    return K.top_threads(image_colours(spark, d), threads(spark, d), 3).drop("d")


RAW = "raw AS (SELECT 'card' AS range_id, code, (r * 7) % 256 AS r, (g * 3) % 256 AS g, (b * 5) % 256 AS b, ord FROM threads WHERE range_id <> 'Brand#1')"


@query(f"""WITH {THREADS}, {RAW}, {lab_sql("raw", "code, r, g, b", "lab")}, {NAMED}, {lab_sql("(SELECT * FROM threads WHERE matchable AND range_id = 'Brand#1')", "ord, machine_index", "shade")},
pairs AS (SELECT k.code, s.ord, s.machine_index, k.l AS l1, k.a AS a1, k.b_ AS b1, s.l AS l2, s.a AS a2, s.b_ AS b2 FROM lab k, shade s), {ciede_sql("pairs", "code, ord, machine_index", "diff")},
best AS (SELECT code, machine_index FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d, ord) AS n FROM diff) WHERE n = 1)
SELECT 'card-' || code AS thread_id, colour AS name, machine_index FROM named JOIN best USING (code)""")
def build_catalogue(spark, d):
    t = threads(spark, d)
    raw = t.where("range_id <> 'Brand#1'").select(F.lit("card").alias("range_id"), "maker", "brand", "code", *[(F.col(c) * n % 256).alias(c) for c, n in zip("rgb", (7, 3, 5), strict=True)], "ord")
    return K.build_catalogue(raw, t.where("range_id = 'Brand#1'")).select("thread_id", "name", "machine_index")


@query(f"WITH {PIXELS}, {CELLS}, {CHOICES}, {THREADS} SELECT image_id, cluster, thread_id, range_id, code, name FROM (SELECT image_id, cluster, CASE WHEN cluster = 3 THEN 'none' ELSE thread_id END AS thread_id FROM choices) LEFT JOIN threads USING (thread_id)")
def find_thread(spark, d):
    keys = choices(spark, d).select("image_id", "cluster", F.when(F.col("cluster") == 3, "none").otherwise(F.col("thread_id")).alias("thread_id"))
    return K.find_thread(keys, threads(spark, d)).select("image_id", "cluster", "thread_id", "range_id", "code", "name")


@query(f"""WITH {THREADS}, own AS (SELECT machine_index, arg_min(thread_id, ord) AS t FROM threads WHERE machine_index < 60 GROUP BY 1)
SELECT k.thread_id, coalesce(o.t, (SELECT t FROM own WHERE machine_index = 20)) AS machine_thread_id FROM threads k LEFT JOIN own o USING (machine_index)""")
def machine_thread(spark, d):
    t = threads(spark, d)
    return K.machine_thread(t.select("thread_id", "machine_index"), t.where("machine_index < 60").select("machine_index", "ord", "thread_id")).select("thread_id", "machine_thread_id")


@query(f"WITH {THREADS} SELECT thread_id, range_id FROM threads WHERE contains(code, 'red') OR contains(lower(name), 'red')")
def search_threads(spark, d):
    return K.search_threads(threads(spark, d), F.lit("  Red ")).select("thread_id", "range_id")


@query(f"WITH {THREADS} SELECT thread_id, range_id FROM threads WHERE matchable")
def matchable_threads(spark, d):
    return K.matchable(threads(spark, d)).select("thread_id", "range_id")


@query(f"""WITH {PIXELS}, {CELLS}, {CHOICES}, {THREADS}, owned AS (SELECT c.image_id, c.cluster, c.thread_id, t.range_id, t.r, t.g, t.b FROM choices c JOIN threads t USING (thread_id)),
keys_ AS (SELECT DISTINCT r, g, b FROM owned), {lab_sql("keys_", "r, g, b", "key_lab")}, {lab_sql("(SELECT * FROM threads WHERE matchable AND range_id = 'Brand#2')", "ord, thread_id", "shade")},
pairs AS (SELECT k.r, k.g, k.b, s.ord, s.thread_id, k.l AS l1, k.a AS a1, k.b_ AS b1, s.l AS l2, s.a AS a2, s.b_ AS b2 FROM key_lab k, shade s), {ciede_sql("pairs", "r, g, b, ord, thread_id", "diff")},
best AS (SELECT r, g, b, thread_id AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY d, ord) AS n FROM diff) WHERE n = 1)
SELECT image_id, cluster, CASE WHEN range_id = 'Brand#5' THEN new_id ELSE thread_id END AS thread_id FROM owned JOIN best USING (r, g, b)""")
def switch_range(spark, d):
    t = threads(spark, d)
    c = choices(spark, d).join(t.select("thread_id", "r", "g", "b"), "thread_id")
    return K.switch_range(c, t, "Brand#5", "Brand#2").select("image_id", "cluster", "thread_id")


NEW = "fresh AS (SELECT c.image_id, c.cluster, CAST(t.r + c.image_id % 8 AS INTEGER) AS r, CAST(t.g + c.cluster AS INTEGER) AS g, t.b FROM choices c JOIN threads t USING (thread_id)), old AS (SELECT c.*, t.r, t.g, t.b FROM choices c JOIN threads t USING (thread_id))"


@query(f"""WITH {PIXELS}, {CELLS}, {CHOICES}, {THREADS}, {NEW}, m AS (SELECT f.image_id, f.cluster, min(o.cluster) AS first FROM fresh f JOIN old o ON f.image_id = o.image_id AND abs(f.r - o.r) + abs(f.g - o.g) + abs(f.b - o.b) < 12 GROUP BY 1, 2)
SELECT f.image_id, f.cluster, o.thread_id, o.enabled FROM fresh f LEFT JOIN m USING (image_id, cluster) LEFT JOIN old o ON o.image_id = m.image_id AND o.cluster = m.first""")
def carry_choices(spark, d):
    old = choices(spark, d).join(threads(spark, d).select("thread_id", "r", "g", "b"), "thread_id")
    new = old.select("image_id", "cluster", (F.col("r") + F.col("image_id") % 8).cast("int").alias("r"), (F.col("g") + F.col("cluster")).cast("int").alias("g"), "b")
    return K.carry_choices(new, old).select("image_id", "cluster", "thread_id", "enabled")


@query(f"WITH {THREADS} SELECT maker, range_id, count(*) AS shades FROM threads GROUP BY ROLLUP (maker, range_id)")
def range_counts(spark, d):
    return K.range_counts(threads(spark, d))


@query(f"""WITH {THREADS}, a AS (SELECT CASE WHEN ord % 3 = 0 THEN 'a' || thread_id ELSE thread_id END AS thread_id, ord, name FROM threads), b AS (SELECT CASE WHEN ord % 2 = 0 THEN thread_id ELSE 'b' || thread_id END AS thread_id, ord, upper(name) AS name FROM threads)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE thread_id NOT IN (SELECT thread_id FROM a)""")
def union_catalogues(spark, d):
    t = threads(spark, d).select("thread_id", "ord", "name")
    other = lambda mark, own: F.when(own, F.col("thread_id")).otherwise(F.concat(F.lit(mark), "thread_id"))
    return K.union_catalogues(t.withColumn("thread_id", other("a", F.col("ord") % 3 != 0)), t.withColumns({"thread_id": other("b", F.col("ord") % 2 == 0), "name": F.upper("name")}))
