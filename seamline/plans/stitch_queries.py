"""Queries over stitch logs: counts, thread use, windows, lists, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import text as T
from seamline.operators import stitch as S
from seamline.plans.adapters import DESIGN_THREADS, STITCHES, THREADS, design_threads, stitches, threads
from seamline.plans.base import query
from seamline.session import table

WITH = f"WITH {STITCHES}"
ALL = f"WITH {STITCHES}, {DESIGN_THREADS}, {THREADS}"
BLOCKS = "blocks AS (SELECT *, CAST(sum(CASE WHEN k = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq) AS INTEGER) AS block FROM stitches)"
USED = """used AS (SELECT *, CASE WHEN k = 0 AND live THEN sqrt(dx * dx + dy * dy) / 10 + 2.4 WHEN k = 0 THEN 80.0 WHEN k = 1 AND live THEN sqrt(dx * dx + dy * dy) / 10 ELSE 0.0 END AS mm,
  CASE WHEN k = 0 AND NOT live THEN 1 ELSE 0 END AS starts FROM (SELECT *, coalesce(lag(k) OVER w IN (0, 1), false) AS live, CAST(x - lag(x) OVER w AS DOUBLE) AS dx, CAST(y - lag(y) OVER w AS DOUBLE) AS dy
  FROM blocks WINDOW w AS (PARTITION BY design_id ORDER BY seq)))"""
USAGE = """usage_ AS (SELECT design_id, block, coalesce(mm, 0.0) / 1000 AS top_m, CAST(coalesce(runs, 0) AS BIGINT) AS runs FROM design_threads LEFT JOIN
  (SELECT design_id, block, sum(mm) AS mm, sum(starts) AS runs FROM used GROUP BY ALL) USING (design_id, block))"""
SUMMARY = """summary AS (SELECT design_id, (max(x) - min(x)) / 10 AS width_mm, (max(y) - min(y)) / 10 AS height_mm, count(*) FILTER (k = 0) AS stitches, any_value(threads) AS threads,
  any_value(changes) AS changes, count(*) FILTER (k = 2) AS trims, CAST(ceil(count(*) FILTER (k = 0) / 700.0::DOUBLE + any_value(changes) * 0.5::DOUBLE + count(*) FILTER (k = 2) * 0.1::DOUBLE) AS BIGINT) AS minutes,
  sum(mm) / 1000 AS top_m, sum(mm) / 1000 * 0.4 AS bobbin_m, CAST(sum(starts) AS BIGINT) AS runs
  FROM used JOIN (SELECT design_id, count(DISTINCT thread_id) AS threads, greatest(count(*) - 1, 0) AS changes FROM design_threads GROUP BY 1) USING (design_id) GROUP BY 1)"""


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"{WITH} SELECT design_id, count(*) FILTER (k = 0) AS stitches, count(*) FILTER (k = 1) AS jumps, count(*) FILTER (k = 2) AS trims, count(*) FILTER (k = 3) AS color_changes FROM stitches GROUP BY 1")
def stitch_stats(spark, d):
    return S.stitch_stats(stitches(spark, d))


@query(f"{WITH} SELECT design_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, max(x) - min(x) AS width, max(y) - min(y) AS height FROM stitches GROUP BY 1")
def bounds(spark, d):
    s = stitches(spark, d)
    return S.bounds(s, s.select("design_id").distinct())


@query(f"{ALL}, {BLOCKS}, {USED}, {USAGE} SELECT design_id, block, round(sum(top_m), 6) AS top_m, round(sum(top_m) * 0.4, 6) AS bobbin_m, CAST(sum(runs) AS BIGINT) AS runs FROM usage_ GROUP BY GROUPING SETS ((design_id, block), (design_id))")
def thread_usage(spark, d):
    return rounded(S.thread_usage(stitches(spark, d), design_threads(spark, d)), "top_m", "bobbin_m")


@query(f"{ALL}, {BLOCKS}, {USED}, {SUMMARY} SELECT design_id, round(width_mm, 6) AS width_mm, round(height_mm, 6) AS height_mm, stitches, threads, changes, trims, minutes, round(top_m, 6) AS top_m, round(bobbin_m, 6) AS bobbin_m, runs FROM summary")
def design_summary(spark, d):
    return rounded(S.design_summary(stitches(spark, d), design_threads(spark, d)), "width_mm", "height_mm", "top_m", "bobbin_m")


@query(f"{WITH}, {BLOCKS} SELECT * FROM blocks")
def with_block(spark, d):
    return S.with_block(stitches(spark, d))


@query(f"""{WITH}, {BLOCKS}, runs AS (SELECT *, sum(CASE WHEN k <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq) AS run FROM blocks)
SELECT design_id, CAST(run AS BIGINT) AS run, max(block) AS block, string_agg(x || ',' || y, ' ' ORDER BY seq) AS points FROM runs GROUP BY design_id, run HAVING count(*) > 1""")
def polylines(spark, d):
    p = S.polylines(stitches(spark, d))
    return p.withColumn("points", F.concat_ws(" ", F.transform("points", lambda q: F.concat_ws(",", q["x"], q["y"]))))


@query(f"{WITH} SELECT design_id, seq, round(sqrt(CAST(x - lag(x) OVER w AS DOUBLE) ** 2 + CAST(y - lag(y) OVER w AS DOUBLE) ** 2), 6) AS move FROM stitches WINDOW w AS (PARTITION BY design_id ORDER BY seq)")
def with_move(spark, d):
    return rounded(S.with_move(stitches(spark, d)).select("design_id", "seq", "move"), "move")


@query(f"{WITH} SELECT design_id, seq, CAST(sum(x % 60) OVER w AS INTEGER) AS x, CAST(sum(y % 60) OVER w AS INTEGER) AS y FROM stitches WINDOW w AS (PARTITION BY design_id ORDER BY seq)")
def absolute_positions(spark, d):
    steps = stitches(spark, d).select("design_id", "seq", (F.col("x") % 60).alias("dx"), (F.col("y") % 60).alias("dy"))
    return S.absolute_positions(steps).select("design_id", "seq", "x", "y")


COARSE = "coarse AS (SELECT design_id, seq, (x + 300) // 150 AS x, (y + 300) // 150 AS y, k FROM stitches)"


@query(f"{WITH}, {COARSE} SELECT design_id, seq, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, k FROM (SELECT *, lag(x) OVER w = x AND lag(y) OVER w = y AND lag(k) OVER w = 0 AND k = 0 AS same FROM coarse WINDOW w AS (PARTITION BY design_id ORDER BY seq)) WHERE NOT coalesce(same, false)")
def dedupe_stitches(spark, d):
    s = stitches(spark, d).withColumn("x", F.floor((F.col("x") + 300) / 150).cast("int")).withColumn("y", F.floor((F.col("y") + 300) / 150).cast("int"))
    return S.dedupe_stitches(s)


@query(f"""WITH {STITCHES}, pieces AS (SELECT design_id, seq, 't-' || ((design_id + seq // 3) % 5 // 2) AS thread_id FROM stitches)
SELECT design_id, seq, thread_id, CAST(sum(CASE WHEN old <> thread_id THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq) AS INTEGER) AS block
FROM (SELECT *, lag(thread_id) OVER (PARTITION BY design_id ORDER BY seq) AS old FROM pieces)""")
def thread_sequence(spark, d):
    key = F.floor((F.col("design_id") + F.floor(F.col("seq") / 3)) % 5 / 2)
    return S.thread_sequence(stitches(spark, d).select("design_id", "seq", F.concat(F.lit("t-"), key).alias("thread_id")))


@query(f"""{WITH}, large AS (SELECT design_id, seq, x * CASE WHEN design_id % 2 = 0 THEN 11 ELSE 1 END AS x, y * CASE WHEN design_id % 2 = 0 THEN 11 ELSE 1 END AS y, k FROM stitches),
moved AS (SELECT design_id, seq, k, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y FROM large WINDOW w AS (PARTITION BY design_id ORDER BY seq)),
box AS (SELECT design_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM moved GROUP BY 1),
mid AS (SELECT *, x0 < -2047 OR y0 < -2047 OR x1 > 2047 OR y1 > 2047 AS big FROM box),
centred AS (SELECT m.design_id, seq, k, big, x - CASE WHEN big THEN CAST(trunc((x0 + x1) / 2.0) AS INTEGER) ELSE 0 END AS x, y - CASE WHEN big THEN CAST(trunc((y0 + y1) / 2.0) AS INTEGER) ELSE 0 END AS y FROM moved m JOIN mid USING (design_id))
SELECT design_id, seq + CASE WHEN big THEN 1 ELSE 0 END AS seq, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, k FROM centred UNION ALL SELECT design_id, 0, CAST(x AS INTEGER), CAST(y AS INTEGER), 1 FROM centred WHERE big AND seq = 0""")
def shift_origin(spark, d):
    grow = F.when(F.col("design_id") % 2 == 0, 11).otherwise(1)
    return S.shift_origin(stitches(spark, d).withColumn("x", F.col("x") * grow).withColumn("y", F.col("y") * grow))


@query(f"{WITH} SELECT design_id, seq, x, y, k FROM (SELECT *, count(*) OVER (PARTITION BY design_id) AS n FROM stitches) WHERE seq + 1 <= round(n * 0.37::DOUBLE)")
def sewout_prefix(spark, d):
    return S.sewout_prefix(stitches(spark, d), 0.37)


@query(f"{WITH} SELECT design_id, max(x) - min(x) AS width, max(y) - min(y) AS height, (max(x) - min(x)) / 10 > 39.5 OR (max(y) - min(y)) / 10 > 29.8 AS too_big FROM stitches GROUP BY 1")
def fit_check(spark, d):
    return S.fit_check(S.bounds(stitches(spark, d)), F.lit(39.5), F.lit(29.8)).select("design_id", "width", "height", "too_big")


LIST_M = "lpad(CASE WHEN {0} < 10 THEN printf('%.1f', round({0}, 1)) ELSE CAST(CAST(ceil({0}) AS BIGINT) AS VARCHAR) END, 5, ' ')"
LISTED = f"""{ALL}, {BLOCKS}, {USED}, {USAGE}, {SUMMARY},
total AS (SELECT design_id, sum(top_m) AS top_m FROM usage_ GROUP BY 1),
machine AS (SELECT machine_index, min(name) AS machine_name FROM threads WHERE range_id = 'Brand#1' GROUP BY 1),
lines AS (SELECT design_id, 0 AS line_no, printf('design %d — %.1f × %.1f mm, %d stitches, %d colour changes', design_id, width_mm, height_mm, stitches, changes) AS line FROM summary
UNION ALL SELECT u.design_id, u.block + 1, '  ' || lpad(CAST(u.block + 1 AS VARCHAR), 2, ' ') || '. ' || {LIST_M.format("u.top_m")} || ' m  ' || t.brand || ' ' || t.code || ' – ' || t.name || ' ' || printf('#%02X%02X%02X', t.r, t.g, t.b)
  || CASE WHEN t.brand = 'Brand#1' THEN '' ELSE '   (machine shows: ' || coalesce(machine_name, '') || ')' END
  FROM usage_ u JOIN design_threads d USING (design_id, block) JOIN threads t USING (thread_id) LEFT JOIN machine m ON t.machine_index = m.machine_index
UNION ALL SELECT design_id, 1073741824, 'Total: about ' || CAST(ceil(top_m) AS BIGINT) || ' m of top thread and ' || CAST(ceil(top_m * 0.4) AS BIGINT) || ' m of bobbin thread.' FROM total)"""


@query(f"{LISTED} SELECT design_id, CAST(line_no AS INTEGER) AS line_no, line FROM lines")
def thread_list(spark, d):
    catalogue = threads(spark, d)
    machine = catalogue.where("range_id = 'Brand#1'").groupBy("machine_index").agg(F.min("name").alias("machine_name"))
    dt = design_threads(spark, d)
    names = dt.select("design_id").distinct().withColumn("name", F.format_string("design %d", "design_id"))
    return S.thread_list(stitches(spark, d), dt, catalogue, names, "Brand#1", machine)


@query(f"{WITH} SELECT design_id, count(*) * 3 AS n, md5(string_agg(x || ',' || y || ',' || k, ',' ORDER BY seq)) AS digest FROM stitches GROUP BY 1")
def pack_stitches(spark, d):
    return S.pack_stitches(stitches(spark, d)).select("design_id", F.size("packed").cast("long").alias("n"), F.md5(F.concat_ws(",", F.transform("packed", lambda v: v.cast("string"))).cast("binary")).alias("digest"))


@query(f"{WITH} SELECT design_id, seq, x, y, k FROM stitches")
def unpack_stitches(spark, d):
    return S.unpack_stitches(S.pack_stitches(stitches(spark, d)))


@query("""WITH s AS (SELECT event_id AS design_id, CAST(json_extract(props, '$.k') AS INTEGER) - 20 AS n, event_type FROM events)
SELECT design_id, 0.2 AS cell_mm, CAST(greatest(1, least(16, coalesce(CASE WHEN design_id % 3 = 0 THEN NULL ELSE n END, 8))) AS INTEGER) AS color_count, greatest(0.0, CASE WHEN design_id % 4 = 0 THEN 2.0 ELSE n / 4.0 END) AS min_region_mm2, true AS underlay,
CASE WHEN event_type IN ('click', 'house') THEN event_type ELSE 'house' END AS range_id FROM s""")
def with_settings(spark, d):
    n = F.get_json_object("props", "$.k").cast("int") - 20
    record = F.struct(F.when(F.col("event_id") % 3 != 0, n).alias("color_count"), F.when(F.col("event_id") % 4 != 0, n / 4).alias("min_region_mm2"), F.col("event_type").alias("range_id"))
    df = table(spark, d, "events").select(F.col("event_id").alias("design_id"), F.to_json(record).alias("settings"))
    return S.with_settings(df, ranges=("house", "click")).select("design_id", "cell_mm", "color_count", "min_region_mm2", "underlay", "range_id")


@query(f"""{WITH}, b AS (SELECT design_id, CASE WHEN seq % 50 = 49 THEN seq + 1000000 ELSE seq END AS seq, CASE WHEN seq % 11 = 0 THEN x + 1 ELSE x END AS x, y, k FROM stitches)
SELECT coalesce(a.design_id, b.design_id) AS design_id, count(a.x) AS n_a, count(b.x) AS n_b, count(*) FILTER (a.x IS DISTINCT FROM b.x OR a.y IS DISTINCT FROM b.y OR a.k IS DISTINCT FROM b.k) AS differing
FROM stitches a FULL JOIN b ON a.design_id = b.design_id AND a.seq = b.seq GROUP BY 1""")
def roundtrip_diff(spark, d):
    a = stitches(spark, d)
    moved = {"seq": F.when(F.col("seq") % 50 == 49, F.col("seq") + 1_000_000).otherwise(F.col("seq")), "x": F.when(F.col("seq") % 11 == 0, F.col("x") + 1).otherwise(F.col("x"))}
    return S.roundtrip_diff(a, a.withColumns(moved))


@query(f"""{WITH}, a AS (SELECT design_id, CASE WHEN seq % 7 = 0 THEN x + 1000 ELSE x END AS x, y, k FROM stitches), b AS (SELECT design_id, CASE WHEN seq % 5 = 0 THEN x + 1000 ELSE x END AS x, y, k FROM stitches)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def set_difference(spark, d):
    s = stitches(spark, d)
    side = lambda n: s.withColumn("x", F.when(F.col("seq") % n == 0, F.col("x") + 1000).otherwise(F.col("x"))).drop("seq")
    return S.set_difference(side(7), side(5))


@query(f"{ALL} SELECT design_id, count(DISTINCT thread_id) AS threads FROM design_threads GROUP BY 1")
def distinct_threads(spark, d):
    return design_threads(spark, d).groupBy("design_id").agg(F.count_distinct("thread_id").alias("threads"))


@query("SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace(strip_accents(text), '[^\\x20-\\x7e]', '', 'g'), '\\s+', ' ', 'g')), 16) AS label FROM conversations")
def machine_label(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.machine_label(F.col("text")).alias("label"))


@query("""SELECT page_id, coalesce(nullif(left(regexp_replace(trim(regexp_replace(regexp_replace('..' || url, '[\\\\/:*?"<>|\\x00-\\x1f]+', ' ', 'g'), '\\s+', ' ', 'g')), '^\\.+', ''), 60), ''), 'design') AS name FROM pages""")
def safe_name(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name(F.concat(F.lit(".."), "url")).alias("name"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(list_extract(string_split(url, '/'), -1), '\\.[^.]+$', ''), '\\s+', ' ', 'g')) AS name FROM pages")
def design_name(spark, d):
    return table(spark, d, "pages").select("page_id", T.design_name(F.col("url")).alias("name"))


@query(f"SELECT event_id, CASE WHEN value < 10 THEN printf('%.1f', ceil(value * 2) / 2) ELSE CAST(CAST(ceil(value) AS BIGINT) AS VARCHAR) END AS shown, {LIST_M.format('value')} AS listed FROM events")
def metres(spark, d):
    return table(spark, d, "events").select("event_id", T.metres(F.col("value")).alias("shown"), T.list_metres(F.col("value")).alias("listed"))


@query("SELECT event_id, CAST(ceil((event_id % 9000) / 700.0::DOUBLE + user_id % 7 * 0.5::DOUBLE + event_id % 13 * 0.1::DOUBLE) AS BIGINT) AS minutes FROM events")
def sewing_minutes(spark, d):
    return table(spark, d, "events").select("event_id", T.sewing_minutes(F.col("event_id") % 9000, F.col("user_id") % 7, F.col("event_id") % 13).alias("minutes"))


@query("""SELECT event_id, round(CASE WHEN 120 / a <= 170 THEN 120 ELSE 170 * a END, 1) AS width, round(CASE WHEN 120 / a <= 170 THEN 120 / a ELSE 170 END, 1) AS height
FROM (SELECT event_id, (event_id % 17 + 3) / CAST(event_id % 11 + 2 AS DOUBLE) AS a FROM events)""")
def fit_to_hoop(spark, d):
    size = T.fit_to_hoop((F.col("event_id") % 17 + 3) / (F.col("event_id") % 11 + 2), F.lit(130), F.lit(180))
    return table(spark, d, "events").select("event_id", size.alias("s")).select("event_id", "s.width", "s.height")


@query("SELECT event_id, CAST(round((event_id % 997 - 400) / 8.0::DOUBLE * 10) AS INTEGER) AS units FROM events")
def to_units(spark, d):
    return table(spark, d, "events").select("event_id", T.to_units((F.col("event_id") % 997 - 400) / 8.0).alias("units"))


@query(f"""{WITH}, runs AS (SELECT *, sum(CASE WHEN k <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq) AS run FROM stitches),
steps AS (SELECT design_id, run, sqrt(CAST(x - lag(x) OVER w AS DOUBLE) ** 2 + CAST(y - lag(y) OVER w AS DOUBLE) ** 2) AS m FROM runs WINDOW w AS (PARTITION BY design_id, run ORDER BY seq))
SELECT design_id, CAST(run AS BIGINT) AS run, round(sum(m), 6) AS length FROM steps GROUP BY 1, 2 HAVING count(*) > 1""")
def path_length(spark, d):
    return S.polylines(stitches(spark, d)).select("design_id", "run", F.round(T.path_length(F.col("points")), 6).alias("length"))


@query()
def crc32_manifest(spark, d):
    return S.manifest(table(spark, d, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content")))
