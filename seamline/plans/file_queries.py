"""Queries over stitch files: records, blocks, pictures, headers, whole files."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import encoding as P
from seamline.operators import stitch as S
from seamline.plans.adapters import STITCHES, stitches
from seamline.plans.base import query
from seamline.session import own_folder, table
from seamline.sources.pes import HEADER_COLUMNS, read_designs, write_designs

WITH = f"WITH {STITCHES}"
BIG = "big AS (SELECT design_id, seq, x * 17 AS x, y * 23 AS y, k FROM stitches)"
DELTAS = """d AS (SELECT design_id, seq, k, x - lag(x, 1, 0) OVER w AS dx, y - lag(y, 1, 0) OVER w AS dy FROM big WINDOW w AS (PARTITION BY design_id ORDER BY seq)),
n AS (SELECT *, k <> 0 OR greatest(abs(dx), abs(dy)) > 2047 AS long, greatest(1, CAST(ceil(greatest(abs(dx), abs(dy)) / 2047.0::DOUBLE) AS INTEGER)) AS n FROM d),
m AS (SELECT design_id, seq, k, long, step, sign(dx) * (least(abs(dx), 2047 * step) - least(abs(dx), 2047 * (step - 1))) AS dx, sign(dy) * (least(abs(dy), 2047 * step) - least(abs(dy), 2047 * (step - 1))) AS dy,
  CASE WHEN NOT long THEN 0 WHEN k = 2 AND step = 1 THEN 32 ELSE 16 END AS flag FROM (SELECT *, unnest(range(1, n + 1)) AS step FROM n))"""
HEX = "CASE WHEN NOT long AND {0} BETWEEN -64 AND 63 THEN printf('%02X', CAST({0} AS INTEGER) & 127) ELSE printf('%04X', (CAST({0} AS INTEGER) & 4095) | 32768 | (flag << 8)) END"


def big(spark, d):
    return stitches(spark, d).withColumn("x", F.col("x") * 17).withColumn("y", F.col("y") * 23)


@query(f"{WITH}, {BIG}, {DELTAS} SELECT design_id, seq, CAST(step AS INTEGER) AS step, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, flag, long FROM m")
def split_moves(spark, d):
    return P.split_moves(big(spark, d)).drop("k")


@query(f"{WITH}, {BIG}, {DELTAS}, c AS (SELECT design_id, seq, row_number() OVER (PARTITION BY design_id ORDER BY seq) AS i FROM stitches WHERE k = 3) SELECT design_id, seq, CAST(step AS INTEGER) AS step, CASE WHEN i IS NOT NULL AND step = 1 THEN 'FEB00' || CAST(2 - (i - 1) % 2 AS VARCHAR) ELSE '' END || {HEX.format('dx')} || {HEX.format('dy')} AS hex FROM m LEFT JOIN c USING (design_id, seq)")
def pec_deltas(spark, d):
    return P.pec_deltas(big(spark, d)).select("design_id", "seq", "step", "hex")


@query(f"{WITH} SELECT design_id, seq, CAST(2 - (row_number() OVER (PARTITION BY design_id ORDER BY seq) - 1) % 2 AS INTEGER) AS marker FROM stitches WHERE k = 3")
def color_markers(spark, d):
    return P.color_markers(stitches(spark, d))


@query("SELECT event_id, printf('%02X%02X', v & 255, (v >> 8) & 255) AS hex FROM (SELECT event_id, CAST(greatest(-32768, least(32767, event_id * 37 - 40000)) AS INTEGER) & 65535 AS v FROM events)")
def le16_hex(spark, d):
    return table(spark, d, "events").select("event_id", P.le16_hex(F.col("event_id") * 37 - 40000).alias("hex"))


@query(f"""{WITH}, box AS (SELECT design_id, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), 1) AS w, greatest(max(y) - min(y), 1) AS h FROM stitches GROUP BY 1),
s AS (SELECT *, least(38 / CAST(w AS DOUBLE), 28 / CAST(h AS DOUBLE)) AS scale FROM box), b AS (SELECT *, CAST(sum(CASE WHEN k = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq) AS INTEGER) AS block FROM stitches),
p AS (SELECT DISTINCT design_id, unnest([-1, block]) AS block, CAST(trunc(5 + (38 - w * scale) / 2 + (x - x0) * scale) AS INTEGER) AS px, CAST(trunc(5 + (28 - h * scale) / 2 + (y - y0) * scale) AS INTEGER) AS py FROM b JOIN s USING (design_id) WHERE k = 0)
SELECT design_id, block, py, px // 8 AS byte_no, CAST(bit_or(1 << (px % 8)) AS INTEGER) AS value FROM p WHERE px BETWEEN 0 AND 47 AND py BETWEEN 0 AND 37 GROUP BY 1, 2, 3, 4""")
def thumbnails(spark, d):
    return P.thumbnails(stitches(spark, d))


@query(f"""{WITH}, b AS (SELECT design_id, min(x) AS x0, max(x) - min(x) AS width, min(y) AS y0, max(y) - min(y) AS height FROM stitches GROUP BY 1)
SELECT design_id, 1000 - width // 2 AS "left", 1000 - height // 2 AS top, 1000 - width // 2 + width AS "right", 1000 - height // 2 + height AS bottom, width, height, (-x0) & 4095 AS off_x, (-y0) & 4095 AS off_y FROM b""")
def pes_header_fields(spark, d):
    return P.pes_header_fields(stitches(spark, d))


def _files(spark, d):
    s = stitches(spark, d)
    ids = s.select("design_id").distinct()
    colours = S.with_block(s).select("design_id", "block").distinct().withColumn("machine_index", ((F.col("design_id") + F.col("block")) % 64).cast("int"))
    return P.write_pes(s, colours, ids.withColumn("label", F.format_string("design %d", "design_id")))


@query()
def write_pes(spark, d):
    return _files(spark, d).select("design_id", F.octet_length("pes").alias("n_bytes"), F.sha1("pes").alias("sha1"))


@query(f"""{WITH}, m AS (SELECT design_id, seq, k, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y FROM stitches WINDOW w AS (PARTITION BY design_id ORDER BY seq)) SELECT design_id, seq, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, k FROM m""")
def round_trip(spark, d):
    """Write every design as a file and decode it again: its stitches from the origin."""
    files = _files(spark, d).select(F.col("design_id").cast("string").alias("path"), F.col("pes").alias("content"))
    rows = P.decode_pes(files).select(F.col("path").cast("long").alias("design_id"), F.posexplode("stitches").alias("seq", "p"))
    return rows.select("design_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y", "p.k")


@query(f"""{WITH}, b AS (SELECT design_id, CAST(sum(CASE WHEN k = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq) AS INTEGER) AS block FROM stitches),
d AS (SELECT DISTINCT design_id, block FROM b), c AS (SELECT design_id, count(*) AS n, string_agg(CAST((design_id + block) % 64 AS VARCHAR), ',' ORDER BY block) AS colours FROM d GROUP BY 1)
SELECT design_id, 'design ' || design_id AS label, CAST(n AS INTEGER) AS n_colours, colours FROM c WHERE n BETWEEN 2 AND 255""")
def file_headers(spark, d):
    """Every design as a file on disk; then headers alone, of files of at least two colours, which the reader picks."""
    path = own_folder(spark, "designs")
    write_designs(_files(spark, d), path)
    heads = read_designs(spark, path, HEADER_COLUMNS).where("n_colours >= 2 and error is null")
    return heads.select(F.regexp_extract("path", r"(-?\d+)\.pes$", 1).cast("long").alias("design_id"), "label", "n_colours", F.concat_ws(",", F.col("colours").cast("array<string>")).alias("colours"))


@query()
def pes_blocks(spark, d):
    return P.pes_blocks(stitches(spark, d)).select("design_id", "run", "chunk", "kind", "block", F.size("points").alias("n"))
