"""One very long stitch log, scanned in two levels: all order lines as one design."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import long_logs as W
from seamline.operators.graph import numbered
from seamline.plans.adapters import PARTS
from seamline.plans.base import query
from seamline.session import table

LOG = """log AS (SELECT 7 AS design_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) - 1 AS seq,
  CAST((l_partkey * 13 + l_linenumber * 7) % 3001 - 1500 AS INTEGER) AS x, CAST((l_partkey * 29 + l_orderkey) % 5003 - 2500 AS INTEGER) AS y,
  CAST(CASE WHEN (l_partkey + l_linenumber) % 17 = 0 THEN 3 WHEN l_returnflag = 'R' AND l_partkey % 3 = 0 THEN 2 WHEN l_returnflag = 'A' AND l_partkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS k FROM lineitem)"""


def long_log(spark, d):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    k = F.when((p + n) % 17 == 0, 3).when((F.col("l_returnflag") == "R") & (p % 3 == 0), 2).when((F.col("l_returnflag") == "A") & (p % 5 == 0), 1).otherwise(0)
    rows = numbered(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return rows.select(F.lit(7).alias("design_id"), F.col("node").alias("seq"), ((p * 13 + n * 7) % 3001 - 1500).cast("int").alias("x"), ((p * 29 + F.col("l_orderkey")) % 5003 - 2500).cast("int").alias("y"), k.cast("int").alias("k"))


@query(f"""WITH {LOG} SELECT design_id, seq, CAST(sum(CASE WHEN k = 3 THEN 1 ELSE 0 END) OVER w AS INTEGER) AS block, CAST(sum(CASE WHEN k <> 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS run,
  round(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 5) AS move FROM log WINDOW w AS (PARTITION BY design_id ORDER BY seq)""")
def long_blocks_and_moves(spark, d):
    """Colour block, polyline and move length of every record of the log."""
    s = W.with_move(W.with_runs(W.with_block(long_log(spark, d))))
    return s.select("design_id", "seq", "block", F.col("run").cast("long").alias("run"), F.round("move", 5).alias("move"))


@query(f"WITH {LOG} SELECT design_id, seq, CAST(sum(x) OVER w AS INTEGER) AS x, CAST(sum(y) OVER w AS INTEGER) AS y FROM log WINDOW w AS (PARTITION BY design_id ORDER BY seq)")
def long_absolute_positions(spark, d):
    deltas = long_log(spark, d).withColumnsRenamed({"x": "dx", "y": "dy"})
    return W.absolute_positions(deltas).select("design_id", "seq", "x", "y")


@query(f"WITH {LOG}, coarse AS (SELECT design_id, seq, x // 1501 AS x, y // 2503 AS y, k FROM (SELECT design_id, seq, x + 1500 AS x, y + 2500 AS y, k FROM log)), old AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(k) OVER w AS pk FROM coarse WINDOW w AS (PARTITION BY design_id ORDER BY seq)) SELECT design_id, seq, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, k FROM old WHERE NOT coalesce(k = 0 AND pk = 0 AND px = x AND py = y, false)")
def long_dedupe_stitches(spark, d):
    coarse = long_log(spark, d).withColumns({"x": F.floor((F.col("x") + 1500) / 1501).cast("int"), "y": F.floor((F.col("y") + 2500) / 2503).cast("int")})
    return W.dedupe_stitches(coarse)


@query(f"WITH {LOG}, p AS (SELECT design_id, seq, 't-' || ((x + 1500) // 1000) AS thread_id FROM log), c AS (SELECT *, CASE WHEN lag(thread_id) OVER w <> thread_id THEN 1 ELSE 0 END AS c FROM p WINDOW w AS (PARTITION BY design_id ORDER BY seq)) SELECT design_id, seq, thread_id, CAST(sum(c) OVER (PARTITION BY design_id ORDER BY seq) AS INTEGER) AS block FROM c")
def long_thread_sequence(spark, d):
    pieces = long_log(spark, d).select("design_id", "seq", F.concat(F.lit("t-"), F.floor((F.col("x") + 1500) / 1000)).alias("thread_id"))
    return W.thread_sequence(pieces)


@query(f"""WITH {LOG}, m AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS move, coalesce(lag(k) OVER w IN (0, 1), false) AS live, sum(CASE WHEN k = 3 THEN 1 ELSE 0 END) OVER w AS block FROM log WINDOW w AS (PARTITION BY design_id ORDER BY seq)),
u AS (SELECT design_id, block, sum(CASE WHEN live AND k = 0 THEN move / 10 + 2.4::DOUBLE WHEN k = 0 THEN 80.0::DOUBLE WHEN live AND k = 1 THEN move / 10 ELSE 0 END) / 1000 AS top_m, sum(CASE WHEN k = 0 AND NOT live THEN 1 ELSE 0 END) AS runs FROM m GROUP BY 1, 2),
each_ AS (SELECT design_id, CAST(block AS INTEGER) AS block, top_m, runs FROM u UNION ALL SELECT design_id, NULL, sum(top_m), sum(runs) FROM u GROUP BY 1)
SELECT design_id, block, round(top_m, 4) AS top_m, round(top_m * 0.4::DOUBLE, 4) AS bobbin_m, CAST(runs AS BIGINT) AS runs FROM each_""")
def long_thread_usage(spark, d):
    s = long_log(spark, d)
    blocks = s.groupBy("design_id").agg(F.count_if(F.col("k") == 3).alias("n")).select("design_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("block"))
    named = blocks.withColumn("thread_id", F.concat(F.lit("t-"), F.col("block") % PARTS))
    return W.thread_usage(s, named).select("design_id", "block", F.round("top_m", 4).alias("top_m"), F.round("bobbin_m", 4).alias("bobbin_m"), F.col("runs").cast("long").alias("runs"))


@query(f"""WITH {LOG}, m AS (SELECT design_id, seq, k, x - lag(x, 1, 0) OVER w AS dx, y - lag(y, 1, 0) OVER w AS dy, sum(CASE WHEN k = 3 THEN 1 ELSE 0 END) OVER w AS n FROM log WINDOW w AS (PARTITION BY design_id ORDER BY seq)),
f AS (SELECT *, k <> 0 OR greatest(abs(dx), abs(dy)) > 2047 AS "long", unnest(range(1, greatest(1, CAST(ceil(greatest(abs(dx), abs(dy)) / 2047.0::DOUBLE) AS INTEGER)) + 1)) AS step FROM m),
s AS (SELECT design_id, seq, CAST(step AS INTEGER) AS step, k, "long", n, CAST(sign(dx) * (least(abs(dx), 2047 * step) - least(abs(dx), 2047 * (step - 1))) AS INTEGER) AS dx, CAST(sign(dy) * (least(abs(dy), 2047 * step) - least(abs(dy), 2047 * (step - 1))) AS INTEGER) AS dy,
  CASE WHEN NOT "long" THEN 0 WHEN k = 2 AND step = 1 THEN 32 ELSE 16 END AS flag FROM f)
SELECT design_id, seq, step, dx, dy, k, CAST(flag AS INTEGER) AS flag, CASE WHEN k = 3 AND step = 1 THEN 1 + n % 2 END AS marker FROM s""")
def long_pec_deltas(spark, d):
    """Steps of the log's moves, with the mark of each colour change."""
    rows = W.pec_deltas(long_log(spark, d))
    marker = F.when(F.startswith("hex", F.lit("FEB0")) & (F.col("k") == 3) & (F.col("step") == 1), F.substring("hex", 5, 2).cast("long"))
    return rows.select("design_id", "seq", "step", "dx", "dy", "k", "flag", marker.alias("marker"))
