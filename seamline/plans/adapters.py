"""Stitch, thread, pixel and cell tables derived from the shared test tables, with the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamline.session import table

#: Pixels of an image row, and the grid cell in mm.
WIDTH, CELL_MM = 24, 0.2
PARTS = 200


def stitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(design_id, seq, x, y, k): a user's events in time order as an ordered stitch log."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.when(F.col("event_id") % 17 == 0, 3).when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), 2).when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), 1).otherwise(0)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("design_id"),
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        ((F.col("event_id") * 13) % 401 - 200).cast("int").alias("x"),
        ((F.col("event_id") * 29) % 301 - 150).cast("int").alias("y"),
        k.cast("int").alias("k"),
    )


STITCHES = """stitches AS (SELECT user_id AS design_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  CAST((event_id * 13) % 401 - 200 AS INTEGER) AS x, CAST((event_id * 29) % 301 - 150 AS INTEGER) AS y,
  CAST(CASE WHEN event_id % 17 = 0 THEN 3 WHEN event_type = 'error' AND event_id % 3 = 0 THEN 2 WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS k FROM events)"""


def design_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(design_id, block, thread_id): a thread for every colour block of a design."""
    last = stitches(spark, sf_dir).groupBy("design_id").agg(F.count_if(F.col("k") == 3).cast("int").alias("n"))
    rows = last.select("design_id", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("block"))
    return rows.withColumn("thread_id", F.concat(F.lit("t-"), (F.col("design_id") * 7 + F.col("block") * 13) % PARTS))


DESIGN_THREADS = f"""design_threads AS (SELECT design_id, block, 't-' || ((design_id * 7 + block * 13) % {PARTS}) AS thread_id FROM
  (SELECT design_id, unnest(range(0, n + 1)) AS block FROM (SELECT design_id, CAST(count(*) FILTER (k = 3) AS INTEGER) AS n FROM stitches GROUP BY design_id)))"""


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: (thread_id, range_id, maker, brand, code, name, r, g, b, ord, matchable, machine_index)."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("t-"), p).alias("thread_id"),
        F.col("p_brand").alias("range_id"),
        F.substring("p_brand", 1, 7).alias("maker"),
        F.col("p_brand").alias("brand"),
        p.cast("string").alias("code"),
        F.col("p_name").alias("name"),
        ((p * 73) % 256).cast("int").alias("r"),
        ((F.col("p_size") * 41 + p * 17) % 256).cast("int").alias("g"),
        ((p * 151 + F.col("p_size")) % 256).cast("int").alias("b"),
        p.cast("int").alias("ord"),
        (p % 64 < 61).alias("matchable"),
        (p % 64).cast("int").alias("machine_index"),
    )


THREADS = """threads AS (SELECT 't-' || p_partkey AS thread_id, p_brand AS range_id, substr(p_brand, 1, 7) AS maker, p_brand AS brand, CAST(p_partkey AS VARCHAR) AS code, p_name AS name,
  CAST((p_partkey * 73) % 256 AS INTEGER) AS r, CAST((p_size * 41 + p_partkey * 17) % 256 AS INTEGER) AS g, CAST((p_partkey * 151 + p_size) % 256 AS INTEGER) AS b,
  CAST(p_partkey AS INTEGER) AS ord, p_partkey % 64 < 61 AS matchable, CAST(p_partkey % 64 AS INTEGER) AS machine_index FROM part)"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return table(spark, sf_dir, "lineitem").withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


_POS = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) - 1 AS INTEGER) AS pos FROM lineitem)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, r, g, b, a): a supplier's order lines as an image of WIDTH columns."""
    p = F.col("l_partkey")
    return _positions(spark, sf_dir).select(
        F.col("l_suppkey").alias("image_id"),
        (F.col("pos") % WIDTH).alias("x"),
        F.floor(F.col("pos") / WIDTH).cast("int").alias("y"),
        ((p * 73) % 256).cast("int").alias("r"),
        ((p * 31) % 256).cast("int").alias("g"),
        ((p * 11 + F.col("l_linenumber")) % 256).cast("int").alias("b"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), 0).otherwise(255).alias("a"),
    )


PIXELS = f"""pixels AS (SELECT l_suppkey AS image_id, pos % {WIDTH} AS x, pos // {WIDTH} AS y, CAST((l_partkey * 73) % 256 AS INTEGER) AS r, CAST((l_partkey * 31) % 256 AS INTEGER) AS g,
  CAST((l_partkey * 11 + l_linenumber) % 256 AS INTEGER) AS b, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 0 ELSE 255 END AS a FROM {_POS})"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, label): a quantized grid of full rows; -1 is transparent."""
    n = F.count("*").over(Window.partitionBy("l_suppkey"))
    rows = _positions(spark, sf_dir).withColumn("n", n).where(F.col("pos") < WIDTH * F.floor(F.col("n") / WIDTH))
    x, y = F.col("pos") % WIDTH, F.floor(F.col("pos") / WIDTH)
    label = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), -1).when(F.col("l_linenumber") == 7, F.col("l_partkey") % 4).otherwise((F.floor(x / 6) + F.floor(y / 5) + F.col("l_suppkey")) % 4)
    return rows.select(F.col("l_suppkey").alias("image_id"), x.cast("int").alias("x"), y.cast("int").alias("y"), label.cast("int").alias("label"))


CELLS = f"""cells AS (SELECT l_suppkey AS image_id, pos % {WIDTH} AS x, pos // {WIDTH} AS y,
  CAST(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -1 WHEN l_linenumber = 7 THEN l_partkey % 4 ELSE ((pos % {WIDTH}) // 6 + (pos // {WIDTH}) // 5 + l_suppkey) % 4 END AS INTEGER) AS label
  FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS n FROM {_POS}) WHERE pos < {WIDTH} * (n // {WIDTH}))"""


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, cluster, thread_id, enabled): a thread for each label of an image; labels 0 and 2 of every third image share one."""
    ids = cells(spark, sf_dir).where("label >= 0").select("image_id", F.col("label").alias("cluster")).distinct()
    key = F.when((F.col("image_id") % 3 == 0) & (F.col("cluster") == 2), 0).otherwise(F.col("cluster"))
    return ids.select("image_id", "cluster", F.concat(F.lit("t-"), (F.col("image_id") * 5 + key * 31) % PARTS).alias("thread_id"), ((F.col("image_id") + F.col("cluster")) % 7 != 0).alias("enabled"))


CHOICES = f"""choices AS (SELECT image_id, cluster, 't-' || ((image_id * 5 + CASE WHEN image_id % 3 = 0 AND cluster = 2 THEN 0 ELSE cluster END * 31) % {PARTS}) AS thread_id,
  (image_id + cluster) % 7 <> 0 AS enabled FROM (SELECT DISTINCT image_id, label AS cluster FROM cells WHERE label >= 0))"""


def packed(design: str, place: str) -> Column:
    """design * 100000 + place; a place that would run into the next design's numbers raises an error."""
    fits = F.col(place).between(0, 99_999)
    return F.when(fits, F.col(design) * 100000 + F.col(place)).otherwise(F.raise_error(F.concat(F.lit("packed: no room for design, place "), F.concat_ws(", ", design, place))).cast("long"))


def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, seq, x, y): the sewn runs of two points or more, in mm; path_id is design_id * 100000 + run."""
    from seamline.operators.stitch import with_runs

    runs = with_runs(stitches(spark, sf_dir))
    size = F.count("*").over(Window.partitionBy("design_id", "run"))
    place = F.row_number().over(Window.partitionBy("design_id", "run").orderBy("seq")) - 1
    runs = runs.withColumn("n", size).where("n > 1")
    return runs.select(packed("design_id", "run").alias("path_id"), place.cast("int").alias("seq"), (F.col("x") / 10.0).alias("x"), (F.col("y") / 10.0).alias("y"))


PATH_POINTS = """runs AS (SELECT *, CAST(sum(CASE WHEN k <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq) AS BIGINT) AS run FROM stitches),
path_points AS (SELECT design_id * 100000 + run AS path_id, CAST(row_number() OVER (PARTITION BY design_id, run ORDER BY seq) - 1 AS INTEGER) AS seq, x / 10.0::DOUBLE AS x, y / 10.0::DOUBLE AS y
  FROM (SELECT *, count(*) OVER (PARTITION BY design_id, run) AS n FROM runs) WHERE n > 1)"""
