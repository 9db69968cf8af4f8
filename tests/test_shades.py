"""Shades of one colour: one of them is looked at, the earliest."""

from pyspark.sql import functions as F

from seamline.operators import catalogue as K


def test_nearest_of_many_equal_shades(spark):
    t = spark.range(600).selectExpr("concat('t', id) thread_id", "concat('R', id % 2) range_id", "cast(id % 6 * 40 as int) r", "cast(id % 3 * 90 as int) g", "17 b", "cast(1000 - id as int) ord", "id <> 599 matchable")
    assert K._first_shades(t).count() == 6
    colours = spark.range(400).selectExpr("id", "concat('R', id % 3) range_id", "cast(id * 7 % 256 as int) r", "cast(id * 11 % 256 as int) g", "cast(id % 60 as int) b")
    got = {r["id"]: (r["thread_id"], r["delta_e"]) for r in K.nearest_thread(colours, t).collect()}
    best = K.distances(colours, t).groupBy("range_id", "r", "g", "b").agg(F.min(F.struct("d", "ord", "thread_id")).alias("m"))
    want = {r["id"]: (r["thread_id"], r["d"]) for r in colours.join(best, ["range_id", "r", "g", "b"], "left").select("id", "m.thread_id", "m.d").collect()}
    assert got == want and len({v[0] for v in got.values()}) == 7


def test_few_pairs_are_sorted(spark):
    """Of all pairs of colours and shades only those within a colour's least distance are sorted, and boxes meet shades in as many tasks as there are."""
    t = spark.range(600).selectExpr("concat('t', id) thread_id", "'R' range_id", "cast(id * 37 % 256 as int) r", "cast(id * 91 % 256 as int) g", "cast(id * 53 % 256 as int) b", "cast(id as int) ord", "true matchable")
    colours = spark.range(300).selectExpr("'R' range_id", "cast(id * 7 % 256 as int) r", "cast(id * 11 % 256 as int) g", "cast(id % 60 * 4 as int) b").cache()
    n = colours.distinct().count()
    assert n <= K._nearest(colours, t, 1).count() <= 1.1 * n
    shades = K._first_shades(t)
    met = K._met(spark.range(2).selectExpr("'R' range_id", "id box"), shades)
    assert [r["count"] for r in met.groupBy("box").count().collect()] == [shades.count()] * 2
    assert "REPARTITION_BY_NUM" in met._jdf.queryExecution().executedPlan().toString()
