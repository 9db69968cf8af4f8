"""The nearest shades by boxes of colours, against all pairs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.operators import catalogue as K


def _tables(spark):
    t = spark.range(900).selectExpr(
        "concat('t', id) thread_id", "case when id < 3 then 'R0' else concat('R', 1 + id % 2) end range_id", "cast(id * 73 % 256 as int) r", "cast((id * 17 + id % 50 * 41) % 256 as int) g",
        "cast(id % 7 * 40 as int) b", "cast(1000 - id % 300 * 3 - id div 300 as int) ord", "id % 64 < 61 matchable",
    )
    t = t.unionByName(t.where("ord % 4 = 0").withColumns({"thread_id": F.concat(F.lit("u"), "thread_id"), "ord": F.col("ord") + 5000}))
    return spark.range(700).selectExpr("concat('R', id % 4) range_id", "cast(id * 7 % 256 as int) r", "cast(id * 11 % 256 as int) g", "cast(id % 60 * 4 as int) b"), t


def test_same_as_all_pairs(spark):
    colours, t = _tables(spark)
    w = Window.partitionBy("range_id", "r", "g", "b").orderBy("d", "ord")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for n in (1, 3):
        want = K.distances(colours, t).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("range_id", "r", "g", "b", "place", "thread_id", "d")
        got = rows(K.top_threads(colours, t, n))
        assert got == rows(want) and len({r[0] for r in got}) == 3


def test_pairs_left_to_rank_are_few(spark):
    colours, t = _tables(spark)
    assert K._nearest(colours, t, 3).count() * 10 < K.distances(colours, t).count()


def test_no_pair_is_nearer_than_its_bound(spark):
    lab = spark.range(2500).selectExpr("named_struct('l', rand(1) * 100, 'a', rand(2) * 240 - 120, 'b', rand(3) * 240 - 120) _p", "id % 50 g")
    pairs = lab.join(lab.selectExpr("_p _q", "g"), "g")
    pairs = K.with_delta_e2000(pairs, "_p", "_q", "d").withColumn("weight", K._plane_weight((F.hypot("_p.a", "_p.b") + F.hypot("_q.a", "_q.b")) / 2))
    rows = pairs.select("d", F.sqrt(K._at_least(F.col("_p"), F.col("_p"), F.col("weight"), F.col("_q"))).alias("low")).toPandas()
    assert (rows.low <= rows.d + 1e-6).all() and (rows.low > rows.d / 4).sum() > 50_000
