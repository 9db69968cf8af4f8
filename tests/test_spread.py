"""Steps that do much work on few rows, or hold many objects a row: how many tasks and rows they take at once."""

from seamline.operators import encoding
from seamline.operators.needle import needle_order
from seamline.operators.ways import ways_in_mask


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_needle_order_keeps_its_tasks(spark):
    """Adaptive execution must not put the designs of a small table into one task; groups that span batches stay whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(d, g, i, 0.0, 0.0, 0, p, 0, float(p), 0.0, float(p), 0.0) for d in range(5) for g in range(2) for i in range(2) for p in (2, 0, 1)]
        columns = "design_id long, group long, item long, ax double, ay double, phase int, piece long, way int, x0 double, y0 double, x1 double, y1 double"
        out = needle_order(spark.createDataFrame(rows, columns))
        assert "REPARTITION_BY_NUM" in _plan(out)
        got = sorted((r.design_id, r.place, r.group, r.item) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(d, k, k // 6, k // 3 % 2) for d in range(5) for k in range(12)]


def test_ways_keep_their_tasks(spark):
    runs = spark.createDataFrame([(1, 1, y, 0, 9) for y in range(5)], "image_id long, comp_id long, y int, x0 int, x1 int")
    moves = spark.createDataFrame([(k, 1, 1, 0.5, 0.5, 8.5, 3.5) for k in range(6)], "seq long, image_id long, comp_id long, x0 double, y0 double, x1 double, y1 double")
    out = ways_in_mask(moves, runs, 1.0, ["seq"])
    assert "REPARTITION_BY_NUM" in _plan(out) and out.count() == 6


def test_write_pes_holds_few_designs_as_objects(spark, monkeypatch):
    s = spark.createDataFrame([(d, k, 10 * k, d * k, 3 if k == 2 else 0) for d in range(7) for k in range(5)], "design_id long, seq long, x int, y int, k int")
    colours = spark.createDataFrame([(d, b, b + 3) for d in range(6) for b in range(2)], "design_id long, block int, machine_index int")
    labels = spark.createDataFrame([(d, f"no {d}") for d in range(5)], "design_id long, label string")

    def files():
        out = encoding.write_pes(s.coalesce(1), colours, labels)
        assert "MapInArrow" in _plan(out) and "MapInPandas" not in _plan(out)
        return {r.design_id: bytes(r.pes) for r in out.collect()}

    whole = files()
    monkeypatch.setattr(encoding, "PACK_DESIGNS", 2)
    assert files() == whole and len(whole) == 7 and all(f.startswith(b"#PES0001") for f in whole.values())
