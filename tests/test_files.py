"""Stitch files as a data source: headers alone, pushed-down tests, writes of which one attempt counts."""

import struct

import pytest
from pyspark.sql import functions as F

from seamline.operators import encoding as E
from seamline.sources import pes as S

STITCHES = "design_id long, seq long, x int, y int, k int"


@pytest.fixture
def files(spark):
    rows = [(d, i, *((0, 0) if i == 0 else (10 * i, 5 * d)), 3 if i and i % 3 == 0 and i // 3 <= d else 0) for d in range(4) for i in range(14)]
    s = spark.createDataFrame(rows, STITCHES)
    colours = spark.createDataFrame([(d, b, d + b) for d in range(4) for b in range(d + 1)], "design_id long, block int, machine_index int")
    labels = spark.createDataFrame([(d, f"rose {d}") for d in range(4)], "design_id long, label string")
    return s, E.write_pes(s, colours, labels)


def test_written_files_read_back(spark, files, tmp_path):
    s, pes = files
    path = f"file://{tmp_path}/out"
    S.write_designs(pes.withColumn("path", F.lit("clash")), path)
    whole = S.read_designs(spark, path)
    got = whole.select(F.regexp_extract("path", r"(\d+)\.pes$", 1).cast("long").alias("design_id"), F.posexplode("stitches").alias("seq", "p")).select("design_id", F.col("seq").cast("long"), "p.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, s.collect()))
    assert sorted((r["label"], list(r["colours"]), r["n_colours"], r["error"]) for r in whole.collect()) == [(f"rose {d}", list(range(d, 2 * d + 1)), d + 1, None) for d in range(4)]
    # another write adds files, one that overwrites leaves its own alone
    S.write_designs(pes.where("design_id = 1"), path)
    assert S.read_designs(spark, path, ["label"]).count() == 5
    S.write_designs(pes.where("design_id < 2"), path, "overwrite")
    assert sorted(r["label"] for r in S.read_designs(spark, path, ["label"]).collect()) == ["rose 0", "rose 1"]
    assert not list(tmp_path.rglob("_temporary/*"))


def test_only_attempts_that_count_are_moved(tmp_path):
    w = S._Writer(f"file://{tmp_path}", overwrite=False)
    rows = [{"design_id": d, "pes": b"#PES"} for d in (1, 2)]
    w.write(iter(rows))
    second = w.write(iter(rows))
    w.commit([second, None, w.write(iter([]))])
    assert sorted(p.name for p in tmp_path.rglob("*.pes")) == ["1.pes", "2.pes"] and not list(tmp_path.rglob("_temporary/*"))
    w.write(iter(rows))
    w.abort([None])
    assert len(list(tmp_path.rglob("*.pes"))) == 2


def test_filters_reach_the_reader(spark, files, tmp_path):
    S.write_designs(files[1], f"file://{tmp_path}")
    (tmp_path / "bad.pes").write_bytes(b"nothing")
    df = S.read_designs(spark, f"file://{tmp_path}", S.HEADER_COLUMNS)
    count = lambda test: df.where(test).count()
    assert [count(t) for t in ("n_colours >= 3", "n_colours < 3", "n_colours = 2", "label in ('rose 1', 'rose 3')", "label = 'rose 0' and n_colours > 1", "error is not null", "label is null", "true")] == [2, 2, 1, 2, 0, 1, 1, 5]
    left = df.where("n_colours >= 3 and label like 'rose%'")._jdf.queryExecution().executedPlan().toString()
    assert "n_colours" not in left.partition("Filter")[2].split("\n")[0]


def test_headers_alone_read_no_stitches(tmp_path):
    """A design of 200,000 records: its header takes 12 and 512 bytes of the file."""
    head = b"LA:" + b"long".ljust(16) + b"\r" + b" " * 28 + bytes([1, 7, 9])
    data = b"#PES0001" + struct.pack("<I", 12) + head.ljust(E.HEAD_SIZE, b" ") + bytes(E.STITCH_HEAD) + b"\x01\x02" * 200_000 + b"\xff"
    seen = []

    def read(at, n):
        seen.append(n)
        return data[at : at + n]

    got = E.read_head(read, len(data))
    assert (got["label"], got["colours"], got["x"]) == ("long", [7, 9], None) and sum(seen) == 12 + E.HEAD_SIZE
    assert len(E.read_file(data)["x"]) == 200_000


def test_no_files(spark, tmp_path):
    assert S.read_designs(spark, f"file://{tmp_path}").count() == 0
    S.write_designs(spark.createDataFrame([], "design_id long, pes binary"), f"file://{tmp_path}")
    assert S.read_designs(spark, f"file://{tmp_path}").count() == 0
