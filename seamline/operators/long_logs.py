"""Ordered stitch logs of any length: the scans of ``stitch`` and ``encoding`` in two levels.

A log is cut at multiples of CHUNK of its ``seq``. Each chunk is scanned on its own; its digest, one row (sums, last record), is scanned over the
log, and what comes from the chunks before joins back. A log of n records makes tasks of CHUNK records and one of n / CHUNK digests, so a design
that holds most of all records is spread like any other. Results are those of the plain functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators import encoding as E
from seamline.operators import stitch as S

#: Numbers of ``seq`` in a chunk.
CHUNK = 1 << 14


def carried(rows: DataFrame, sums: dict[str, Column], last: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """``rows`` (design_id, seq, ...) with a running sum for each of ``sums``, and for each column c of ``last`` its value in the record before, ``before_c``."""
    rows = rows.withColumns({"_chunk": F.floor(F.col("seq") / chunk), **{f"_v_{n}": e for n, e in sums.items()}})
    own = Window.partitionBy("design_id", "_chunk").orderBy("seq")
    over = Window.partitionBy("design_id").orderBy("_chunk")
    digest = rows.groupBy("design_id", "_chunk").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums), F.max(F.struct("seq", *last)).alias("_last"))
    earlier = [F.coalesce(F.sum(f"_s_{n}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_c_{n}") for n in sums]
    carry = digest.select("design_id", "_chunk", *earlier, F.lag("_last").over(over).alias("_from"))
    out = rows.join(carry, ["design_id", "_chunk"])
    out = out.withColumns({n: F.col(f"_c_{n}") + F.sum(f"_v_{n}").over(own.rowsBetween(Window.unboundedPreceding, 0)) for n in sums})
    if last:
        before = F.coalesce(F.lag(F.struct("seq", *last)).over(own), F.col("_from"))
        out = out.withColumn("_before", before).withColumns({f"before_{c}": F.col(f"_before.{c}") for c in last}).drop("_before")
    return out.drop("_chunk", "_from", *(f"_{p}_{n}" for n in sums for p in "vc"))


def _is(k: int) -> Column:
    return F.when(F.col("k") == k, 1).otherwise(0)


def with_block(s: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """See ``stitch.with_block``."""
    return carried(s, {"block": _is(S.COLOR)}, chunk=chunk).withColumn("block", F.col("block").cast("int"))


def with_runs(s: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """See ``stitch.with_runs``."""
    return carried(s, {"run": F.when(F.col("k") != S.STITCH, 1).otherwise(0)}, chunk=chunk)


def with_move(s: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """See ``stitch.with_move``."""
    return carried(s, {}, ("x", "y"), chunk).withColumn("move", F.hypot(F.col("x") - F.col("before_x"), F.col("y") - F.col("before_y"))).drop("before_x", "before_y")


def absolute_positions(deltas: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """See ``stitch.absolute_positions``."""
    return carried(deltas, {"x": F.col("dx"), "y": F.col("dy")}, chunk=chunk).withColumns({c: F.col(c).cast("int") for c in "xy"})


def dedupe_stitches(s: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """See ``stitch.dedupe_stitches``."""
    same = (F.col("k") == S.STITCH) & (F.col("before_k") == S.STITCH) & (F.col("before_x") == F.col("x")) & (F.col("before_y") == F.col("y"))
    return carried(s, {}, ("x", "y", "k"), chunk).where(~F.coalesce(same, F.lit(False))).drop("before_x", "before_y", "before_k")


def thread_sequence(pieces: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """See ``stitch.thread_sequence``."""
    rows = carried(pieces, {}, ("thread_id",), chunk)
    change = F.coalesce((F.col("before_thread_id") != F.col("thread_id")).cast("int"), F.lit(0))
    return carried(rows, {"block": change}, chunk=chunk).withColumn("block", F.col("block").cast("int")).drop("before_thread_id")


def thread_usage(s: DataFrame, design_threads: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """See ``stitch.thread_usage``."""
    rows = carried(s, {"block": _is(S.COLOR)}, ("x", "y", "k"), chunk).withColumn("block", F.col("block").cast("int"))
    rows = rows.withColumn("move", F.hypot(F.col("x") - F.col("before_x"), F.col("y") - F.col("before_y")))
    return S.usage_by_block(S.thread_taken(rows, F.col("before_k")), design_threads)


def pec_deltas(s: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """See ``encoding.pec_deltas``."""
    rows = carried(s, {"block": _is(S.COLOR)}, ("x", "y"), chunk)
    delta = lambda c: F.col(c) - F.coalesce(F.col(f"before_{c}"), F.lit(0))
    return E.with_bytes(E.in_steps(rows.select("design_id", "seq", "k", delta("x").alias("dx"), delta("y").alias("dy"), "block")), F.col("block")).drop("block")
