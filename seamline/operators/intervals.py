"""Overlaps of intervals in sorted order: one window over merged starts, never all pairs of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, key: list[str], reach: int = 0) -> DataFrame:
    """(a, b): ids of the intervals (*key, lo, hi, id) of the two sides that overlap, or lie within ``reach`` of each other.

    Intervals of one side and key must be more than ``reach`` apart, as maximal runs are. Of an overlapping pair one starts first, and it is the last
    of its side that does so: in the order of starts each interval meets one candidate, so there are as many candidates as intervals.
    """
    both = a.select(*key, "lo", "hi", F.col("id").alias("a"), F.lit(None).cast(b.schema["id"].dataType).alias("b")).unionByName(b.select(*key, "lo", "hi", F.lit(None).cast(a.schema["id"].dataType).alias("a"), F.col("id").alias("b")))
    w = Window.partitionBy(*key).orderBy("lo", F.col("a").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(F.col(c).isNotNull(), F.struct("hi", c)), ignorenulls=True).over(w)
    met = both.withColumns({"_a": last("a"), "_b": last("b")})
    other = F.when(F.col("a").isNotNull(), F.col("_b.hi")).otherwise(F.col("_a.hi"))
    return met.where(F.col("lo") <= other + reach).select(F.coalesce("a", "_a.a").alias("a"), F.coalesce("b", "_b.b").alias("b"))


def sole_pairs(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(a, b): ids of the intervals (*key, lo, hi, id) that overlap (by more than an end point) just each other, no other of the other side.

    Intervals of one side may overlap if their starts and ends have one order. An interval overlaps as many of the other side as start before its end, less those that end
    before its start: counts up to a place in the merged order of all ends.
    """
    pairs = _only(a, b, key).select(F.col("id").alias("a"), F.col("partner").alias("b"))
    back = _only(b, a, key).select(F.col("id").alias("b"), F.col("partner").alias("a"))
    return pairs.join(back, ["a", "b"])


def _only(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(id, partner) of the intervals of ``a`` that overlap one of ``b``."""
    none = F.lit(None).cast(b.schema["id"].dataType)
    event = lambda at, order, asks, other: F.struct(F.col(at).cast("double").alias("at"), F.lit(order).alias("order"), F.lit(asks).alias("asks"), other.alias("other"))
    asked = a.select(*key, "id", F.explode(F.array(event("hi", 0, "hi", none), event("lo", 2, "lo", none))).alias("e"))
    given = b.select(*key, F.lit(None).cast(a.schema["id"].dataType).alias("id"), F.explode(F.array(event("lo", 1, "start", F.col("id")), event("hi", 0, "end", F.col("id")))).alias("e"))
    rows = asked.unionByName(given).select(*key, "id", "e.*")
    w = Window.partitionBy(*key).orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda kind: F.count_if(F.col("asks") == kind).over(w)
    rows = rows.withColumns({"started": so_far("start"), "ended": so_far("end"), "partner": F.last(F.when(F.col("asks") == "start", F.col("other")), ignorenulls=True).over(w)})
    at = lambda kind, c: F.max(F.when(F.col("asks") == kind, F.col(c)))
    one = rows.where("id is not null").groupBy("id").agg((at("hi", "started") - at("lo", "ended")).alias("n"), at("hi", "partner").alias("partner"))
    return one.where("n = 1").select("id", "partner")


def as_intervals(rows: DataFrame, key: list[str], lo: str, hi: str, id_: str | Column) -> DataFrame:
    return rows.select(*key, F.col(lo).alias("lo"), F.col(hi).alias("hi"), (F.col(id_) if isinstance(id_, str) else id_).alias("id"))
