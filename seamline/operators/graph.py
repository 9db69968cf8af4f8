"""Connected components over edge tables: local contraction in the tasks, joins and aggregates between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.session import cut, shuffle_partitions

#: Edges that a task holds at once (16 bytes each), and edges a partition.
TASK_EDGES = 1 << 20


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node connected to it by these edges) of all nodes that aren't the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(up := label[label], label):
            label = up
        differ = label[x] != label[y]
        x, y = x[differ], y[differ]
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _contracted(e: DataFrame, roots: bool = False) -> DataFrame:
    """Edges (a, b) to (node, least node) stars within each TASK_EDGES of a partition; with ``roots`` the least nodes' own rows, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> pa.RecordBatch:
            node, least = star_edges(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            if roots:
                own = np.unique(least)
                node, least = np.concatenate([node, own]), np.concatenate([least, own])
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int64())], names=["a", "b"])

        held, n = [], 0
        for t in batches:
            held.append([t.column(c).to_numpy() for c in ("a", "b")])
            n += t.num_rows
            if n >= TASK_EDGES and not roots:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return e.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node it can reach.

    Tasks first contract the edges they hold to stars, so few edges end in one such task. More edges alternate large-star and
    small-star rounds: each links neighbours to the least one they share, so that long chains
    shrink logarithmically and no task ever gathers a component (only counts and minima are aggregated, and large stars
    are joined on the node, where adaptive execution may split a skewed one). Partitions follow the number of edges. Null ends
    and self-loops are ignored. Raises RuntimeError if ``max_rounds`` pass without convergence; partial labels are never returned.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(_contracted(e))
    n, known = _digest(e)
    for _ in range(max_rounds):
        few = -(-n // TASK_EDGES)
        if few <= 1:
            return cut(_contracted(e.coalesce(1), roots=True)).toDF("node", "component")
        parts = min(few, shuffle_partitions(e.sparkSession))
        e = _contracted(e.coalesce(parts))
        # large-star: every larger neighbour of a node is linked to the node's least neighbour (or itself)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: a node and its smaller neighbours are linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        n, now = _digest(e)
        if (n, now) == known:
            break
        known = (n, now)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct().toDF("node", "component"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``node``: 0, 1, 2, ... in the order of the columns ``order``.

    Rows are dealt out by ranges and numbered in each; the ranges' sizes, a number each, tell where the next one begins. The
    result is checkpointed, as another run may draw the ranges elsewhere.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    own = cut(dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    begin, total = [], 0
    for r in own.groupBy("_range").count().orderBy("_range").collect():
        begin.append((r["_range"], total))
        total += r["count"]
    offsets = spark.createDataFrame(begin, "_range int, _begin long")
    return own.join(F.broadcast(offsets), "_range").withColumn("node", F.col("_begin") + F.col("_place")).drop("_range", "_place", "_begin")


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]
