"""Connected runs of cells by strips of rows: a task joins what touches within a strip, many strips at a time; only runs on both sides of a border between strips meet in joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seamline.operators.graph import components, star_edges
from seamline.operators.intervals import as_intervals, overlaps
from seamline.session import kept

#: Rows of a strip, as a power of 2 (the first strip has the row above an image, too), and table rows of whole strips that a task holds at once; more if one strip has more.
STRIP, BATCH_ROWS = 6, 1 << 18


def in_strips(rows: DataFrame, key: list[str], x: str, f: Callable[[pa.Table, int], pa.Table], schema: StructType | str, lap: bool = False) -> DataFrame:
    """``f`` of tables of whole strips, sorted by ``key``, y and ``x``: a strip is dealt to one task, so a large image goes to many. ``f`` gets a number, too: those from it on, up to four a row, are the table's own.

    With ``lap`` the last row of a strip is dealt to the next one as well, and ``f`` finds the strip in column _strip: each two neighbouring rows then meet once.
    """
    strip = F.shiftright(F.col("y") + 1, STRIP)
    if not lap:
        return in_groups(rows, [*key, strip], [*key, "y", x], lambda t: [*(t[c].to_numpy() for c in key), t["y"].to_numpy() + 1 >> STRIP], f, schema)
    last = (F.col("y") + 1).bitwiseAND((1 << STRIP) - 1) == (1 << STRIP) - 1
    rows = rows.withColumn("_strip", F.explode(F.when(last, F.array(strip, strip + 1)).otherwise(F.array(strip))))
    dealt = [*key, "_strip"]
    return in_groups(rows, dealt, [*dealt, "y", x], lambda t: [t[c].to_numpy() for c in dealt], f, schema)


def in_groups(rows: DataFrame, dealt: list[str | Column], order: list[str], of: Callable[[pa.Table], list[np.ndarray]], f: Callable[[pa.Table, int], pa.Table], schema: StructType | str) -> DataFrame:
    """``f`` of tables of whole groups, many at a time: rows dealt by ``dealt`` and sorted by ``order``; rows of one group agree in all columns ``of`` a table. See ``in_strips`` for the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, base = [], 0, TaskContext.get().partitionId() << 40
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BATCH_ROWS:  # all but the last group, which may go on
                t = pa.Table.from_batches(held)
                others = np.flatnonzero(np.any([c != c[-1] for c in of(t)], axis=0))
                end = int(others[-1]) + 1 if len(others) else 0
                if end:
                    yield from f(t.slice(0, end), base).to_batches()
                base += 4 * end
                held, n = t.slice(end).to_batches(), n - end
        if n:
            yield from f(pa.Table.from_batches(held), base).to_batches()

    return rows.repartition(*dealt).sortWithinPartitions(*order).mapInArrow(run, schema)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether any column differs from the row before; true for the first row."""
    return np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))


def touching(key: list[np.ndarray], y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): places of sorted runs b and those, a, of the same ``key`` in the row before that overlap or lie within ``reach``."""
    begins = changes(*key, y)
    row, first = np.cumsum(begins), np.flatnonzero(begins)
    before = np.append(0, first[:-1])
    follows = ~changes(*key)[first] & (y[first] == y[before] + 1)
    low = x0.min() - 2
    wide = int(x1.max() - low) + 3
    # a run's neighbours in the row before follow one another: from the first that ends behind its start to the last that starts before its end
    above = (row - 1) * wide - low
    since = np.searchsorted(row * wide + x1 - low, above + x0 - reach, "left")
    till = np.searchsorted(row * wide + x0 - low, above + x1 + reach, "right")
    n = np.where(follows[row - 1], np.maximum(till - since, 0), 0)
    b = np.repeat(np.arange(len(y)), n)
    return np.arange(len(b)) - np.repeat(np.cumsum(n) - n - since, n), b


def first_touching(key: list[np.ndarray], y: np.ndarray, x0: np.ndarray, x1: np.ndarray, label: np.ndarray | None, reach: int) -> np.ndarray:
    """Of sorted runs of whole strips, the place of the first run that each is connected with inside its strip: runs of one label in neighbouring rows that overlap or lie within ``reach``."""
    a, b = touching([*key, y + 1 >> STRIP], y, x0, x1, reach)
    if label is not None:
        same = label[a] == label[b]
        a, b = a[same], b[same]
    out = np.arange(len(y))
    node, least = star_edges(a, b)
    out[node] = least
    return out


def run_ends(image: np.ndarray, y: np.ndarray, label: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and the last cell of each run of sorted cells."""
    first = np.flatnonzero(changes(image, y, label, x - np.arange(len(x))))
    return first, np.append(first[1:], len(x)) - 1


def plain_runs(cells: DataFrame) -> DataFrame:
    """(image_id, y, label, x0, x1): maximal runs of one label in a row of ``cells``."""

    def runs(t: pa.Table, _: int) -> pa.Table:
        image, y, label, x = (t[c].to_numpy() for c in ("image_id", "y", "label", "x"))
        first, last = run_ends(image, y, label, x)
        return pa.table({"image_id": image[first], "y": y[first], "label": label[first], "x0": x[first], "x1": x[last]})

    of = {c: cells.schema[c].dataType for c in ("image_id", "y", "label", "x")}
    schema = StructType([StructField(n, of[c]) for n, c in (("image_id", "image_id"), ("y", "y"), ("label", "label"), ("x0", "x"), ("x1", "x"))])
    return in_strips(cells.select("image_id", "y", "label", "x"), ["image_id"], "x", runs, schema)


def connected_runs(cells: DataFrame, reach: int) -> DataFrame:
    """(image_id, y, label, x0, x1, root_y, root_x0): maximal runs of one label in a row of ``cells``, with the first run they are connected with inside their strip."""

    def runs(t: pa.Table, _: int) -> pa.Table:
        image, y, label, x = (t[c].to_numpy() for c in ("image_id", "y", "label", "x"))
        first, last = run_ends(image, y, label, x)
        at = first[first_touching([image[first]], y[first], x[first], x[last], label[first], reach)]
        out = {"image_id": image[first], "y": y[first], "label": label[first], "x0": x[first], "x1": x[last], "root_y": y[at], "root_x0": x[at]}
        return pa.table(out)

    of = {c: cells.schema[c].dataType for c in ("image_id", "y", "label", "x")}
    schema = StructType([StructField(n, of[c]) for n, c in (("image_id", "image_id"), ("y", "y"), ("label", "label"), ("x0", "x"), ("x1", "x"), ("root_y", "y"), ("root_x0", "x"))])
    return in_strips(cells.select("image_id", "y", "label", "x"), ["image_id"], "x", runs, schema)


def row_pairs(runs: DataFrame, reach: int) -> DataFrame:
    """(a, b): numbers of the runs (image_id, label, y, x0, x1, node) of one label that touch in neighbouring rows, b in the row before; within ``reach`` counts as touching."""

    def pairs(t: pa.Table, _: int) -> pa.Table:
        strip, label, image, y, x0, x1, node = (t[c].to_numpy() for c in ("_strip", "label", "image_id", "y", "x0", "x1", "node"))
        above, here = touching([image, label, strip], y, x0, x1, reach)
        return pa.table({"a": node[here], "b": node[above]})

    return in_strips(runs.select("image_id", "label", "y", "x0", "x1", "node"), ["image_id", "label"], "x0", pairs, "a long, b long", lap=True)


def neighbours(runs: DataFrame) -> DataFrame:
    """(image_id, a, b), a < b, of a strip each: components of ``runs`` (image_id, y, x0, x1, comp_id), which don't overlap, that share a cell side."""

    def meet(t: pa.Table, _: int) -> pa.Table:
        image, y, strip, x0, x1, comp = (t[c].to_numpy() for c in ("image_id", "y", "_strip", "x0", "x1", "comp_id"))
        above, here = touching([image, strip], y, x0, x1, 0)
        right = np.flatnonzero(~changes(image, strip, y)[1:] & (x0[1:] == x1[:-1] + 1)) + 1
        p, q = np.concatenate([right - 1, above]), np.concatenate([right, here])
        differ = comp[p] != comp[q]
        p, q = p[differ], q[differ]
        out = pa.table({"image_id": image[p], "a": np.minimum(comp[p], comp[q]), "b": np.maximum(comp[p], comp[q])})
        return out.group_by(["image_id", "a", "b"]).aggregate([])

    of = {c: runs.schema[c].dataType for c in ("image_id", "comp_id")}
    schema = StructType([StructField(n, of[c]) for n, c in (("image_id", "image_id"), ("a", "comp_id"), ("b", "comp_id"))])
    return in_strips(runs.select("image_id", "y", "x0", "x1", "comp_id"), ["image_id"], "x0", meet, schema, lap=True)


def gaps(runs: DataFrame) -> DataFrame:
    """(image_id, comp_id, y, g0, g1, n_cells, open, root) of ``runs`` (image_id, comp_id, y, x0, x1, n_cells and the component's box bx0, bx1, by0, by1): what lies between a component's runs in its box and
    one cell around it, with the number of the part it belongs to inside its strip and whether that part reaches the frame."""

    def between(t: pa.Table, base: int) -> pa.Table:
        image, comp, y, x0, x1, n_cells, bx0, bx1, by0, by1 = (t[c].to_numpy() for c in columns)
        starts = changes(image, comp, y)
        ends = np.append(starts[1:], True)
        # before each run, and after the last one of a row
        at = np.repeat(np.arange(len(y)), 1 + ends)
        tail = np.append(at[1:] == at[:-1], False)
        tail = np.append(False, tail[:-1])
        g0 = np.where(tail, x1[at] + 1, np.where(starts[at], bx0[at] - 1, np.append(0, x1[:-1])[at] + 1))
        g1 = np.where(tail, bx1[at] + 1, x0[at] - 1)
        some = g0 <= g1
        at, g0, g1 = at[some], g0[some], g1[some]
        image, comp, y = image[at], comp[at], y[at]
        edge = (g0 < bx0[at]) | (g1 > bx1[at]) | (y < by0[at]) | (y > by1[at])
        part = first_touching([image, comp], y, g0, g1, None, 0) if len(at) else at
        reached = np.zeros(len(at), bool)
        reached[part[edge]] = True
        out = {"image_id": image, "comp_id": comp, "y": y, "g0": g0, "g1": g1, "n_cells": n_cells[at], "open": reached[part], "root": base + part}
        return pa.table(out).cast(pa.schema([("image_id", pa.int64()), ("comp_id", pa.int64()), ("y", pa.int32()), ("g0", pa.int32()), ("g1", pa.int32()), ("n_cells", pa.int64()), ("open", pa.bool_()), ("root", pa.int64())]))

    columns = ["image_id", "comp_id", "y", "x0", "x1", "n_cells", "bx0", "bx1", "by0", "by1"]
    return in_strips(runs.select(*columns), ["image_id", "comp_id"], "x0", between, "image_id long, comp_id long, y int, g0 int, g1 int, n_cells long, open boolean, root long")


def shared_sides(regions: DataFrame) -> DataFrame:
    """(image_id, comp_id, label, n): cell sides between a component and cells of another label, counted inside each strip and at each border; ``regions`` (image_id, x, y, label, comp_id)."""

    def sides(t: pa.Table, _: int) -> pa.Table:
        image, y, x, label, comp = (t[c].to_numpy() for c in ("image_id", "y", "x", "label", "comp_id"))
        begins = changes(image, y)
        row, first = np.cumsum(begins), np.flatnonzero(begins)
        before = np.append(0, first[:-1])
        follows = ~changes(image)[first] & (y[first] == y[before] + 1) & (y[first] + 1 >> STRIP == y[before] + 1 >> STRIP)
        right = np.flatnonzero(~begins[1:] & (x[1:] == x[:-1] + 1)) + 1
        wide = int(x.max()) - int(x.min()) + 1
        at = row * wide + (x - x.min())
        above = np.minimum(np.searchsorted(at, at - wide), len(at) - 1)
        down = np.flatnonzero(follows[row - 1] & (at[above] == at - wide))
        p, q = np.concatenate([right - 1, above[down]]), np.concatenate([right, down])
        differ = label[p] != label[q]
        p, q = p[differ], q[differ]
        p, q = np.concatenate([p, q]), np.concatenate([q, p])
        out = pa.table({"image_id": image[p], "comp_id": comp[p], "label": label[q]})
        return out.append_column("n", pa.array(np.ones(len(p), np.int64))).group_by(["image_id", "comp_id", "label"]).aggregate([("n", "sum")]).rename_columns(["image_id", "comp_id", "label", "n"])

    of = {c: regions.schema[c].dataType for c in ("image_id", "comp_id", "label")}
    schema = StructType([*(StructField(c, of[c]) for c in of), StructField("n", LongType())])
    inside = in_strips(regions.select("image_id", "y", "x", "label", "comp_id"), ["image_id"], "x", sides, schema)
    at = (F.col("y") + 1).bitwiseAND((1 << STRIP) - 1)
    key = ["image_id", "x", "y"]
    below = regions.where(at == 0).select(*key, F.col("label").alias("l"), F.col("comp_id").alias("c"))
    met = regions.where(at == (1 << STRIP) - 1).select("image_id", "x", (F.col("y") + 1).alias("y"), "label", "comp_id").join(below, key).where("label <> l")
    both = F.explode(F.array(F.struct("comp_id", F.col("l").alias("label")), F.struct(F.col("c").alias("comp_id"), "label"))).alias("s")
    return inside.unionByName(met.select("image_id", both).select("image_id", "s.*", F.lit(1).cast("long").alias("n")))


def across_borders(runs: DataFrame, key: list[str], x0: str, x1: str, reach: int) -> DataFrame | None:
    """(node, component) of the roots (column ``root``) of ``runs`` that are connected across borders between strips, or None if no two are."""
    at = (F.col("y") + 1).bitwiseAND((1 << STRIP) - 1)
    below, above = runs.where(at == 0), runs.where(at == (1 << STRIP) - 1).withColumn("y", F.col("y") + 1)
    links = kept(overlaps(as_intervals(below, key, x0, x1, "root"), as_intervals(above, key, x0, x1, "root"), key, reach).distinct())
    return None if links.isEmpty() else components(links)


def joined(runs: DataFrame, key: list[str], x0: str, x1: str, reach: int, name: str) -> DataFrame:
    """``runs``, a kept table, with ``name``: the least root (column ``root``, which goes) that they are connected with; kept, too, if any are connected."""
    met = across_borders(runs, key, x0, x1, reach)
    if met is None:
        return runs.withColumnRenamed("root", name)
    return kept(runs.join(met.withColumnRenamed("node", "root"), "root", "left").withColumn(name, F.coalesce("component", "root")).drop("root", "component"))
