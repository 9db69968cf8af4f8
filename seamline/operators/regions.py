"""Region graphs of label grids: neighbours, enclosure, nesting, sewing order.

Components come from ``raster.connected_components`` as runs (image_id, y, label, x0, x1, comp_id); ``components`` tables are
(image_id, comp_id, layer, n_cells, x0, y0, x1, y1, anchor_x, anchor_y).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators.strips import across_borders, changes, gaps, in_groups, neighbours
from seamline.session import kept

#: Cells of whole areas that ``thin_areas`` works on at once, about 300 bytes each; more if one area has more.
BATCH_CELLS = 1 << 17


def _place() -> Column:
    """A run's start as one number that grows in raster order, which is aggregated without a sort."""
    return F.shiftleft(F.col("y").cast("long"), 32) + F.col("x0")


def _at(place: str) -> tuple[Column, Column]:
    """(x, y) of a ``_place``."""
    y = F.shiftright(F.col(place) + (1 << 31), 32)
    return (F.col(place) - F.shiftleft(y, 32)).cast("int"), y.cast("int")


def component_stats(runs: DataFrame, cell_mm: float) -> DataFrame:
    """Cells, bounding box, anchor (centre of the first cell in raster order, mm) and area of each component."""
    out = runs.groupBy("image_id", "comp_id", "label").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("n_cells"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.min(_place()).alias("f")
    )
    x, y = _at("f")
    return out.select("image_id", "comp_id", "label", "n_cells", "x0", "y0", "x1", "y1", ((x + 0.5) * cell_mm).alias("anchor_x"), ((y + 0.5) * cell_mm).alias("anchor_y"), (F.col("n_cells") * cell_mm * cell_mm).alias("area_mm2"))


def min_cells(cell_mm: float, min_region_mm2: float) -> tuple[int, int]:
    """(smallest label region that stays, smallest component that is sewn) in cells."""
    return max(1, int(min_region_mm2 / cell_mm**2)), max(4, int(0.5 / cell_mm**2))


def drop_specks(stats: DataFrame, cell_mm: float) -> DataFrame:
    """Components large enough to be sewn."""
    return stats.where(F.col("n_cells") >= min_cells(cell_mm, 0.0)[1])


def number_components(stats: DataFrame) -> DataFrame:
    """``number`` of each component of an image, by layer and first cell."""
    return stats.withColumn("number", F.row_number().over(Window.partitionBy("image_id").orderBy("label", "comp_id")) - 1)


def adjacency(runs: DataFrame) -> DataFrame:
    """(image_id, a, b), a < b: components that share a cell side; their runs don't overlap.

    Side by side: runs that follow each other in a row; one above the other: overlapping runs of neighbouring rows.
    """
    return neighbours(runs).distinct()


def enclosing(stats: DataFrame, runs: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(image_id, comp_id, parent): the smallest component in one of whose holes the first cell lies (the higher number of equals), or null; none of ``excluded`` (image_id, comp_id).

    The gaps between a component's runs inside its bounding box and one cell around are cut into 4-connected parts; a part that
    doesn't reach that frame is a hole.
    """
    box = stats.select("image_id", "comp_id", "n_cells", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"), F.col("y1").alias("by1")).where("bx1 - bx0 >= 2 and by1 - by0 >= 2")
    box = box if excluded is None else box.join(excluded, ["image_id", "comp_id"], "left_anti")
    # the frame rows are gaps as a whole: their run is empty and lies behind them
    frame = box.select("image_id", "comp_id", F.explode(F.array(F.col("by0") - 1, F.col("by1") + 1)).alias("y"), (F.col("bx1") + 2).alias("x0"), (F.col("bx1") + 1).alias("x1"), *[c for c in box.columns if c not in ("image_id", "comp_id")])
    parts = kept(gaps(runs.select("image_id", "comp_id", "y", "x0", "x1").join(box, ["image_id", "comp_id"]).unionByName(frame)))
    met = across_borders(parts, ["image_id", "comp_id", "y"], "g0", "g1", 0)
    if met is not None:  # parts that go on in another strip are open if one of their pieces is
        opened = parts.select("root", "open").distinct().join(met.withColumnRenamed("node", "root"), "root")
        reached = opened.where("open").select("component").distinct().join(met, "component").select(F.col("node").alias("root")).distinct()
        parts = parts.join(reached.withColumn("_reached", F.lit(True)), "root", "left").withColumn("open", F.col("open") | F.coalesce("_reached", F.lit(False)))
    holes = parts.where("not open")
    first = runs.groupBy("image_id", F.col("comp_id").alias("inner")).agg(F.min(_place()).alias("f")).select("image_id", "inner", _at("f")[1].alias("y"), _at("f")[0].alias("x"))
    inside = first.join(holes, ["image_id", "y"]).where("x between g0 and g1 and inner <> comp_id")
    best = inside.groupBy("image_id", "inner").agg(F.min(F.struct("n_cells", (-F.col("comp_id")).alias("c"))).alias("m"))
    return stats.select("image_id", "comp_id").join(best.select("image_id", F.col("inner").alias("comp_id"), (-F.col("m.c")).alias("parent")), ["image_id", "comp_id"], "left")


def both_ways(adj: DataFrame) -> DataFrame:
    return adj.unionByName(adj.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))


def satin_parent(stats: DataFrame, adj: DataFrame, satin: DataFrame) -> DataFrame:
    """(image_id, comp_id, parent): the largest area that is no satin stroke and touches this stroke, the lower number of equals; ``satin`` (image_id, comp_id)."""
    flat = stats.join(satin, ["image_id", "comp_id"], "left_anti").select("image_id", F.col("comp_id").alias("b"), "n_cells")
    near = both_ways(adj).join(satin.withColumnRenamed("comp_id", "a"), ["image_id", "a"], "left_semi").join(flat, ["image_id", "b"])
    return near.groupBy("image_id", F.col("a").alias("comp_id")).agg(F.max(F.struct("n_cells", (-F.col("b")).alias("c"))).alias("m")).select("image_id", "comp_id", (-F.col("m.c")).alias("parent"))


def satin_parents(stats: DataFrame, runs: DataFrame, adj: DataFrame, satin: DataFrame) -> DataFrame:
    """(image_id, comp_id, parent): ``enclosing`` by areas that are no satin strokes; a stroke that touches such an area has the largest of them (``satin_parent``)."""
    touched = satin_parent(stats, adj, satin).withColumnRenamed("parent", "_touched")
    around = enclosing(stats, runs, satin).join(touched, ["image_id", "comp_id"], "left")
    return around.select("image_id", "comp_id", F.coalesce("_touched", "parent").alias("parent"))


def nesting_depth(parents: DataFrame, cap: int = 64, adj: DataFrame | None = None, satin: DataFrame | None = None) -> DataFrame:
    """``parents`` (image_id, comp_id, parent) with ``depth``: parents above, by pointer doubling; chains end at ``cap``.

    With ``adj`` and ``satin``, a stroke lies at least one over each area that it touches, that is no stroke and not its parent. Areas that are no strokes don't look at
    their neighbours, so this takes one step, not a fixed point.
    """
    key = ["image_id", "comp_id"]
    hop = parents.select(*key, F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(cap.bit_length()):
        step = hop.select("image_id", F.col("comp_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        hop = kept(hop.join(step, ["image_id", "up"], "left").select(*key, F.col("up2").alias("up"), F.least(F.lit(cap), F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))
        if hop.where("up is not null").isEmpty():
            break
    out = parents.join(hop.select(*key, "depth"), key)
    if satin is None:
        return out
    near = _touched(adj, satin).join(out.select("image_id", F.col("comp_id").alias("b"), F.col("depth").alias("below")), ["image_id", "b"])
    near = near.join(parents, key).where(~F.col("b").eqNullSafe(F.col("parent")))
    least = near.groupBy(*key).agg((F.max("below") + 1).alias("_least"))
    return out.join(least, key, "left").withColumn("depth", F.greatest("depth", F.coalesce("_least", F.lit(0)))).drop("_least")


def _touched(adj: DataFrame, satin: DataFrame) -> DataFrame:
    """(image_id, comp_id, b): strokes and the areas that are no strokes and share a side with them."""
    strokes = satin.select("image_id", "comp_id")
    return both_ways(adj).withColumnRenamed("a", "comp_id").join(strokes, ["image_id", "comp_id"], "left_semi").join(strokes.withColumnRenamed("comp_id", "b"), ["image_id", "b"], "left_anti").select("image_id", "comp_id", "b")


def layer_weights(stats: DataFrame, parents: DataFrame, min_weight_cells: int, adj: DataFrame | None = None, satin: DataFrame | None = None) -> DataFrame:
    """(image_id, below, above, weight): cells that lie in holes of another layer's areas; specks don't count.

    With ``adj`` and ``satin``, a stroke counts once more over each area of another layer that it touches and that is no stroke: over its parent twice.
    """
    layer = stats.select("image_id", "comp_id", F.col("label").alias("above"), "n_cells").where(F.col("n_cells") >= min_weight_cells)
    under = stats.select("image_id", F.col("comp_id").alias("parent"), F.col("label").alias("below"))
    over = parents.select("image_id", "comp_id", "parent")
    if satin is not None:
        over = over.unionByName(_touched(adj, satin).withColumnRenamed("b", "parent"))
    both = layer.join(over, ["image_id", "comp_id"]).join(under, ["image_id", "parent"]).where("below <> above")
    return both.groupBy("image_id", "below", "above").agg(F.sum("n_cells").alias("weight"))


def layer_order(stats: DataFrame, weights: DataFrame) -> DataFrame:
    """(image_id, label, rank): time and again the layer that breaks the least remaining weight goes next; larger area first, then the lower number.

    At most a few dozen layers an image; a task takes the weight tables of many images at once, in as many rounds as one has layers.
    """

    def order(t: pa.Table, _: int) -> pa.Table:
        image, edge, label, below, n = (t[c].to_numpy() for c in ("image_id", "edge", "label", "below", "n"))
        number = np.cumsum(changes(image))
        least = min(label.min(), below.min())
        at = lambda v: number * (int(max(label.max(), below.max())) - int(least) + 1) + (v - least)
        own = np.flatnonzero(~edge)
        known = at(label)[own]
        ends = []
        for v in (below, label):
            place = np.minimum(np.searchsorted(known, at(v)), max(len(known) - 1, 0))
            ends.append((place, known[place] == at(v) if len(known) else np.zeros(len(place), bool)))
        counts = edge & ends[0][1] & ends[1][1] & (below != label)
        (under, _), (over, _) = ends
        under, over, weight = under[counts], over[counts], n[counts]
        image, label, number, area = image[own], label[own], number[own], n[own]
        rank, left = np.zeros(len(own), np.int32), np.arange(len(own))
        stays, turn = np.ones(len(own), bool), 0
        while len(left):
            cost = np.zeros(len(own), weight.dtype)
            np.add.at(cost, over, weight)
            left = left[np.lexsort((label[left], -area[left], cost[left], number[left]))]
            next_ = changes(number[left])
            rank[left[next_]], stays[left[next_]] = turn, False
            left, turn = left[~next_], turn + 1
            open_ = stays[under] & stays[over]
            under, over, weight = under[open_], over[open_], weight[open_]
        return pa.table({"image_id": image, "label": label, "rank": rank}).cast(pa.schema([("image_id", pa.int64()), ("label", pa.int32()), ("rank", pa.int32())]))

    area = stats.groupBy("image_id", "label").agg(F.sum("n_cells").alias("n")).select("image_id", F.lit(False).alias("edge"), "label", F.col("label").alias("below"), "n")
    rows = area.unionByName(weights.select("image_id", F.lit(True).alias("edge"), F.col("above").alias("label"), "below", F.col("weight").alias("n")))
    return in_groups(rows, ["image_id"], ["image_id", "edge", "label"], lambda t: [t["image_id"].to_numpy()], order, "image_id long, label int, rank int")


def layered_order(stats: DataFrame, depth: DataFrame, ranks: DataFrame) -> DataFrame:
    """``place`` of each component: by depth, layer rank, number."""
    rows = stats.select("image_id", "comp_id", "label").join(depth.select("image_id", "comp_id", "depth"), ["image_id", "comp_id"]).join(ranks, ["image_id", "label"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("depth", "rank", "comp_id")) - 1)


def sewing_groups(ordered: DataFrame) -> DataFrame:
    """``group``: consecutive components of one layer (image_id, place, label)."""
    w = Window.partitionBy("image_id").orderBy("place")
    change = F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(0))
    return ordered.withColumn("_c", change).withColumn("group", F.sum("_c").over(w).cast("int")).drop("_c")


#: A cell's neighbours with the corners where the side towards them begins and ends.
SIDES = [((0, -1), (1, 0), (0, 0)), ((0, 1), (0, 1), (1, 1)), ((-1, 0), (0, 0), (0, 1)), ((1, 0), (1, 1), (1, 0))]


def boundary_edges(cells: DataFrame, dedupe: bool = False) -> DataFrame:
    """(image_id, comp_id, ax, ay, bx, by, other): cell sides between a component and another (-1: none), directed with the area on one hand.

    With ``dedupe`` a side shared by two components is kept for the lower number only. ``cells`` (image_id, x, y, comp_id).
    """
    each = F.explode(F.array(*[F.struct((F.col("x") + n[0]).alias("nx"), (F.col("y") + n[1]).alias("ny"), (F.col("x") + a[0]).alias("ax"), (F.col("y") + a[1]).alias("ay"), (F.col("x") + b[0]).alias("bx"), (F.col("y") + b[1]).alias("by")) for n, a, b in SIDES])).alias("s")
    out = cells.select("image_id", "comp_id", each).select("image_id", "comp_id", "s.*")
    there = cells.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("comp_id").alias("other"))
    out = out.join(there, ["image_id", "nx", "ny"], "left").withColumn("other", F.coalesce("other", F.lit(-1).cast("long"))).where("other <> comp_id")
    return (out.where("other < 0 or other >= comp_id") if dedupe else out).drop("nx", "ny")


def perimeters(edges: DataFrame, cell_mm: float) -> DataFrame:
    """(image_id, comp_id, other, length_mm): border of each component with each other one, -1 with none."""
    return edges.groupBy("image_id", "comp_id", "other").agg((F.count("*") * cell_mm).alias("length_mm"))


#: The eight directions in the order in which a pixel's neighbours come; OPPOSITE[d] leads back.
RING = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
OPPOSITE = [1, 0, 3, 2, 7, 6, 5, 4]


def skeleton_links(skeleton: DataFrame) -> DataFrame:
    """Pixels (image_id, comp_id, x, y, width) with ``ways``: the directions of their neighbours, diagonal ones only where no straight one joins both.

    Each pixel tells the eight around it that it is there; these notes are combined before they are dealt out, and no pixels are joined.
    """
    notes = [F.struct((-dx + F.col("x")).alias("x"), (-dy + F.col("y")).alias("y"), F.lit(1 << d).alias("bit"), F.lit(None).cast("double").alias("width")) for d, (dx, dy) in enumerate(RING)]
    width = F.col("width") if "width" in skeleton.columns else F.lit(0.0)
    own = F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.lit(1 << 8).alias("bit"), width.alias("width"))
    told = skeleton.select("image_id", "comp_id", F.explode(F.array(*notes, own)).alias("n")).select("image_id", "comp_id", "n.*")
    met = told.groupBy("image_id", "comp_id", "x", "y").agg(F.bit_or("bit").alias("near"), F.max("width").alias("width")).where(F.col("near").bitwiseAND(1 << 8) != 0)
    there = lambda bits: F.col("near").bitwiseAND(bits) != 0
    straight = lambda dx, dy: (1 << RING.index((dx, 0))) | (1 << RING.index((0, dy)))
    ways = [F.when(there(1 << d) if not dx * dy else there(1 << d) & ~there(straight(dx, dy)), d) for d, (dx, dy) in enumerate(RING)]
    return met.select("image_id", "comp_id", "x", "y", "width", F.array_compact(F.array(*ways)).alias("ways"))


def skeleton_degree(skeleton: DataFrame) -> DataFrame:
    """``degree`` of each pixel of (image_id, comp_id, x, y): its neighbours, see ``skeleton_links``."""
    key = ["image_id", "comp_id", "x", "y"]
    return skeleton.join(skeleton_links(skeleton).select(*key, F.size("ways").cast("long").alias("degree")), key)


def thin_areas(cells: DataFrame, cell_mm: float, max_width_mm: float, long_enough: bool = True) -> DataFrame:
    """(image_id, comp_id, x, y, width): skeleton pixels, with twice their distance to the border in mm, of components that a satin stroke can cover.

    Thin: the largest width is at most 1.6 times ``max_width_mm``, the 90th percentile over the skeleton at most ``max_width_mm``, and
    the skeleton is at least 1 mm and 1.5 median widths long (unless ``long_enough`` is off, for strokes that are measured later). A task has whole components, which it takes
    many at a time (BATCH_CELLS), as cells and not as boxes. Components with more cells than a few strokes across their box have (winding strokes may have any number) aren't sent if
    they hold a square too wide to be thin (``holding_squares``).
    """

    def traced(held: list[np.ndarray]) -> pa.RecordBatch:
        image, comp, x, y, area, around = _lattice(np.concatenate(held, axis=1))
        dist, bone = _chamfer(around), np.flatnonzero(_thinned(around))
        widest = np.full(area[-1] + 1, -np.inf)
        np.maximum.at(widest, area, dist)
        width, n = (2 * dist[bone] - 1) * cell_mm, np.bincount(area[bone], minlength=len(widest))
        first = np.cumsum(n) - n
        ranked = np.append(width[np.lexsort((width, area[bone]))], np.nan)  # each area's widths in order, then one for those without a bone
        at = lambda place: ranked[np.where(n > 0, first + place, -1)]
        p90, median = at(((n - 1) * 0.9).astype(np.int64)), at(n // 2)
        thin = (n > 0) & ((2 * widest - 1) * cell_mm <= 1.6 * max_width_mm) & (p90 <= max_width_mm)
        if long_enough:
            thin &= n * cell_mm >= np.maximum(1.0, 1.5 * median)
        stays = thin[area[bone]]
        at_ = bone[stays]
        cols = [pa.array(image[at_]), pa.array(comp[at_]), pa.array(x[at_].astype(np.int32)), pa.array(y[at_].astype(np.int32)), pa.array(width[stays])]
        return pa.RecordBatch.from_arrays(cols, names=["image_id", "comp_id", "x", "y", "width"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for t in batches:
            rows = np.array([t.column(c).to_numpy() for c in ("image_id", "comp_id", "x", "y")], np.int64)
            held.append(rows)
            n += rows.shape[1]
            if n >= BATCH_CELLS:  # all but the last area, which may go on
                rows = np.concatenate(held, axis=1)
                others = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))
                end = int(others[-1]) + 1 if len(others) else 0
                if end:
                    yield traced([rows[:, :end]])
                held, n = [rows[:, end:]], rows.shape[1] - end
        if n:
            yield traced(held)

    key = ["image_id", "comp_id"]
    box = cells.groupBy(*key).agg(F.count("*").alias("n"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    reach = 1.6 * max_width_mm / cell_mm + 2
    full = box.where(F.col("n") > reach * (F.col("w") + F.col("h"))).select(*key)
    deep = 0  # of a square's cells around its middle one, whose distance to the border is then one more at least
    while (2 * (deep + 1) - 1) * cell_mm <= 1.6 * max_width_mm:
        deep += 1
    wide = holding_squares(cells.join(full, key, "left_semi"), 2 * deep + 1)
    dealt = cells.join(wide, key, "left_anti").select(*[F.col(c).cast("long").alias(c) for c in (*key, "x", "y")]).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(trace, "image_id long, comp_id long, x int, y int, width double")


def holding_squares(cells: DataFrame, side: int) -> DataFrame:
    """(image_id, comp_id) of the components of ``cells`` (image_id, comp_id, x, y) that hold a square of ``side`` cells a side."""
    key = ["image_id", "comp_id"]
    ends = cells.select(*key, "x", "y")
    for along, across in (("x", "y"), ("y", "x")):  # cells that end a full piece of a row, then those that end such pieces one below the other
        w = Window.partitionBy(*key, across).orderBy(along)
        ends = ends.withColumn("_begin", F.lag(along, side - 1).over(w)).where(F.col("_begin") == F.col(along) - (side - 1)).drop("_begin")
    return ends.select(*key).distinct()


def _lattice(cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """image_id, comp_id, x, y, the area's place 0, 1, ... and the neighbours (eight rows: north, then clockwise) of ``cells`` (the first four as
    rows, areas one after the other), by area and scan order. A neighbour is the place of a cell of the same area, or the number of cells if there is none."""
    image, comp = cells[:2]
    area = np.cumsum(np.append(False, (image[1:] != image[:-1]) | (comp[1:] != comp[:-1])))
    first = np.flatnonzero(np.append(True, area[1:] != area[:-1]))
    x, y = (v - np.minimum.reduceat(v, first)[area] + 1 for v in cells[2:])
    wide, high = int(x.max()) + 2, int(y.max()) + 2
    key = (area * high + y) * wide + x
    order = np.argsort(key, kind="stable")
    key = key[order]
    around = np.empty((8, len(key)), np.int64)
    for k, (dx, dy) in enumerate(((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))):
        there = key + dy * wide + dx
        at = np.minimum(np.searchsorted(key, there), len(key) - 1)
        around[k] = np.where(key[at] == there, at, len(key))
    return *(v[order] for v in (*cells, area)), around


def _chamfer(around: np.ndarray) -> np.ndarray:
    """``chamfer`` of the cells of a ``_lattice``."""
    n = around.shape[1]
    d = np.append(np.full(n, np.inf), 0.0)
    while True:  # relax until nothing changes: as many rounds as the widest place is cells deep
        new = np.minimum(d[around[::2]].min(axis=0) + 1.0, d[around[1::2]].min(axis=0) + 2**0.5)
        new = np.minimum(new, d[:n])
        if np.array_equal(new, d[:n]):
            return new
        d[:n] = new


def _thinned(around: np.ndarray) -> np.ndarray:
    """``thinned`` of the cells of a ``_lattice``: each round looks at the cells that are left."""
    n = around.shape[1]
    img = np.append(np.ones(n, bool), False)
    left = np.arange(n)
    while True:
        had = len(left)
        for phase in (0, 1):
            near = img[around[:, left]]
            north, east, south, west = near[::2]
            total, turns = near.sum(axis=0), (~near & np.roll(near, -1, axis=0)).sum(axis=0)
            sides = ~(north & east & south) & ~(east & south & west) if phase == 0 else ~(north & east & west) & ~(north & south & west)
            gone = (total >= 2) & (total <= 6) & (turns == 1) & sides
            img[left[gone]] = False
            left = left[~gone]
        if len(left) == had:
            return img[:n]


def chamfer(mask: np.ndarray) -> np.ndarray:
    """City-block-and-diagonal distance in cells (1 straight, the root of 2 diagonal) of each inside cell to the nearest outside one."""
    far = float(mask.size)
    d = np.where(mask, far, 0.0)
    steps = [(0, 1, 1.0), (1, 0, 1.0), (1, 1, 2**0.5), (1, -1, 2**0.5)]
    while True:  # relax until nothing changes: as many rounds as the widest place is cells deep
        new = d.copy()
        p = np.pad(d, 1, constant_values=0.0)
        h, w = d.shape
        for dy, dx, c in [*steps, *[(-a, -b, c) for a, b, c in steps]]:
            np.minimum(new, p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] + c, out=new)
        new[~mask] = 0.0
        if np.array_equal(new, d):
            return d
        d = new


def thinned(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton by alternating border peels (Zhang and Suen 1984)."""
    img = np.pad(mask, 1)
    while True:
        changed = False
        for phase in (0, 1):
            n = [np.roll(img, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]  # north, then clockwise
            total = sum(x.astype(int) for x in n)
            turns = sum((~n[i] & n[(i + 1) % 8]).astype(int) for i in range(8))
            north, east, south, west = n[0], n[2], n[4], n[6]
            sides = ~(north & east & south) & ~(east & south & west) if phase == 0 else ~(north & east & west) & ~(north & south & west)
            gone = img & (total >= 2) & (total <= 6) & (turns == 1) & sides
            if gone.any():
                img, changed = img & ~gone, True
        if not changed:
            return img[1:-1, 1:-1]
