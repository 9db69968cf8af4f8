"""Whole jobs, built from the operators: colours of an image corpus, stitches from a grid, a report on designs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions.colour import lab_to_rgb, rgb_to_lab
from seamline.operators import catalogue as K
from seamline.operators import centerlines as C
from seamline.operators import fill as L
from seamline.operators import needle as N
from seamline.operators import paths as P
from seamline.operators import raster as R
from seamline.operators import regions as G
from seamline.operators import stitch as S
from seamline.operators import ways as W
from seamline.session import cut, kept


def plan_colours(small: DataFrame, grid: DataFrame, threads: DataFrame, range_id: str, colours: int = 8, cell_mm: float = 0.2, min_region_mm2: float = 1.5, rounds: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, clusters, choices) of pixel tables at two resolutions: palette from the small one, labels on the grid, filtered twice, specks and then slivers without a core absorbed, threads matched."""
    sample = cut(R.opaque(small).groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("weight")).withColumn("lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))))
    centers = cut(R.kmeans_lloyd(sample, R.image_palette(sample, colours), rounds))
    px = grid.withColumn("lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    near = R.assign_cluster(px, centers).select("image_id", "x", "y", F.when(F.col("a") >= R.OPAQUE, F.col("cluster")).otherwise(-1).alias("label"))
    cells = cut(R.majority_filter(R.majority_filter(cut(near))))
    least = G.min_cells(cell_mm, min_region_mm2)[0]
    cells = R.remove_small_regions(R.remove_small_regions(cells, least), least, require_core=True)
    rgb = lab_to_rgb(F.col("lab.l"), F.col("lab.a"), F.col("lab.b"))
    share = R.coverage(cells).join(R.background(cells), "image_id", "left").withColumn("is_background", F.col("cluster").eqNullSafe(F.col("background")))
    clusters = cut(share.join(centers.withColumn("c", rgb), ["image_id", "cluster"]).select("image_id", "cluster", *[F.round(f"c.{x}").cast("int").alias(x) for x in "rgb"], "coverage", "is_background"))
    choices = K.rank_colours(K.nearest_thread(K.default_choices(clusters).withColumn("range_id", F.lit(range_id)), threads))
    return cells, clusters, choices.select("image_id", "cluster", "thread_id", "enabled", "place")


PIECE = ["image_id", "comp_id", "phase", "cell"]
#: What of an area is sewn, in this order: underlay and fill, or satin strokes; then the area's outline.
UNDERLAY, FILL, SATIN, OUTLINE = 0, 1, 2, 3
#: Outlines that areas share belong to none, and their group comes after all others.
NO_AREA, LAST = -1, 1 << 60
#: The row of the points on the way to a piece, before all its own.
WAY = -1


def _both_ways(points: DataFrame) -> DataFrame:
    """``points`` of strokes with ``way``: 0 as they are, 1 from their other end, if they have one."""
    back = points.where(~F.col("closed")).withColumn("seq", -F.col("seq")).withColumn("way", F.lit(1))
    return points.withColumn("way", F.lit(0)).unionByName(back)


def _columns(points: DataFrame, phase: int, satin_spacing: float) -> DataFrame:
    """Satin columns along ``points`` (image_id, comp_id, path_id, seq, x, y, width, closed), each way: a run out along the middle, in row 0, and the zigzag back, in row 1."""
    key = F.struct("image_id", "comp_id", "path_id", "way").alias("path_id")
    lines = kept(_both_ways(points).select(key, "seq", "x", "y", "width", "closed"))
    samples = kept(P.resample(lines, satin_spacing / 2))
    wide = kept(P.interpolate_at(lines, samples.select("path_id", "i", "s"), ("width",)).select("path_id", "i", "width"))
    zig = P.zigzag(samples.join(wide, ["path_id", "i"]), F.col("width"))
    return _rows(samples.select("path_id", F.col("i"), "x", "y"), zig, phase)


def _rows(middle: DataFrame, zig: DataFrame, phase: int) -> DataFrame:
    """Sewing points of columns: ``middle`` (path_id, i, x, y) and ``zig`` (path_id, seq, x, y), legs of up to 2 and 12 mm."""
    both = middle.select("path_id", F.lit(0).alias("row"), F.col("i").cast("int").alias("i"), F.lit(2.0).alias("stitch"), "x", "y").unionByName(zig.select("path_id", F.lit(1).alias("row"), F.col("seq").cast("int").alias("i"), F.lit(12.0).alias("stitch"), "x", "y"))
    return both.select("path_id.image_id", "path_id.comp_id", F.lit(phase).alias("phase"), F.col("path_id.path_id").alias("cell"), F.col("path_id.way").alias("way"), "row", "i", "stitch", "x", "y")


def _outlines(own: DataFrame, style: str, width: float, pull: float, cell_mm: float, satin_spacing: float, shared: bool) -> DataFrame:
    """Sewing points of the borders of the areas ``own`` (image_id, x, y, comp_id), each way: a run ("running"), or satin from the border inwards; of ``shared`` ones each once, centred on the border."""
    chains = P.boundary_chains(own, cell_mm, dedupe=shared)
    if shared:
        chains = chains.withColumn("comp_id", F.lit(NO_AREA).cast("long"))
    chains = kept(_both_ways(chains))
    if style == "running":
        return chains.select("image_id", "comp_id", F.lit(OUTLINE).alias("phase"), F.col("path_id").alias("cell"), "way", F.lit(0).alias("row"), F.col("seq").cast("int").alias("i"), F.lit(2.5).alias("stitch"), "x", "y")
    samples = P.resample(chains.select(F.struct("image_id", "comp_id", "path_id", "way").alias("path_id"), "seq", "x", "y", "closed"), satin_spacing / 2)
    # the area stays on the same hand
    hand = F.when(F.col("path_id.way") == 1, -1).otherwise(1)
    samples = kept(samples.withColumns({"tx": F.col("tx") * hand, "ty": F.col("ty") * hand}))
    return _rows(P.outline_centre(samples, width, not shared, pull).withColumnRenamed("seq", "i"), P.outline_zigzag(samples, width, not shared, pull), OUTLINE)


def _turn(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def _corners(fills: DataFrame, angle: Column) -> DataFrame:
    """(PIECE, way, x0, y0, x1, y1, row0, row1) of the cells of ``fills``: a cell may be begun at either end of its first row or, from 2 on, of its last; every row goes back on the one before it."""
    run = F.struct("row", "u0", "u1", "v")
    c = fills.groupBy(*PIECE).agg(F.min(run).alias("a"), F.max(run).alias("b")).withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(3))))
    right, back = F.col("way") % 2 == 1, F.col("way") >= 2
    last_right = right == ((F.col("b.row") - F.col("a.row")) % 2 == 1)
    one, two = F.when(back, F.col("b")).otherwise(F.col("a")), F.when(back, F.col("a")).otherwise(F.col("b"))
    (x0, y0), (x1, y1) = (_turn(F.when(at, r["u1"]).otherwise(r["u0"]), r["v"], angle) for r, at in ((one, right), (two, last_right)))
    return c.select(*PIECE, "way", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.col("a.row").alias("row0"), F.col("b.row").alias("row1"))


def digitize(
    cells: DataFrame, choices: DataFrame, cell_mm: float = 0.2, spacing: float = 0.4, angle: float = 30.0, pull: float = 0.2, trim_mm: float = 2.0,
    satin_mm: float | None = None, satin_spacing: float = 0.4, outline: str = "none", outline_mm: float = 2.0, by_layer: bool = False,
    outline_thread: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(stitches, design_threads): every layer's areas in layered order, in 0.1 mm units.

    With ``satin_mm``, areas nowhere much wider are satin columns along their centre lines, which lie over what they touch; other areas are tatami fills, followed by their ``outline`` (none, running or
    satin of ``outline_mm``); with ``outline_thread`` the borders of all areas come last instead, in that thread, one between two areas once. Areas follow one another by nesting depth and layer (what encloses
    another layer goes before it), or ``by_layer`` with the fewest colour changes; those of one group by their anchors, from where the needle stands;
    an area's fill is cut into cells around its holes. Always the nearest cell or stroke is next, a cell from its nearest corner, an open stroke from its nearest end. A way to the next cell is sewn if it is short, stays in the area or
    leads round its holes without a long detour, else trimmed; a new thread starts with COLOR, a cut with TRIM, both followed by a STITCH at the same point. Thread is tied in and off at every cut,
    and long legs are divided. Specks are not sewn.
    """
    choices = kept(choices)
    layers = kept(R.layer_map(cells, choices).where("layer >= 0").select("image_id", "x", "y", F.col("layer").alias("label")))
    runs = R.connected_components(layers, 8)
    stats = kept(G.drop_specks(G.component_stats(runs, cell_mm), cell_mm))
    sewn_runs = runs.join(stats.select("image_id", "comp_id"), ["image_id", "comp_id"], "left_semi")
    own = R.with_component(layers, sewn_runs).select("image_id", "x", "y", "comp_id")
    least = int(4 / cell_mm**2)
    flat, lines, satin, adj = stats, None, None, None
    if satin_mm is not None:
        lines = kept(C.centre_lines(kept(own), cell_mm, satin_mm, pull))
        satin = kept(lines.select("image_id", "comp_id").distinct())
        adj = kept(G.adjacency(sewn_runs))
        parents = kept(G.satin_parents(stats, runs, adj, satin))
        flat = stats.join(satin, ["image_id", "comp_id"], "left_anti")
    else:
        parents = kept(G.enclosing(stats, runs))
    ranks = G.layer_order(stats, G.layer_weights(stats, parents, least, adj, satin))
    depth = stats.select("image_id", "comp_id", F.lit(0).alias("depth")) if by_layer else G.nesting_depth(parents, adj=adj, satin=satin)
    groups = kept(G.sewing_groups(G.layered_order(stats, depth, ranks)).select("image_id", "comp_id", "label", "group"))
    anchors = kept(groups.join(stats.select("image_id", "comp_id", "anchor_x", "anchor_y"), ["image_id", "comp_id"]))
    # the points of every cell of the fill, in mm
    samples = L.scan_samples(L.fill_plan(flat.drop("label"), spacing, angle, pull), cell_mm)
    fills = kept(L.fill_cells(kept(L.fill_runs(L.points_in_mask(samples, runs, cell_mm), cell_mm))))
    key = ["image_id", "comp_id", "phase", "row", "run"]
    points = L.row_stitches(fills).join(fills.select(*key, "cell", "v", "stitch"), key)
    turn = F.radians(F.when(F.col("phase") == UNDERLAY, angle + 90).otherwise(angle))
    px, py = _turn(F.col("u"), F.col("v"), turn)
    fill_points = points.select(*PIECE, "row", "i", "stitch", px.alias("x"), py.alias("y"))
    corners = _corners(fills, turn)
    strokes = []
    if lines is not None:
        strokes.append(_columns(lines, SATIN, satin_spacing))
    if outline != "none":
        bordered = own if outline_thread else own.join(flat.select("image_id", "comp_id"), ["image_id", "comp_id"], "left_semi")
        strokes.append(_outlines(bordered, outline, outline_mm, pull, cell_mm, satin_spacing, outline_thread is not None))
    areas, ways_in = anchors, corners
    if strokes:
        stroke_points = kept(reduce(DataFrame.unionByName, strokes))
        at = F.struct("row", "i", "x", "y")
        ends = stroke_points.groupBy(*PIECE, "way").agg(F.min(at).alias("a"), F.max(at).alias("b"))
        ways_in = corners.unionByName(ends.select(*PIECE, "way", *[F.col(f"{e}.{c}").alias(f"{c}{i}") for i, e in enumerate("ab") for c in "xy"], F.lit(0).alias("row0"), F.lit(0).alias("row1")))
    if outline != "none" and outline_thread:
        none = [F.lit(NO_AREA).cast("long").alias("comp_id"), F.lit(None).cast("int").alias("label"), F.lit(LAST).alias("group"), F.lit(0.0).alias("anchor_x"), F.lit(0.0).alias("anchor_y")]
        areas = anchors.unionByName(anchors.select("image_id").distinct().select("image_id", *none))
    ways_in = kept(ways_in.join(areas, ["image_id", "comp_id"]))
    order = N.needle_order(ways_in.select(F.col("image_id").alias("design_id"), "group", F.col("comp_id").alias("item"), F.col("anchor_x").alias("ax"), F.col("anchor_y").alias("ay"), "phase", F.col("cell").alias("piece"), "way", "x0", "y0", "x1", "y1"))
    order = order.select(F.col("design_id").alias("image_id"), F.col("item").alias("comp_id"), "phase", F.col("piece").alias("cell"), "way", F.col("place").alias("seq"))
    first = choices.where("enabled").groupBy("image_id", "thread_id").agg(F.min("cluster").alias("f"))
    thread = first.withColumn("label", F.row_number().over(Window.partitionBy("image_id").orderBy("f")) - 1).select("image_id", "label", "thread_id")
    pieces = ways_in.join(order, [*PIECE, "way"]).join(thread, ["image_id", "label"], "left").withColumn("thread_id", F.coalesce("thread_id", F.lit(outline_thread)))
    pieces = kept(pieces.select(*PIECE, F.col("way").alias("entry"), "row0", "row1", "x0", "y0", "x1", "y1", "thread_id", "seq"))
    # the points of a cell in the order its entry asks for: rows up or down, each back on the one before it
    turned, right = F.col("entry") >= 2, F.col("entry") % 2 == 1
    row = F.when(turned, F.col("row1") - F.col("row")).otherwise(F.col("row") - F.col("row0"))
    leftwards = right != (row % 2 == 1)
    i = F.when((F.col("row") % 2 == 1) == leftwards, F.col("i")).otherwise(-F.col("i"))
    chosen = pieces.select(*PIECE, "entry", "row0", "row1")
    points = fill_points.join(chosen, PIECE).select(*PIECE, row.alias("row"), i.alias("i"), "stitch", "x", "y")
    if strokes:
        points = points.unionByName(stroke_points.join(chosen.withColumnRenamed("entry", "way"), [*PIECE, "way"]).select(*PIECE, "row", "i", "stitch", "x", "y"))
    points = kept(points)
    # the way to each piece
    in_turn = Window.partitionBy("image_id").orderBy("seq")
    ways = pieces.select("image_id", "comp_id", "seq", F.lag("comp_id").over(in_turn).alias("old"), F.lag("x1").over(in_turn).alias("wx"), F.lag("y1").over(in_turn).alias("wy"), "x0", "y0").where(f"old = comp_id and comp_id <> {NO_AREA}")
    moves = kept(ways.select("image_id", "comp_id", "seq", F.col("wx").alias("x0"), F.col("wy").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1")))
    held = kept(L.segments_in_mask(moves.withColumn("seg", F.struct("image_id", "seq")).drop("seq"), runs, cell_mm).select("seg.*", "inside"))
    # where the straight way leaves the area, one round its holes
    astray = moves.join(held.where("not inside"), ["image_id", "seq"], "left_semi").where(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > min(trim_mm, P.SHORT))
    walked = W.ways_in_mask(astray, runs, cell_mm, ["image_id", "seq"])
    kinds = P.travel_kind(pieces.join(held, ["image_id", "seq"], "left").join(walked, ["image_id", "seq"], "left").withColumnRenamed("image_id", "design_id"), trim_mm)
    starts = F.col("kind").isin("start", "color", "trim")
    kinds = kinds.withColumn("path", F.sum(starts.cast("long")).over(Window.partitionBy("design_id").orderBy("seq"))).withColumnRenamed("design_id", "image_id")
    kinds = kept(kinds.select(*PIECE, "seq", "thread_id", "kind", "path", "way"))
    # paths without a cut: legs divided, thread tied in and off
    path_id = F.struct("image_id", "path").alias("path_id")
    w = Window.partitionBy("image_id", "path").orderBy("seq", "row", "i")
    old = lambda c: F.lag(c).over(w)
    sewn = points.join(kinds.select(*PIECE, "seq", "path"), PIECE)
    on_way = kinds.select(*PIECE, F.lit(WAY).alias("row"), F.posexplode("way").alias("i", "p"), F.lit(3.0).alias("stitch"), "seq", "path")
    sewn = sewn.unionByName(on_way.select(*PIECE, "row", "i", "stitch", "p.x", "p.y", "seq", "path"))
    # within a piece a leg takes its stitch, on the way to it 3 mm
    sewn = kept(sewn.select(path_id, F.row_number().over(w).alias("n"), old("x").alias("x0"), old("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.when((old("seq") == F.col("seq")) & (old("row") != WAY), F.col("stitch")).otherwise(3.0).alias("reach")))
    legs = P.subdivide(sewn.where("n > 1").select(F.struct("path_id", "n").alias("leg"), "x0", "y0", "x1", "y1", "reach"), F.col("reach"))
    whole = legs.select("leg.path_id", "leg.n", "i", "x", "y").unionByName(sewn.where("n = 1").select("path_id", "n", F.lit(0).alias("i"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    tied = P.add_ties(whole.select("path_id", F.struct("n", "i").alias("seq"), "x", "y"))
    cuts = kinds.where(starts).select("image_id", "path", F.when(F.col("kind") == "color", S.COLOR).when(F.col("kind") == "trim", S.TRIM).alias("mark"))
    rows = tied.select("path_id.*", F.col("seq").alias("n"), *[F.round(F.col(c) * 10).cast("int").alias(c) for c in "xy"]).join(cuts, ["image_id", "path"])
    k = F.when((F.col("n") == 0) & F.col("mark").isNotNull(), F.array("mark", F.lit(S.STITCH))).otherwise(F.array(F.lit(S.STITCH)))
    rows = rows.select("image_id", "path", "n", "x", "y", F.posexplode(k).alias("j", "k"))
    seq = F.row_number().over(Window.partitionBy("image_id").orderBy("path", "n", "j")) - 1
    design = kept(rows.select(F.col("image_id").alias("design_id"), seq.cast("long").alias("seq"), "x", "y", "k"))
    named = S.thread_sequence(kinds.select(F.col("image_id").alias("design_id"), "seq", "thread_id")).select("design_id", "block", "thread_id").distinct()
    return S.dedupe_stitches(design), named


def design_report(stitches: DataFrame, design_threads: DataFrame, threads: DataFrame, hoop_w: float, hoop_h: float) -> tuple[DataFrame, DataFrame]:
    """(summary with too_big, usage with the threads' names)."""
    summary = S.design_summary(stitches, design_threads)
    summary = summary.withColumn("too_big", (F.col("width_mm") > hoop_w) | (F.col("height_mm") > hoop_h))
    usage = S.thread_usage(stitches, design_threads).join(design_threads, ["design_id", "block"], "left")
    return summary, K.find_thread(usage, threads.select("thread_id", "brand", "code", "name"))
