"""Ordered stitch tables: (design_id, seq, x, y, k) in 0.1 mm, k one of STITCH, JUMP, TRIM, COLOR.

Everything ordered runs over one window, partitioned by design and ordered by seq, so that all of it shares one shuffle and sort.
A design is one file's worth of stitches, which bounds a window's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions.text import list_metres, sewing_minutes

STITCH, JUMP, TRIM, COLOR = 0, 1, 2, 3
#: mm of thread that a stitch takes through the fabric, and that are left at a cut end; share of the bobbin.
PENETRATION_MM, TAIL_MM, BOBBIN = 2.4, 40.0, 0.4


def in_order() -> Window:
    return Window.partitionBy("design_id").orderBy("seq")


def so_far():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_block(s: DataFrame) -> DataFrame:
    """``block``: colour changes up to and including the record."""
    return s.withColumn("block", F.sum(F.when(F.col("k") == COLOR, 1).otherwise(0)).over(so_far()).cast("int"))


def with_runs(s: DataFrame) -> DataFrame:
    """``run``: number of the polyline; every record but a STITCH starts one."""
    return s.withColumn("run", F.sum(F.when(F.col("k") != STITCH, 1).otherwise(0)).over(so_far()).cast("long"))


def with_move(s: DataFrame) -> DataFrame:
    """``move``: distance from the previous record, null for the first."""
    return s.withColumn("move", F.hypot(F.col("x") - F.lag("x").over(in_order()), F.col("y") - F.lag("y").over(in_order())))


def polylines(s: DataFrame) -> DataFrame:
    """(design_id, run, block, points) of the runs of more than one point, the record that starts a run first."""
    rows = with_runs(with_block(s)).groupBy("design_id", "run").agg(F.max("block").alias("block"), F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return rows.where(F.size("p") > 1).select("design_id", "run", "block", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def absolute_positions(deltas: DataFrame) -> DataFrame:
    """(design_id, seq, dx, dy, ...) with ``x`` and ``y``: running sums."""
    return deltas.withColumn("x", F.sum("dx").over(so_far()).cast("int")).withColumn("y", F.sum("dy").over(so_far()).cast("int"))


def dedupe_stitches(s: DataFrame) -> DataFrame:
    """Without STITCHes that repeat the STITCH before them."""
    lag = lambda c: F.lag(c).over(in_order())
    same = (F.col("k") == STITCH) & (lag("k") == STITCH) & (lag("x") == F.col("x")) & (lag("y") == F.col("y"))
    return s.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same").drop("_same")


def thread_sequence(pieces: DataFrame) -> DataFrame:
    """(design_id, seq, thread_id) with ``block``: a new one only where the thread differs from the one loaded."""
    change = F.coalesce(F.lag("thread_id").over(in_order()) != F.col("thread_id"), F.lit(False))
    return pieces.withColumn("_change", change.cast("int")).withColumn("block", F.sum("_change").over(so_far()).cast("int")).drop("_change")


def shift_origin(s: DataFrame) -> DataFrame:
    """The first record becomes the origin; a design that then passes 2047 anywhere is centred and starts with a JUMP to its first record."""
    whole = Window.partitionBy("design_id")
    at = s.withColumn("x", F.col("x") - F.first("x").over(so_far())).withColumn("y", F.col("y") - F.first("y").over(so_far()))
    low_x, high_x, low_y, high_y = (f(c).over(whole) for c in ("x", "y") for f in (F.min, F.max))
    big = (low_x < -2047) | (low_y < -2047) | (high_x > 2047) | (high_y > 2047)
    half = lambda a, b: F.when(big, ((a + b) / 2).cast("int")).otherwise(0)  # noqa: E731  the cast drops the fraction
    at = at.withColumn("_cx", half(low_x, high_x)).withColumn("_cy", half(low_y, high_y)).withColumn("_big", big)
    at = at.withColumn("_n", F.row_number().over(in_order())).withColumn("x", F.col("x") - F.col("_cx")).withColumn("y", F.col("y") - F.col("_cy"))
    both = F.when(F.col("_big") & (F.col("_n") == 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    at = at.withColumn("_own", F.explode(both))
    k = F.when(F.col("_own") == 0, JUMP).otherwise(F.col("k")).cast("int")
    seq = F.when(F.col("_big"), F.col("_n") - 1 + F.col("_own")).otherwise(F.col("_n") - 1).cast("long")
    return at.select("design_id", seq.alias("seq"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), k.alias("k"))


def sewout_prefix(s: DataFrame, share: float) -> DataFrame:
    """The first round(n * share) records of each design."""
    n = F.count("*").over(Window.partitionBy("design_id"))
    return s.withColumn("_n", F.row_number().over(in_order())).withColumn("_all", n).where(F.col("_n") <= F.round(F.col("_all") * share)).drop("_n", "_all")


def stitch_stats(s: DataFrame) -> DataFrame:
    """Counts of each kind by design."""
    return s.groupBy("design_id").agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in ((STITCH, "stitches"), (JUMP, "jumps"), (TRIM, "trims"), (COLOR, "color_changes"))])


def bounds(s: DataFrame, designs: DataFrame | None = None) -> DataFrame:
    """Bounds, width and height over all records; zeros for those of ``designs`` (design_id) without any."""
    b = s.groupBy("design_id").agg(*[f(c).alias(n) for n, f, c in (("min_x", F.min, "x"), ("min_y", F.min, "y"), ("max_x", F.max, "x"), ("max_y", F.max, "y"))])
    if designs is not None:
        b = designs.select("design_id").join(b, "design_id", "left").na.fill(0)
    return b.withColumn("width", F.col("max_x") - F.col("min_x")).withColumn("height", F.col("max_y") - F.col("min_y"))


def thread_taken(s: DataFrame, before: Column) -> DataFrame:
    """``s`` (k, move, ...) with ``mm`` of thread that each record takes, and whether it starts a run; ``before``: the kind of the record before."""
    s = s.withColumn("_live", F.coalesce(before.isin(STITCH, JUMP), F.lit(False)))
    mm = F.when(F.col("_live") & (F.col("k") == STITCH), F.col("move") / 10 + PENETRATION_MM).when(F.col("k") == STITCH, 2 * TAIL_MM).when(F.col("_live") & (F.col("k") == JUMP), F.col("move") / 10).otherwise(0.0)
    return s.withColumn("mm", mm).withColumn("starts", ((F.col("k") == STITCH) & ~F.col("_live")).cast("int"))


def _used(s: DataFrame) -> DataFrame:
    return thread_taken(with_move(with_block(s)), F.lag("k").over(in_order()))


def thread_usage(s: DataFrame, design_threads: DataFrame) -> DataFrame:
    """(design_id, block, top_m, bobbin_m, runs): a row per colour block, and one of null block with the design's totals.

    A stitch on a running thread takes its length and PENETRATION_MM, the first of a run two tails; a jump carries the thread
    along; trims and colour changes cut it. Lengths beyond the last thread are left out, runs there count in the totals.
    """
    return usage_by_block(_used(s), design_threads)


def usage_by_block(used: DataFrame, design_threads: DataFrame) -> DataFrame:
    """Sums of ``thread_taken``, see ``thread_usage``."""
    each = used.groupBy("design_id", "block").agg(F.sum("mm").alias("mm"), F.sum("starts").alias("runs"))
    # runs in blocks that have no thread are kept, under their block, for the totals
    known = design_threads.select("design_id", "block", F.lit(True).alias("named"))
    rows = known.join(each, ["design_id", "block"], "full")
    top = F.sum(F.when(F.col("named"), F.coalesce("mm", F.lit(0.0))).otherwise(0.0)) / 1000
    out = rows.rollup("design_id", "block").agg(top.alias("top_m"), F.sum(F.coalesce("runs", F.lit(0))).alias("runs"), F.max("named").alias("named"))
    return out.where("design_id is not null and named").select("design_id", "block", "top_m", (F.col("top_m") * BOBBIN).alias("bobbin_m"), "runs")


def design_summary(s: DataFrame, design_threads: DataFrame) -> DataFrame:
    """One row per design: size, counts, distinct threads, colour changes, minutes, metres."""
    size = {c: getattr(F, c[:3])(c[4:]).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")}
    # one pass: the window's partitioning serves the aggregate
    one = _used(s).join(design_threads.select("design_id", "block", F.lit(1).alias("_named")), ["design_id", "block"], "left")
    one = one.groupBy("design_id").agg(
        *size.values(),
        F.count_if(F.col("k") == STITCH).alias("stitches"),
        F.count_if(F.col("k") == TRIM).alias("trims"),
        (F.sum(F.when(F.col("_named") == 1, F.col("mm")).otherwise(0.0)) / 1000).alias("top_m"),
        F.sum("starts").alias("runs"),
    )
    palette = design_threads.groupBy("design_id").agg(F.count_distinct("thread_id").alias("threads"), F.greatest(F.count("*") - 1, F.lit(0)).alias("changes"))
    out = palette.join(one, "design_id", "left").na.fill(0)
    return out.select(
        "design_id",
        ((F.col("max_x") - F.col("min_x")) / 10).alias("width_mm"),
        ((F.col("max_y") - F.col("min_y")) / 10).alias("height_mm"),
        "stitches", "threads", "changes", "trims",
        sewing_minutes(F.col("stitches"), F.col("changes"), F.col("trims")).alias("minutes"),
        "top_m",
        (F.col("top_m") * BOBBIN).alias("bobbin_m"),
        "runs",
    )


def fit_check(b: DataFrame, hoop_w: Column, hoop_h: Column) -> DataFrame:
    """``bounds`` with ``too_big``: wider or higher in mm than the hoop."""
    return b.withColumn("too_big", (F.col("width") / 10 > hoop_w) | (F.col("height") / 10 > hoop_h))


def thread_list(s: DataFrame, design_threads: DataFrame, catalogue: DataFrame, names: DataFrame, house: str, machine: DataFrame) -> DataFrame:
    """(design_id, line_no, line): a title, a numbered line for each block, a total.

    ``names`` (design_id, name); ``machine`` (machine_index, machine_name) says what the machine shows for threads of other brands than ``house``.
    """
    usage = thread_usage(s, design_threads)
    total = usage.where("block is null").select("design_id", "top_m", "bobbin_m")
    head = design_summary(s, design_threads).join(names, "design_id")
    size = F.format_string("%s — %.1f × %.1f mm, %d stitches, %d colour changes", "name", "width_mm", "height_mm", "stitches", "changes")
    blocks = usage.where("block is not null").join(design_threads, ["design_id", "block"]).join(catalogue.join(machine, "machine_index", "left"), "thread_id", "left")
    shown = F.when(F.col("brand") == house, "").otherwise(F.concat(F.lit("   (machine shows: "), F.coalesce("machine_name", F.lit("")), F.lit(")")))
    hex_ = F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in "rgb"])
    text = F.concat(F.lit("  "), F.lpad((F.col("block") + 1).cast("string"), 2, " "), F.lit(". "), list_metres(F.col("top_m")), F.lit(" m  "), F.concat_ws(" ", "brand", "code"), F.lit(" – "), F.coalesce("name", F.lit("")), F.lit(" "), hex_, shown)
    last = F.concat(F.lit("Total: about "), F.ceil("top_m").cast("string"), F.lit(" m of top thread and "), F.ceil("bobbin_m").cast("string"), F.lit(" m of bobbin thread."))
    return head.select("design_id", F.lit(0).alias("line_no"), size.alias("line")).unionByName(blocks.select("design_id", (F.col("block") + 1).cast("int").alias("line_no"), text.alias("line"))).unionByName(total.select("design_id", F.lit(1 << 30).alias("line_no"), last.alias("line")))


def pack_stitches(s: DataFrame) -> DataFrame:
    """(design_id, packed): x, y, k of all records in order, flat."""
    one = s.groupBy("design_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "k"))).alias("p"))
    return one.select("design_id", F.flatten(F.transform("p", lambda p: F.array(p["x"], p["y"], p["k"]))).alias("packed"))


def unpack_stitches(packed: DataFrame) -> DataFrame:
    """The inverse of ``pack_stitches``; seq counts from 0."""
    rows = packed.select("design_id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("packed") / 3 - 1).cast("int")), lambda i: F.struct(*[F.get("packed", i * 3 + j).alias(c) for j, c in enumerate("xyk")]))).alias("seq", "p"))
    return rows.select("design_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y", "p.k")


#: Defaults of a settings record, in the units that their names say.
DEFAULTS = {"cell_mm": 0.2, "color_count": 8, "min_region_mm2": 2.0, "fill_spacing_mm": 0.4, "stitch_mm": 2.5, "pull_mm": 0.2, "trim_mm": 4.0, "underlay": True, "outline": "none", "range_id": "house"}


def with_settings(df: DataFrame, column: str = "settings", ranges: tuple[str, ...] = ("house",)) -> DataFrame:
    """Settings of a JSON column as columns: defaults where unset, 1 to 16 colours, no negative region, a known range."""
    kind = {bool: "boolean", int: "int", float: "double", str: "string"}
    parsed = F.from_json(column, ", ".join(f"{k} {kind[type(v)]}" for k, v in DEFAULTS.items()))
    out = df.withColumn("_s", parsed)
    get = {k: F.coalesce(F.col(f"_s.{k}"), F.lit(v)) for k, v in DEFAULTS.items()}
    get["color_count"] = F.greatest(F.lit(1), F.least(F.lit(16), get["color_count"]))
    get["min_region_mm2"] = F.greatest(F.lit(0.0), get["min_region_mm2"])
    get["range_id"] = F.when(get["range_id"].isin(*ranges), get["range_id"]).otherwise(DEFAULTS["range_id"])
    return out.withColumns(get).drop("_s", column)


def manifest(files: DataFrame) -> DataFrame:
    """(path, content) to (path, size, crc32)."""
    return files.select("path", F.octet_length("content").cast("long").alias("size"), F.crc32("content").alias("crc32"))


def roundtrip_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(design_id, n_a, n_b, differing): records that aren't equal, place by place."""
    side = lambda d, t: d.select("design_id", "seq", F.struct("x", "y", "k").alias(t))
    both = side(a, "p").join(side(b, "q"), ["design_id", "seq"], "full")
    return both.groupBy("design_id").agg(F.count("p").alias("n_a"), F.count("q").alias("n_b"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("differing"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one set and not of the other, with multiplicity: ``side`` is a or b."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
