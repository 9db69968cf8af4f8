"""Paths as ordered points (path_id, seq, x, y[, width]) in mm: arc length, resampling, smoothing, chains, emission."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.operators.graph import numbered
from seamline.operators.regions import SIDES, boundary_edges
from seamline.operators.stitch import COLOR, STITCH, TRIM
from seamline.operators.strips import changes, in_groups
from seamline.session import Scratch, cut, kept

#: Moves of up to so many mm are sewn straight wherever they lead.
SHORT = 1.5
#: Decimals of mm to which lengths count where they meet a limit, so that the last bits of a sum or root don't decide.
DECIDES = 6


def along() -> Window:
    return Window.partitionBy("path_id").orderBy("seq")


def with_arc(points: DataFrame) -> DataFrame:
    """``arc``: length from the path's start."""
    step = F.hypot(F.col("x") - F.lag("x").over(along()), F.col("y") - F.lag("y").over(along()))
    return points.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("arc", F.sum("_d").over(along().rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def _closed(points: DataFrame) -> Column:
    """Whether a point's path is a loop: its column ``closed``, where there is one."""
    return F.coalesce(F.col("closed"), F.lit(False)) if "closed" in points.columns else F.lit(False)


def smooth(points: DataFrame, k: int, values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Moving average over 2k + 1 points: loops (``closed``) go round, ends of open paths stay and stand for what lies beyond them; paths of two points stay.

    The points that an average needs from the other end are copied there, so one window over the path does both kinds.
    """
    n, i = F.count("*").over(Window.partitionBy("path_id")), F.row_number().over(along()) - 1
    rows = points.withColumns({"_n": n, "_i": i.cast("long"), "_closed": _closed(points)})
    i, last, reach = F.col("_i"), F.col("_n") - 1, F.ceil(F.lit(float(k)) / F.col("_n"))
    round_it = F.filter(F.transform(F.sequence(-reach, reach), lambda t: i + t * F.col("_n")), lambda p: (p >= -k) & (p <= last + k))
    beyond = F.when(i == 0, F.sequence(F.lit(-k).cast("long"), i)).when(i == last, F.sequence(i, i + k)).otherwise(F.array(i))
    rows = rows.withColumn("_p", F.explode(F.when(F.col("_closed"), round_it).otherwise(beyond)))
    w = Window.partitionBy("path_id").orderBy("_p").rowsBetween(-k, k)
    stays = (F.col("_n") <= 2) | (~F.col("_closed") & ((i == 0) | (i == last)))
    rows = rows.withColumns({f"_{c}": F.when(stays, F.col(c)).otherwise(F.avg(c).over(w)) for c in values}).where("_p = _i")
    return rows.withColumns({c: F.col(f"_{c}") for c in values}).drop("_n", "_i", "_p", "_closed", *(f"_{c}" for c in values))


def end_where_begun(points: DataFrame) -> DataFrame:
    """(path_id, seq, x, y, closed): loops get their first point once more at the end, unless they have it."""
    first = F.struct(*[F.first(c).over(along()).alias(c) for c in "xy"])
    rows = points.select("path_id", "seq", "x", "y", _closed(points).alias("closed"), first.alias("_f"), F.lead("seq").over(along()).isNull().alias("_last"))
    here = F.struct("x", "y")
    apart = F.hypot(F.col("x") - F.col("_f.x"), F.col("y") - F.col("_f.y")) > 1e-3
    each = F.when(F.col("closed") & F.col("_last") & apart, F.array(here, F.col("_f"))).otherwise(F.array(here))
    return rows.select("path_id", "seq", "closed", F.posexplode(each).alias("_i", "p")).select("path_id", (F.col("seq") + F.col("_i")).alias("seq"), "p.x", "p.y", "closed")


def interpolate_at(points: DataFrame, queries: DataFrame, values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``queries`` (path_id, s, ...) with the values at arc length s, clamped to the path: an as-of join.

    Points and queries of a path are sorted together once; each query takes the point before and the point after it, so the
    cost is one sort and not points times queries.
    """
    p = with_arc(points).select("path_id", F.col("arc").alias("at"), F.lit(0).alias("kind"), F.struct("arc", *values).alias("p"), F.lit(None).cast(_struct(queries)).alias("q"))
    ends = with_arc(points).groupBy("path_id").agg(F.max("arc").alias("total"))
    q = queries.join(ends, "path_id").withColumn("at", F.greatest(F.lit(0.0), F.least(F.col("total"), F.col("s"))))
    q = q.select("path_id", "at", F.lit(1).alias("kind"), F.lit(None).cast(p.schema["p"].dataType).alias("p"), F.struct(*queries.columns).alias("q"))
    w = Window.partitionBy("path_id").orderBy("at", "kind")
    back = Window.partitionBy("path_id").orderBy("at", F.desc("kind"))
    both = p.unionByName(q)
    both = both.withColumn("a", F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first("p", ignorenulls=True).over(back.rowsBetween(0, Window.unboundedFollowing)))
    t = F.coalesce(F.try_divide(F.col("at") - F.col("a.arc"), F.col("b.arc") - F.col("a.arc")), F.lit(0.0))
    return both.where("kind = 1").select("q.*", *[(F.col(f"a.{v}") + (F.col(f"b.{v}") - F.col(f"a.{v}")) * t).alias(v) for v in values])


def _struct(df: DataFrame):
    return df.schema


def resample(points: DataFrame, spacing: float) -> DataFrame:
    """(path_id, i, s, x, y, tx, ty): n + 1 even samples, n = round(length / spacing) at least 1, with unit tangents over up to 0.5 mm to each side, (0, 0) where
    the path turns back on itself and both of a tangent's ends meet. Paths of 0.05 mm or less give none. Lengths count to DECIDES decimals there.

    Loops (``closed``) are sampled back to their first point, and their tangents reach over it. Every segment makes the samples, and the ends of their tangents, that lie on it:
    its arc lengths tell which may, and each is then tested, so a place between two segments belongs to one. All of it follows one sort of the points.
    """
    w, whole = along(), Window.partitionBy("path_id")
    rows = with_arc(end_where_begun(points)).withColumn("_b", F.lead(F.struct("arc", "x", "y")).over(w))
    rows = rows.withColumns({"total": F.max("arc").over(whole), "closed": F.bool_or("closed").over(whole)}).where((F.round("total", DECIDES) > 0.05) & (F.col("arc") < F.col("_b.arc")))
    n = F.greatest(F.lit(1), F.round(F.round("total", DECIDES) / spacing)).cast("int")
    rows = rows.withColumns({"n": n, "delta": F.least(F.lit(0.5), F.col("total") / 4)}).withColumn("step", F.col("total") / F.col("n"))

    def among(shift: Column) -> Column:
        low, high = (F.greatest(F.lit(0), F.least(F.col("n"), f((F.col(c) - shift) / F.col("step")).cast("int"))) for f, c in ((F.floor, "arc"), (F.ceil, "_b.arc")))
        low, high = F.when(F.col("arc") <= 0, 0).otherwise(low), F.when(F.col("_b.arc") >= F.col("total"), F.col("n")).otherwise(high)  # what is clamped lies at the ends
        return F.sequence(low, high)

    def may(j: int) -> Column:
        at = F.array_union(among(F.lit(float(j)) * F.col("delta")), F.when(F.col("closed"), among(j * (F.col("delta") - F.col("total")))).otherwise(F.array().cast("array<int>")))
        return F.transform(at, lambda i: F.struct(F.lit(j).alias("j"), i.alias("i")))

    rows = rows.select("path_id", "arc", "x", "y", "_b", "total", "closed", "delta", "step", F.explode(F.concat(*(may(j) for j in (0, -1, 1)))).alias("v"))
    mid = F.col("v.i") * F.col("step")
    back, ahead = mid - F.col("delta"), mid + F.col("delta")
    side = lambda bound, to: F.when(F.col("closed"), F.pmod(to, "total")).otherwise(bound)
    s = F.when(F.col("v.j") == 0, mid).when(F.col("v.j") < 0, side(F.greatest(F.lit(0.0), back), back)).otherwise(side(F.least("total", ahead), ahead))
    rows = rows.withColumn("s", F.least("total", s))
    rows = rows.where((F.col("s") >= F.col("arc")) & ((F.col("s") < F.col("_b.arc")) | (F.col("_b.arc") >= F.col("total"))))
    t = (F.col("s") - F.col("arc")) / (F.col("_b.arc") - F.col("arc"))
    rows = rows.select("path_id", "v.i", "v.j", "s", *[(F.col(c) + (F.col(f"_b.{c}") - F.col(c)) * t).alias(c) for c in "xy"])
    at = lambda j, c: F.max(F.when(F.col("j") == j, F.col(c)))
    one = rows.groupBy("path_id", "i").agg(at(0, "s").alias("s"), at(0, "x").alias("x"), at(0, "y").alias("y"), (at(1, "x") - at(-1, "x")).alias("dx"), (at(1, "y") - at(-1, "y")).alias("dy"))
    size = F.hypot("dx", "dy")
    return one.select("path_id", "i", "s", "x", "y", *[F.when(size >= 10.0**-DECIDES, F.col(f"d{c}") / size).otherwise(0.0).alias(f"t{c}") for c in "xy"])


def zigzag(samples: DataFrame, width: Column) -> DataFrame:
    """(path_id, seq, x, y): a satin column, alternating by half ``width`` to each side, sewn from the last sample back."""
    half = width / 2 * F.when(F.col("i") % 2 == 0, 1).otherwise(-1)
    seq = F.row_number().over(Window.partitionBy("path_id").orderBy(F.desc("i"))) - 1
    return samples.select("path_id", seq.alias("seq"), (F.col("x") + F.col("ty") * half).alias("x"), (F.col("y") - F.col("tx") * half).alias("y"))


def _outline_sides(width: float, inward: bool, pull: float) -> tuple[float, float]:
    return (-pull / 2, width) if inward else (-width / 2, width / 2)


def outline_zigzag(samples: DataFrame, width: float, inward: bool, pull: float = 0.2) -> DataFrame:
    """(path_id, seq, x, y): a satin outline, sewn from the last sample back: from half of ``pull`` outside the border inwards, or centred on it.

    The area lies where the tangent (tx, ty) turned to (ty, -tx) points, as ``boundary_edges`` directs its sides.
    """
    low, high = _outline_sides(width, inward, pull)
    side = F.when(F.col("i") % 2 == 0, low).otherwise(high)
    seq = F.row_number().over(Window.partitionBy("path_id").orderBy(F.desc("i"))) - 1
    return samples.select("path_id", seq.alias("seq"), (F.col("x") + F.col("ty") * side).alias("x"), (F.col("y") - F.col("tx") * side).alias("y"))


def outline_centre(samples: DataFrame, width: float, inward: bool, pull: float = 0.2) -> DataFrame:
    """(path_id, seq, x, y): the run along the middle of a satin outline that goes under it, from the first sample on."""
    middle = sum(_outline_sides(width, inward, pull)) / 2
    return samples.select("path_id", F.col("i").alias("seq"), (F.col("x") + F.col("ty") * middle).alias("x"), (F.col("y") - F.col("tx") * middle).alias("y"))


def thin_path(points: DataFrame, gap: float = 0.5, least: float = 1.5) -> DataFrame:
    """(path_id, seq, x, y): points at least ``gap`` from the last kept one; chains under ``least`` mm go.

    Open chains keep their end too if it is over 0.1 away; loops (``closed``) end with their first point, which doesn't count for the length. Sorted points stream through a
    task that remembers the last kept one: linear in the points, and no chain is held as a whole.
    """
    w = along()
    spots = points.select("path_id", "seq", *(F.col(c).cast("double").alias(c) for c in "xy"), _closed(points).alias("closed"), F.lag("x").over(w).isNull().alias("begins"))
    held = T.StructType([*spots.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("lx", "ly", "length")), T.StructField("kept", T.BooleanType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros(3)  # the last kept point, and the length up to it
        for t in batches:
            x, y, begins = (t.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "begins"))
            out, kept = np.empty((3, len(x))), np.zeros(len(x), bool)
            stops = np.append(np.flatnonzero(begins), len(x))
            i = 0
            while i < len(x):
                if begins[i]:
                    state = np.array([x[i], y[i], 0.0])
                    kept[i], out[:, i] = True, state
                    i += 1
                    continue
                stop, size = stops[np.searchsorted(stops, i)], 8
                while True:  # the first one far enough, in blocks that double
                    d = np.hypot(x[i : min(i + size, stop)] - state[0], y[i : min(i + size, stop)] - state[1])
                    far = int(np.argmax(d >= gap)) if len(d) else 0
                    if (len(d) and d[far] >= gap) or i + size >= stop:
                        break
                    size *= 2
                if d[far] >= gap:
                    out[:, i : i + far] = state[:, None]
                    i += far
                    state = np.array([x[i], y[i], state[2] + d[far]])
                    kept[i], out[:, i] = True, state
                    i += 1
                else:
                    out[:, i:stop] = state[:, None]
                    i = stop
            yield pa.RecordBatch.from_arrays([*t.columns, *(pa.array(v) for v in out), pa.array(kept)], names=[*t.schema.names, "lx", "ly", "length", "kept"])

    rows = spots.repartition("path_id").sortWithinPartitions("path_id", "seq").mapInArrow(stream, held)
    here, first = F.struct("x", "y"), F.struct(F.first("x").over(w).alias("x"), F.first("y").over(w).alias("y"))
    last, rest = F.lead("x").over(w).isNull(), F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly"))
    tail = last & ~F.col("closed") & ~F.col("kept") & (rest > 0.1)
    whole = Window.partitionBy("path_id")
    rows = rows.withColumns({"_stays": F.col("kept") | tail, "_length": F.col("length") + F.when(tail, rest).otherwise(0.0), "_closes": last & F.col("closed"), "_first": first})
    rows = rows.withColumns({"_n": F.count_if("_stays").over(whole), "_size": F.max("_length").over(whole)}).where((F.col("_n") > 1) & (F.col("_size") >= least))
    each = F.concat(F.when(F.col("_stays"), F.array(here)).otherwise(F.array().cast("array<struct<x:double,y:double>>")), F.when(F.col("_closes"), F.array("_first")).otherwise(F.array().cast("array<struct<x:double,y:double>>")))
    out = rows.select("path_id", "seq", F.posexplode(each).alias("_j", "q"))
    seq = F.row_number().over(Window.partitionBy("path_id").orderBy("seq", "_j")) - 1
    return out.select("path_id", seq.alias("seq"), "q.x", "q.y")


def rank_chains(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(chain, seq, a, b, closed) of ``edges`` (edge, next): the order of elements in successor lists and loops.

    ``edge`` is a number, ``next`` the one after it or null. Pointer doubling: after log(longest) self joins each element knows how far its
    chain's end is. A loop is cut before its least element, which a doubling of minima finds. Raises if ``rounds`` don't do. Rounds are tables in the
    shared folder: a checkpoint keeps size estimates, which each join of a round with itself squares, until planning takes longer than the work.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.keep(edges.select("edge", "next"))
    # the least element that can be reached, and whether the end can
    reach = scratch.keep(e.select("edge", F.col("next").alias("to"), F.col("edge").alias("low"), F.lit(True).alias("moved")))
    for _ in range(rounds):
        step = reach.select(F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        new = scratch.keep(reach.join(step, "to", "left").select("edge", F.col("to2").alias("to"), F.least("low", F.coalesce("low2", "low")).alias("low"), (F.coalesce("low2", "low") < F.col("low")).alias("moved")))
        scratch.drop(reach)
        reach = new
        if new.where("moved").isEmpty() and (new.where("to is not null").isEmpty() or not _more(new)):
            break
    else:
        raise RuntimeError(f"chains not ranked in {rounds} rounds")
    loops = reach.where("to is not null").select("edge", "low")
    opened = e.join(loops, "edge", "left").select("edge", F.when(F.col("next") == F.col("low"), None).otherwise(F.col("next")).alias("next"), F.col("low").isNotNull().alias("closed"))
    hop = scratch.keep(opened.select("edge", F.col("next").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("left"), F.when(F.col("next").isNull(), F.col("edge")).alias("tail"), "closed"))
    for _ in range(rounds):
        if hop.where("to is not null").isEmpty():
            break
        step = hop.select(F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"), F.col("tail").alias("tail2"))
        new = scratch.keep(hop.join(step, "to", "left").select("edge", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left"), F.coalesce("tail", "tail2").alias("tail"), "closed"))
        scratch.drop(hop)
        hop = new
    else:
        raise RuntimeError(f"chains not ranked in {rounds} rounds")
    seq = F.row_number().over(Window.partitionBy("tail").orderBy(F.desc("left"))) - 1
    return hop.select(F.col("tail").alias("chain"), seq.alias("seq"), "edge", "closed")


def _more(reach: DataFrame) -> bool:
    """Whether an element that hasn't met an end may still: its pointer leads to one whose pointer ends."""
    ended = reach.where("to is null").select(F.col("edge").alias("to"))
    return not reach.where("to is not null").join(ended, "to", "left_semi").isEmpty()


#: Cells up to which an image's borders are chained in one task, about 500 bytes each; larger images go by joins, and their paths' numbers begin at LARGE_PATHS.
IMAGE_CELLS, LARGE_PATHS = 1 << 20, 1 << 62


def boundary_chains(cells: DataFrame, cell_mm: float, dedupe: bool = False) -> DataFrame:
    """(image_id, comp_id, path_id, seq, x, y, closed): smoothed and thinned borders of the components of ``cells`` (image_id, x, y, comp_id), in mm.

    Sides are chained where one ends and another starts; at a corner that two sides leave, sorted ways in take sorted ways out.
    With ``dedupe`` a border between two components is kept for the lower number only, which leaves open chains. Numbers of paths tell them apart and grow, within an image, with their last sides (component,
    then place). Images of up to IMAGE_CELLS cells are chained in one task, many at a time.
    """
    key = ["image_id", "comp_id"]
    cells = kept(cells.select("image_id", "x", "y", "comp_id"))
    large = cut(cells.groupBy("image_id").count().where(F.col("count") > IMAGE_CELLS).select("image_id"))
    if large.isEmpty():
        points = _chained_by_images(cells, cell_mm, dedupe)
    else:
        points = _chained_by_images(cells.join(large, "image_id", "left_anti"), cell_mm, dedupe)
        points = points.unionByName(_chained_by_joins(cells.join(large, "image_id", "left_semi"), cell_mm, dedupe).withColumn("path_id", F.col("path_id") + LARGE_PATHS))
    points = kept(points)
    of = points.where("seq = 0").select("path_id", *key, "closed")
    return thin_path(smooth(points, 2)).join(of, "path_id").select(*key, "path_id", "seq", "x", "y", "closed")


def _ranked(next_: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tail, left, closed) of elements with their successors, or their number where there is none: ``rank_chains`` in memory, for chains of up to 2 ** rounds elements."""
    n = len(next_)
    to, low = np.append(next_, n), np.arange(n + 1)
    for _ in range(rounds):
        low, to = np.minimum(low, low[to]), to[to]
    closed = to[:n] < n
    next_ = np.where(closed & (next_ == low[:n]), n, next_)
    to, left = np.append(next_, n), np.append((next_ < n).astype(np.int64), 0)
    tail = np.where(next_ < n, next_, np.arange(n))
    for _ in range(rounds):
        left, to, tail = left + left[to], to[to], tail[tail]
    return tail, left[:n], closed


def _chained_by_images(cells: DataFrame, cell_mm: float, dedupe: bool) -> DataFrame:
    """(image_id, comp_id, path_id, seq, x, y, closed): corners along the borders of whole images."""

    def chained(t: pa.Table, base: int) -> pa.Table:
        image, comp, x, y = (t[c].to_numpy() for c in ("image_id", "comp_id", "x", "y"))
        begins = changes(image)
        number, first = np.cumsum(begins) - 1, np.flatnonzero(begins)
        x0, y0 = (np.minimum.reduceat(v, first).astype(np.int64) for v in (x, y))
        x, y = x - x0[number], y - y0[number]
        wide, high = int(x.max()) + 3, int(y.max()) + 3
        at = (number * high + y + 1) * wide + x + 1
        edges = []
        for (dx, dy), a, b in SIDES:
            there = at + dy * wide + dx
            place = np.minimum(np.searchsorted(at, there), len(at) - 1)
            other = np.where(at[place] == there, comp[place], -1)
            own = np.flatnonzero((other != comp) & ((other < 0) | (other >= comp)) if dedupe else other != comp)
            edges.append(np.array([number[own], comp[own], y[own] + a[1], x[own] + a[0], y[own] + b[1], x[own] + b[0]]))
        edges = np.concatenate(edges, axis=1)
        edges = edges[:, np.lexsort(edges[::-1])]
        number, comp, ay, ax, by, bx = edges
        area = np.cumsum(changes(number, comp))
        starts, ends = ((area * high + v) * wide + u for u, v in ((ax, ay), (bx, by)))
        out, into = np.lexsort((by, bx, starts)), np.lexsort((ay, ax, ends))
        starts, ends = starts[out], ends[into]
        turn = np.arange(len(ends)) - np.searchsorted(ends, ends)  # the how manyth way in, which takes that way out
        way = np.searchsorted(starts, ends) + turn
        next_ = np.full(len(ends), len(ends))
        goes = way < np.searchsorted(starts, ends, "right")
        next_[into[goes]] = out[way[goes]]
        tail, left, closed = _ranked(next_, int(np.bincount(area).max()).bit_length())
        size = np.bincount(tail, minlength=len(tail))[tail]
        seq = size - 1 - left
        some = size + ~closed >= 3
        last = np.flatnonzero(some & ~closed & (left == 0))  # open chains end with their last side's end
        some = np.flatnonzero(some)
        both = np.append(some, last)
        px, py = np.append(ax[some], bx[last]), np.append(ay[some], by[last])
        out_ = {"image_id": image[first][number[both]], "comp_id": comp[both], "path_id": base + tail[both], "seq": np.append(seq[some], seq[last] + 1).astype(np.int32)}
        return pa.table(out_ | {"x": (px + x0[number[both]]) * cell_mm, "y": (py + y0[number[both]]) * cell_mm, "closed": closed[both]})

    rows = cells.select(*[F.col(c).cast("long").alias(c) for c in ("image_id", "comp_id", "x", "y")])
    return in_groups(rows, ["image_id"], ["image_id", "y", "x"], lambda t: [t["image_id"].to_numpy()], chained, "image_id long, comp_id long, path_id long, seq int, x double, y double, closed boolean")


def _chained_by_joins(cells: DataFrame, cell_mm: float, dedupe: bool) -> DataFrame:
    """``_chained_by_images`` of images of any size."""
    key = ["image_id", "comp_id"]
    e = numbered(boundary_edges(cells, dedupe), *key, "ay", "ax", "by", "bx").withColumnRenamed("node", "edge")
    out, into = (Window.partitionBy(*key, *k) for k in (("ax", "ay"), ("bx", "by")))
    e = e.withColumns({"i": F.row_number().over(out.orderBy("bx", "by")), "o": F.row_number().over(into.orderBy("ax", "ay"))})
    e = cut(e)
    after = e.select(*key, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("i").alias("o"), F.col("edge").alias("next"))
    chain = rank_chains(e.join(after, [*key, "bx", "by", "o"], "left").select("edge", "next"))
    rows = chain.join(e, "edge").select(*key, F.col("chain").alias("path_id"), "seq", "ax", "ay", "bx", "by", "closed")
    ends = F.lead("seq").over(along()).isNull() & ~F.col("closed")
    a, b = (F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab")
    spots = rows.withColumn("_end", ends).select(*key, "path_id", "seq", "closed", F.posexplode(F.when(F.col("_end"), F.array(a, b)).otherwise(F.array(a))).alias("_i", "p"))
    points = spots.select(*key, "path_id", (F.col("seq") + F.col("_i")).alias("seq"), *[(F.col(f"p.{c}") * cell_mm).alias(c) for c in "xy"], "closed")
    return points.withColumn("_n", F.count("*").over(Window.partitionBy("path_id"))).where("_n >= 3").drop("_n")


def subdivide(legs: DataFrame, max_len: float) -> DataFrame:
    """(leg, i, x, y): each leg (leg, x0, y0, x1, y1) in ceil(length / max_len) equal stitches; legs under 0.05 mm give none. Lengths count to DECIDES decimals."""
    size = F.round(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), DECIDES)
    n = legs.withColumn("n", F.ceil(size / max_len).cast("int")).where(size >= 0.05)
    rows = n.select("*", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    part = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") / F.col("n"))
    return rows.select("leg", "i", part("x0", "x1").alias("x"), part("y0", "y1").alias("y"))


def add_ties(points: DataFrame, length: float = 0.6) -> DataFrame:
    """(path_id, seq, x, y) with a tie-in after the first point (up to ``length`` forward and back) and a tie-off at the end (``length`` back and forth again)."""
    lead, lag = (lambda c: F.lead(c).over(along())), (lambda c: F.lag(c).over(along()))
    rows = points.withColumns({"nx": lead("x"), "ny": lead("y"), "px": lag("x"), "py": lag("y")})
    here = F.struct("x", "y")

    def toward(tx: str, ty: str, reach: Column) -> Column:
        d = F.hypot(F.col(tx) - F.col("x"), F.col(ty) - F.col("y"))
        return F.struct((F.col("x") + F.try_divide(F.col(tx) - F.col("x"), d) * reach).alias("x"), (F.col("y") + F.try_divide(F.col(ty) - F.col("y"), d) * reach).alias("y"))

    ahead, behind = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")), F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    first = F.col("px").isNull() & F.coalesce(ahead > 0.01, F.lit(False))
    last = F.col("nx").isNull() & F.coalesce(behind > 0.01, F.lit(False))
    tie = F.when(first, F.array(here, toward("nx", "ny", F.least(F.lit(length), ahead)), here)).when(last, F.array(here, toward("px", "py", F.lit(length)), here)).otherwise(F.array(here))
    out = rows.select("path_id", F.col("seq").alias("_s"), F.posexplode(tie).alias("_i", "p"))
    seq = F.row_number().over(Window.partitionBy("path_id").orderBy("_s", "_i")) - 1
    return out.select("path_id", seq.alias("seq"), "p.x", "p.y")


def travel_kind(pieces: DataFrame, trim_mm: float) -> DataFrame:
    """``kind`` of the move to each piece (design_id, seq, thread_id, x0, y0, x1, y1[, inside][, way]): start, color, none, run or trim.

    ``inside`` says whether the straight way stays in the area (see ``segments_in_mask``), ``way`` (see ``ways_in_mask``) is the one round its holes or null; without them only
    short ways are sewn. ``way`` becomes null where it isn't taken: no move or a short one, a straight one that stays inside, a new thread.
    Lengths count to DECIDES decimals.
    """
    w = Window.partitionBy("design_id").orderBy("seq")
    d = F.round(F.hypot(F.col("x0") - F.lag("x1").over(w), F.col("y0") - F.lag("y1").over(w)), DECIDES)
    inside = F.coalesce(F.col("inside"), F.lit(False)) if "inside" in pieces.columns else F.lit(False)
    round_it = F.col("way").isNotNull() if "way" in pieces.columns else F.lit(False)
    straight = (d <= min(trim_mm, SHORT)) | inside
    kind = F.when(d.isNull(), "start").when(F.lag("thread_id").over(w) != F.col("thread_id"), "color").when(d < 0.05, "none").when(straight | round_it | (d <= trim_mm), "run").otherwise("trim")
    out = pieces.withColumn("kind", kind)
    if "way" in pieces.columns:
        out = out.withColumn("way", F.when((kind == "run") & ~straight, F.col("way")))
    return out


def travel_records(pieces: DataFrame) -> DataFrame:
    """(design_id, seq, i, x, y, k): the stitch records that bring the needle to each piece of ``travel_kind``, in 0.1 mm.

    A start is a stitch; a new thread and a cut are their mark and a stitch at the same point; a run is a leg of stitches of up to
    3 mm, or one such leg to each point of its ``way`` and on. Ties are ``add_ties``' work.
    """
    w = Window.partitionBy("design_id").orderBy("seq")
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    between = F.coalesce(F.col("way"), none) if "way" in pieces.columns else none
    ways = pieces.withColumns({"px": F.lag("x1").over(w), "py": F.lag("y1").over(w)}).select("design_id", "seq", "kind", "x0", "y0", "px", "py", between.alias("way"))
    mark = F.when(F.col("kind") == "start", F.array(F.lit(STITCH))).when(F.col("kind") == "color", F.array(F.lit(COLOR), F.lit(STITCH))).when(F.col("kind") == "trim", F.array(F.lit(TRIM), F.lit(STITCH)))
    jumps = ways.select("design_id", "seq", F.posexplode(mark).alias("i", "k"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    turns = ways.where("kind = 'run'").withColumn("p", F.concat(F.array(point("px", "py")), "way", F.array(point("x0", "y0"))))
    legs = turns.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    at = lambda j: F.element_at("p", j)
    legs = legs.select(F.struct("design_id", "seq", "j").alias("leg"), *[at(F.col("j") + k)[c].alias(f"{c}{k}") for k in (0, 1) for c in "xy"])
    i = F.row_number().over(Window.partitionBy("leg.design_id", "leg.seq").orderBy("leg.j", "i")) - 1
    sewn = subdivide(legs, 3.0).select("leg.design_id", "leg.seq", i.alias("i"), F.lit(STITCH).alias("k"), "x", "y")
    return jumps.unionByName(sewn).select("design_id", "seq", "i", *[F.round(F.round(F.col(c) * 10, 6)).cast("int").alias(c) for c in "xy"], "k")
