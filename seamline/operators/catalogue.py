"""Thread catalogues: nearest shade, lookups, search, range switches.

A catalogue holds the shade cards of a few makers. Its broadcast is behind a check: ``small`` broadcasts up to MAX_SHADES rows
(about 200 bytes each) and leaves larger tables to a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions.colour import chroma_ratio, describe_color, lab_dist2, rgb_to_lab, with_delta_e2000
from seamline.session import cut, shuffle_partitions

MAX_SHADES = 50_000
_COLOUR = ["range_id", "r", "g", "b"]
#: CIEDE2000 is at least the lightness difference over 1 + 0.015 * 50**2 / sqrt(20 + 50**2), its weight's largest value.
LIGHTNESS_SPAN = 1.7471
#: Side in Lab of the boxes whose colours share a list of shades.
BOX = 6
#: Pieces of a range's shades that meet its boxes apart from each other.
PIECES = 64


def small(df: DataFrame, most: int = MAX_SHADES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def matchable(threads: DataFrame) -> DataFrame:
    """Without the pseudo-colours, which are never chosen automatically."""
    return threads.where("matchable")


def _shades(threads: DataFrame) -> DataFrame:
    return small(matchable(threads).select("range_id", "ord", "thread_id", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("_q")))


def _first_shades(threads: DataFrame, n: int = 1) -> DataFrame:
    """``_shades`` without those that ``n`` earlier ones of their range have the colour of: in a large catalogue far fewer."""
    order = Window.partitionBy(*_COLOUR).orderBy("ord", "thread_id")
    first = matchable(threads).select(*_COLOUR, "ord", "thread_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return small(first.select("range_id", "ord", "thread_id", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("_q")))


def _distinct_colours(colours: DataFrame) -> DataFrame:
    """Distinct (range_id, r, g, b) with ``_p``, their Lab; dealt out by number once made, as a few MB of them become very many pairs."""
    own = colours.select(*_COLOUR).distinct().repartition(shuffle_partitions(colours.sparkSession))
    return own.withColumn("_p", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))


def distances(colours: DataFrame, threads: DataFrame) -> DataFrame:
    """Every distinct colour of ``colours`` (range_id, r, g, b) with the matchable shades of its range: d, ord, thread_id."""
    return with_delta_e2000(_distinct_colours(colours).join(_shades(threads), "range_id"), "_p", "_q", "d").drop("_p", "_q")


def _met(boxes: DataFrame, shades: DataFrame, *key: str) -> DataFrame:
    """``boxes`` with the shades of their range that agree in ``key``: few MB of rows that become very many pairs, so shades are dealt out in pieces and every piece meets all boxes of its range.

    The pieces' number of tasks is given, as adaptive execution would put so few bytes into one or two.
    """
    n = shuffle_partitions(shades.sparkSession)
    on = ["range_id", "_piece"]
    dealt = shades.withColumn("_piece", F.pmod(F.xxhash64("ord", "thread_id"), F.lit(min(n, PIECES))).cast("int")).repartition(n, *on)
    each = boxes.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(min(n, PIECES) - 1)))).repartition(n, *on)
    return each.join(dealt, [*on, *key]).drop("_piece")


def _bounds(pairs: DataFrame, key: list[str], value: Column, n: int) -> DataFrame:
    """``key`` with ``_bound``, which the n least of ``value`` don't pass: the largest of the least values of n disjoint sets of shades (``_k``), without end if a set is empty."""
    least = pairs.groupBy(*key).agg(*[F.min(F.when(F.col("_k") == k, value)).alias(f"_{k}") for k in range(n)])
    sets = F.array(*[F.coalesce(f"_{k}", F.lit(float("inf"))) for k in range(n)])
    return least.select(*key, F.array_max(sets).alias("_bound"))


def _plane_weight(chroma: Column) -> Column:
    """What the terms of chroma and hue of CIEDE2000 are at least, over the squared distance in a and b, for a mean chroma of at most ``chroma``.

    Together they make at least that distance over the largest weight of chroma, times what the turning term leaves: it takes sin(60 degrees) at most.
    """
    grown = (1.5 - 0.5 * chroma_ratio(chroma)) * chroma  # grows with the chroma, so the largest one bounds all
    return (1 - 0.8661 * chroma_ratio(grown)) / F.pow(1 + 0.045 * grown, F.lit(2.0))


def _at_least(lo: Column, hi: Column, weight: Column, q: Column) -> Column:
    """The square of what CIEDE2000 between a shade ``q`` and the colours of a Lab box is at least."""
    gap = {c: F.greatest(lo[c] - q[c], q[c] - hi[c], F.lit(0.0)) for c in "lab"}
    return F.pow(gap["l"] / LIGHTNESS_SPAN, F.lit(2.0)) + (F.pow(gap["a"], F.lit(2.0)) + F.pow(gap["b"], F.lit(2.0))) * weight


def _nearest(colours: DataFrame, threads: DataFrame, n: int) -> DataFrame:
    """(range_id, r, g, b, d, ord, thread_id): of each distinct colour the n nearest shades and few others.

    Colours of one box in Lab share a list of shades. The shades nearest to the box's middle bound what its colours look at, so the list
    leaves out what lies further off (``_at_least``); each colour's distances to its list then bound it anew. Pairs are never sorted: only minima and the pairs within the last bound are kept.
    """
    box = ["range_id", "_box"]
    shades = _first_shades(threads, n).withColumn("_k", F.pmod(F.xxhash64("ord", "thread_id"), F.lit(n)))
    sides = F.struct(*[F.floor(F.col(f"_p.{c}") / BOX).cast("int").alias(c) for c in "lab"])
    own = cut(_distinct_colours(colours).withColumn("_box", sides))
    middle = F.struct(*[((F.col(f"_box.{c}") + 0.5) * BOX).alias(c) for c in "lab"])
    boxes = own.select(*box).distinct().withColumn("_m", middle).repartition(shuffle_partitions(colours.sparkSession))
    far = lab_dist2(F.col("_m"), F.col("_q"))
    close = _met(boxes, shades).groupBy(*box, "_m", "_k").agg(F.min(far).alias("_least"))
    guides = _met(close, shades, "_k").where(far == F.col("_least")).select(*box, "_k", "_q")
    key = [*_COLOUR, "_box", "_p"]
    first = cut(_bounds(with_delta_e2000(own.join(guides, box), "_p", "_q", "_d"), key, F.col("_d"), n))
    ends = [F.struct(*[f(f"_p.{c}").alias(c) for c in "lab"]).alias(name) for name, f in (("_lo", F.min), ("_hi", F.max))]
    around = first.groupBy(*box).agg(*ends, F.max(F.hypot("_p.a", "_p.b")).alias("_c"), F.max("_bound").alias("_all")).repartition(shuffle_partitions(colours.sparkSession))
    most = F.pow(F.col("_all") + 1e-6, F.lit(2.0))
    weight = _plane_weight((F.col("_c") + F.col("_qc")) / 2)
    met = _met(around, shades.withColumn("_qc", F.hypot("_q.a", "_q.b")))
    met = met.where(_at_least(F.col("_lo"), F.col("_hi"), F.lit(0.0), F.col("_q")) <= most).where(_at_least(F.col("_lo"), F.col("_hi"), weight, F.col("_q")) <= most)
    listed = cut(met.select(*box, "_k", "ord", "thread_id", "_q", weight.alias("_w")))

    def within(bounded: DataFrame) -> DataFrame:
        near = bounded.join(listed, box).where(_at_least(F.col("_p"), F.col("_p"), F.col("_w"), F.col("_q")) <= F.pow(F.col("_bound") + 1e-6, F.lit(2.0)))
        return with_delta_e2000(near, "_p", "_q", "_d")

    last = cut(_bounds(within(first), key, F.col("_d"), n))
    # the filter stays above explode: below it, it would take in all steps of the distance anew for each of their uses
    found = within(last).withColumn("d", F.explode(F.array("_d")))
    return found.where(F.col("d") <= F.col("_bound") + 1e-9).select(*_COLOUR, "d", "ord", "thread_id")


def nearest_thread(colours: DataFrame, threads: DataFrame) -> DataFrame:
    """``colours`` with the nearest ``thread_id`` of their range by CIEDE2000; the earlier in the list of equals; null if the range is unknown.

    Colours of one box in Lab share a list of shades, see ``_nearest``; only the pairs within a colour's least distance are sorted.
    """
    best = _nearest(colours, threads, 1).groupBy(*_COLOUR).agg(F.min(F.struct("d", "ord", "thread_id")).alias("_m"))
    return colours.join(best.select(*_COLOUR, F.col("_m.thread_id").alias("thread_id"), F.col("_m.d").alias("delta_e")), _COLOUR, "left")


def top_threads(colours: DataFrame, threads: DataFrame, n: int) -> DataFrame:
    """(range_id, r, g, b, place, thread_id, d): the n nearest shades of each distinct colour."""
    w = Window.partitionBy("range_id", "r", "g", "b").orderBy("d", "ord")
    return _nearest(colours, threads, n).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("range_id", "r", "g", "b", "place", "thread_id", "d")


def build_catalogue(raw: DataFrame, machine_threads: DataFrame) -> DataFrame:
    """Raw shade cards (range_id, maker, brand, code, r, g, b, ord) with thread_id, English name and the nearest machine shade.

    ``machine_threads`` (range_id, ord, thread_id, machine_index, r, g, b, matchable) is one range.
    """
    named = raw.withColumn("thread_id", F.concat_ws("-", "range_id", "code")).withColumn("name", describe_color(F.col("r"), F.col("g"), F.col("b"))).withColumn("matchable", F.lit(True))
    one = machine_threads.withColumn("range_id", F.lit("machine"))
    near = nearest_thread(raw.select(F.lit("machine").alias("range_id"), "r", "g", "b").distinct(), one).select("r", "g", "b", F.col("thread_id").alias("_t"))
    index = small(machine_threads.select(F.col("thread_id").alias("_t"), "machine_index"))
    return named.join(near.join(index, "_t"), ["r", "g", "b"], "left").drop("_t")


def find_thread(keys: DataFrame, threads: DataFrame) -> DataFrame:
    """``keys`` (thread_id, ...) with the thread's columns, null where there is none."""
    return keys.join(small(threads), "thread_id", "left")


def machine_thread(keys: DataFrame, machine_threads: DataFrame, fallback: int = 20) -> DataFrame:
    """``keys`` (machine_index, ...) with ``machine_thread_id``; an unknown index counts as ``fallback``."""
    own = machine_threads.groupBy("machine_index").agg(F.min(F.struct("ord", "thread_id")).alias("m")).select("machine_index", F.col("m.thread_id").alias("machine_thread_id"))
    other = own.where(F.col("machine_index") == fallback).select(F.col("machine_thread_id").alias("_fallback"), F.lit(1).alias("_one"))
    out = keys.join(small(own), "machine_index", "left").withColumn("_one", F.lit(1)).join(F.broadcast(other), "_one", "left")  # one row
    return out.withColumn("machine_thread_id", F.coalesce("machine_thread_id", "_fallback")).drop("_fallback", "_one")


def search_threads(threads: DataFrame, query: Column, range_id: str | None = None) -> DataFrame:
    """Shades whose code or lower-case name holds the trimmed, lower-cased query, in one range or in all."""
    q = F.lower(F.trim(query))
    hit = threads.where(F.contains(F.col("code"), q) | F.contains(F.lower("name"), q))
    return hit.where(F.col("range_id") == range_id) if range_id else hit


def switch_range(choices: DataFrame, threads: DataFrame, old: str, new: str) -> DataFrame:
    """``choices`` (..., thread_id, r, g, b) with threads of range ``old`` matched again in ``new``; others stay."""
    mine = threads.select("thread_id", F.col("range_id").alias("_range"))
    c = choices.join(small(mine), "thread_id", "left").withColumn("range_id", F.lit(new)).withColumnRenamed("thread_id", "_had")
    c = nearest_thread(c, threads)
    return c.withColumn("thread_id", F.when(F.col("_range") == old, F.coalesce("thread_id", "_had")).otherwise(F.col("_had"))).drop("_range", "_had", "delta_e", "range_id")


def carry_choices(new: DataFrame, previous: DataFrame) -> DataFrame:
    """``new`` (image_id, cluster, r, g, b) with thread_id and enabled of the first earlier cluster of its image whose colour differs by less than 12 in all."""
    p = previous.select("image_id", F.col("cluster").alias("_c"), *[F.col(c).alias(f"_{c}") for c in "rgb"], F.col("thread_id").alias("_t"), F.col("enabled").alias("_e"))
    gap = sum((F.abs(F.col(c) - F.col(f"_{c}")) for c in "rgb"), F.lit(0))
    same = new.join(p, "image_id").where(gap < 12).groupBy("image_id", "cluster").agg(F.min(F.struct("_c", "_t", "_e")).alias("m"))
    return new.join(same, ["image_id", "cluster"], "left").select(new["*"], F.col("m._t").alias("thread_id"), F.col("m._e").alias("enabled"))


def default_choices(clusters: DataFrame) -> DataFrame:
    """Clusters of more than 0.05 % coverage; the background is off at first."""
    return clusters.where("coverage > 0.0005").withColumn("enabled", ~F.col("is_background"))


def rank_colours(clusters: DataFrame) -> DataFrame:
    """``place`` of each cluster by coverage, largest first, equals by number."""
    return clusters.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("coverage"), "cluster")))


def range_counts(threads: DataFrame) -> DataFrame:
    """Shades by maker and range, by maker, and in all (nulls)."""
    return threads.rollup("maker", "range_id").agg(F.count("*").alias("shades"))


def union_catalogues(*parts: DataFrame) -> DataFrame:
    """One catalogue of all ranges; of equal ids the row of the earliest part stays."""
    rows = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("_part", F.lit(i)))
    w = Window.partitionBy("thread_id").orderBy("_part", "ord")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_part")
