"""Colour functions: Column in, Column out, no UDFs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The D65 white point, the sRGB and Lab matrices and knees as the colour tables state them.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
KNEE, SLOPE, OFFSET = 0.008856, 7.787, 16 / 116


def _weighted(weights: tuple, parts: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, [F.lit(w) * c for w, c in zip(weights, parts, strict=True)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """CIE Lab of sRGB 0-255 as struct<l, a, b>. Each step is evaluated once (``let``): written out, the thirty powers of a colour can make a stage's method too long for the JVM to compile."""

    def linear(c: Column) -> Column:
        v = c / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    def lab_part(t: Column) -> Column:
        return F.when(t > KNEE, F.cbrt(t)).otherwise(F.lit(SLOPE) * t + F.lit(OFFSET))

    def xyz(rgb: Column) -> Column:
        return F.struct(*[(_weighted(w, [rgb[c] for c in "rgb"]) / n).alias(c) for c, w, n in zip("xyz", TO_XYZ, WHITE, strict=True)])

    def lab(f: Column) -> Column:
        return F.struct((F.lit(116) * f["y"] - 16).alias("l"), (F.lit(500) * (f["x"] - f["y"])).alias("a"), (F.lit(200) * (f["y"] - f["z"])).alias("b"))

    parts = let(let(F.struct(*[linear(c).alias(n) for c, n in zip((r, g, b), "rgb", strict=True)]), xyz), lambda t: F.struct(*[lab_part(t[c]).alias(c) for c in "xyz"]))
    return let(parts, lab)


def lab_to_rgb(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """sRGB of CIE Lab as struct<r, g, b> of doubles, clamped to 0-255 and not rounded."""
    fy = (l + 16) / 116
    cube = lambda t: F.when(t * t * t > KNEE, t * t * t).otherwise((t - F.lit(OFFSET)) / SLOPE)
    xyz = [cube(t) * w for t, w in zip((fy + a / 500, fy, fy - b / 200), WHITE, strict=True)]

    def gamma(c: Column) -> Column:
        v = F.when(c <= 0.0031308, c * 12.92).otherwise(F.lit(1.055) * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v * 255))

    return F.struct(*[gamma(_weighted(w, xyz)).alias(n) for w, n in zip(TO_RGB, "rgb", strict=True)])


def lab_dist2(p: Column, q: Column) -> Column:
    """Squared Euclidean distance of two Lab structs."""
    parts = [p[c] - q[c] for c in ("l", "a", "b")]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def chroma_ratio(c: Column) -> Column:
    return F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7))


def _angle(y: Column, x: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def _cos(deg: Column) -> Column:
    return F.cos(F.radians(deg))


#: CIEDE2000 step by step: names, and each step's Column from those before it (l1, a1, b1, l2, a2, b2 come first).
_STEPS: list[tuple[str, Callable[[dict[str, Column]], Column]]] = [
    ("grow", lambda v: 1.5 - 0.5 * chroma_ratio((F.hypot(v["a1"], v["b1"]) + F.hypot(v["a2"], v["b2"])) / 2)),
    ("x1", lambda v: v["grow"] * v["a1"]),
    ("x2", lambda v: v["grow"] * v["a2"]),
    ("c1", lambda v: F.hypot(v["x1"], v["b1"])),
    ("c2", lambda v: F.hypot(v["x2"], v["b2"])),
    ("h1", lambda v: _angle(v["b1"], v["x1"])),
    ("h2", lambda v: _angle(v["b2"], v["x2"])),
    ("grey", lambda v: v["c1"] * v["c2"] == 0),
    ("gap", lambda v: v["h2"] - v["h1"]),
    ("total", lambda v: v["h1"] + v["h2"]),
    ("turn", lambda v: F.when(v["grey"], 0.0).when(v["gap"] > 180, v["gap"] - 360).when(v["gap"] < -180, v["gap"] + 360).otherwise(v["gap"])),
    ("mid_h", lambda v: F.when(v["grey"], v["total"]).when(F.abs(v["gap"]) <= 180, v["total"] / 2).when(v["total"] < 360, (v["total"] + 360) / 2).otherwise((v["total"] - 360) / 2)),
    ("mid_c", lambda v: (v["c1"] + v["c2"]) / 2),
    ("off", lambda v: F.pow((v["l1"] + v["l2"]) / 2 - 50, F.lit(2.0))),
    ("t", lambda v: 1 - 0.17 * _cos(v["mid_h"] - 30) + 0.24 * _cos(2 * v["mid_h"]) + 0.32 * _cos(3 * v["mid_h"] + 6) - 0.2 * _cos(4 * v["mid_h"] - 63)),
    ("dl", lambda v: (v["l2"] - v["l1"]) / (1 + 0.015 * v["off"] / F.sqrt(20 + v["off"]))),
    ("dc", lambda v: (v["c2"] - v["c1"]) / (1 + 0.045 * v["mid_c"])),
    ("dh", lambda v: 2 * F.sqrt(v["c1"] * v["c2"]) * F.sin(F.radians(v["turn"] / 2)) / (1 + 0.015 * v["mid_c"] * v["t"])),
    ("bend", lambda v: F.exp(-F.pow((v["mid_h"] - 275) / 25, F.lit(2.0))) * 60),
    ("d", lambda v: F.sqrt(v["dl"] * v["dl"] + v["dc"] * v["dc"] + v["dh"] * v["dh"] - F.sin(F.radians(v["bend"])) * 2 * chroma_ratio(v["mid_c"]) * v["dc"] * v["dh"])),
]


def with_delta_e2000(df, p: str, q: str, out: str):
    """``df`` with the CIEDE2000 difference (Sharma, Wu and Dalal 2005) of its Lab structs ``p`` and ``q`` as ``out``.

    Hue wrap and zero chroma are taken care of. The steps are columns, so that each is evaluated once and compiles.
    """
    made = {f"{c}{i}": F.col(f"{s}.{c}") for i, s in ((1, p), (2, q)) for c in "lab"}
    df = df.withColumns({f"_{n}": c for n, c in made.items()})
    made = {n: F.col(f"_{n}") for n in made}
    for name, step in _STEPS[:-1]:
        df = df.withColumn(f"_{name}", step(made))
        made[name] = F.col(f"_{name}")
    return df.withColumn(out, _STEPS[-1][1](made)).drop(*[f"_{n}" for n in made])


def describe_color(r: Column, g: Column, b: Column) -> Column:
    """Plain English name of an sRGB colour: greys by lightness, hue bands, earthy overrides, then dark, pale or light."""
    # Upper ends of the hue bands.
    bands = [(50, "red"), (78, "orange"), (90, "gold"), (108, "yellow"), (135, "olive"), (185, "green"), (215, "teal"), (304, "blue"), (335, "purple")]

    def banded(c: Column) -> Column:
        base = F.when((c["hue"] < 12) | (c["hue"] >= 350), "pink")
        for end, name in bands:
            base = base.when(c["hue"] < end, name)
        return F.struct(c["l"].alias("l"), c["chroma"].alias("chroma"), c["hue"].alias("hue"), base.otherwise("magenta").alias("base"))

    def earthy(c: Column) -> Column:
        light, chroma, hue = c["l"], c["chroma"], c["hue"]
        warm = F.when((hue >= 45) & (hue < 110) & (light > 70) & (chroma < 35), "beige").when((hue >= 12) & (hue < 45) & (light < 35), "maroon")
        return warm.when((hue >= 15) & (hue < 100) & (light < 55) & (chroma < 70) & (c["base"] != "red"), "brown").otherwise(c["base"])

    def shaded(c: Column) -> Column:
        light, chroma = c["l"], c["chroma"]
        grey = F.when(light < 18, "black").when(light > 92, "white").when(light > 80, "off-white").when(light < 40, "dark grey").when(light < 65, "grey").otherwise("light grey")
        turned = lambda w: F.when((w == "pink") & (light < 40), "burgundy").when((w == "olive") & (light > 75), "lime").when((w == "yellow") & (light < 60), "olive").otherwise(w)
        prefix = lambda w: F.when(w.isin("brown", "beige", "maroon", "burgundy"), "").when(light < 35, "dark ").when((light > 80) & (chroma < 40), "pale ").when(light > 70, "light ").otherwise("")
        full = let(earthy(c), lambda w: let(turned(w), lambda n: F.concat(prefix(n), n)))
        return F.when((light < 20) & (chroma < 15), "black").when(chroma < 9, grey).otherwise(full)

    def polar(lab: Column) -> Column:
        turn = F.degrees(F.atan2(lab["b"], lab["a"]))
        return F.struct(lab["l"].alias("l"), F.hypot(lab["a"], lab["b"]).alias("chroma"), F.when(turn < 0, turn + 360).otherwise(turn).alias("hue"))

    return let(rgb_to_lab(r, g, b), lambda lab: let(polar(lab), lambda c: let(banded(c), shaded)))


def thread_hex(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB, upper case."""
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("int")), 2, "0") for c in (r, g, b)])


def thread_label(is_house: Column, code: Column, name: Column) -> Column:
    """Short label of a thread: the house range counts its shades, others are known by code."""
    return F.when(is_house, F.concat(code, F.lit(". "), name)).otherwise(F.concat(code, F.lit(" · "), name))


def luminance(hex_: Column) -> Column:
    """Relative weight 0-1 of a #RRGGBB colour."""
    part = lambda at: F.conv(F.substring(hex_, at, 2), 16, 10).cast("double")
    return (0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)) / 255
