"""Names, labels, lengths and other display values as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _without_accents(s: pd.Series) -> pd.Series:
    def plain(t: str | None) -> str | None:
        return None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) <= 0x36F)

    return s.map(plain)


def machine_label(name: Column) -> Column:
    """What a machine can show of a name: accents off letters, printable ASCII only, blanks collapsed, 16 characters."""
    ascii_ = F.regexp_replace(_without_accents(F.coalesce(name, F.lit(""))), r"[^\x20-\x7e]", "")
    return F.left(F.trim(F.regexp_replace(ascii_, r"\s+", " ")), F.lit(16))


def safe_name(name: Column) -> Column:
    """A file name: characters that file systems refuse become spaces, leading dots go, 60 characters; ``design`` if nothing is left."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]+', " "), r"\s+", " ")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(F.trim(spaced), r"^\.+", ""), F.lit(60)), F.lit("")), F.lit("design"))


def design_name(path: Column) -> Column:
    """Last part of a path without its extension, white space normalised."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", ""), r"\s+", " "))


def metres(m: Column) -> Column:
    """Metres for a summary: up to the next half below 10, whole ones above."""
    return F.when(m < 10, F.format_string("%.1f", F.ceil(m * 2) / 2)).otherwise(F.ceil(m).cast("string"))


def list_metres(m: Column) -> Column:
    """Metres for a list: one decimal below 10, else whole, right-aligned in five characters."""
    return F.lpad(F.when(m < 10, F.format_string("%.1f", F.round(m, 1))).otherwise(F.ceil(m).cast("string")), 5, " ")


def sewing_minutes(stitches: Column, changes: Column, trims: Column) -> Column:
    """Whole minutes at 700 stitches a minute, half a minute for a colour change, a tenth for a trim."""
    return F.ceil(stitches / 700 + changes * 0.5 + trims * 0.1)


def fit_to_hoop(aspect: Column, hoop_w: Column, hoop_h: Column) -> Column:
    """struct<width, height> in mm of a design of that width / height in a hoop less 10 mm, to 0.1 mm."""
    w, h = hoop_w - 10, hoop_h - 10
    wide = w / aspect <= h
    return F.struct(F.round(F.when(wide, w).otherwise(h * aspect), 1).alias("width"), F.round(F.when(wide, w / aspect).otherwise(h.cast("double")), 1).alias("height"))


def to_units(mm: Column) -> Column:
    """mm to 0.1 mm units, halves away from zero."""
    return F.round(mm * 10).cast("int")


def path_length(points: Column) -> Column:
    """Length of an array of struct<x, y>."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
