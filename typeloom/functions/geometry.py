"""Outlines as array<array<struct<x: double, y: double>>>: areas, extents, the size rule and the diacritic rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIACRITIC_ADVANCE, DIACRITIC_RATIO, DEFAULT_ADVANCE = 100, 0.15, 1000
DIACRITIC_DIM, MAIN_DIM = 64, 128


def polygon_area(poly: Column) -> Column:
    """Signed shoelace area, positive counter-clockwise; 0 for fewer than two points."""
    shifted = F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))
    cross = F.zip_with(poly, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, x: s + x) * 0.5


def extent(outline: Column) -> Column:
    """struct<x0, y0, x1, y1> over all points; zeros for an empty outline."""
    points = F.flatten(outline)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    zero = F.lit(0.0)
    of = lambda f, a: F.coalesce(f(a), zero)
    return F.struct(of(F.array_min, xs).alias("x0"), of(F.array_min, ys).alias("y0"), of(F.array_max, xs).alias("x1"), of(F.array_max, ys).alias("y1"))


def known(metric: Column) -> Column:
    """A metric that is null or 0 counts as missing."""
    return metric.isNotNull() & (metric != 0)


def em_height(ascent: Column, descent: Column, box_height: Column) -> Column:
    height = F.when(known(ascent) & known(descent), (ascent - descent).cast("double")).otherwise(box_height.cast("double"))
    return F.when(height == 0, 1.0).otherwise(height)


def size_ratio(box: Column, ascent: Column, descent: Column) -> Column:
    width, height = box["x1"] - box["x0"], box["y1"] - box["y0"]
    return F.greatest(width, height) / em_height(ascent, descent, height)


def is_diacritic(advance: Column, ratio: Column, box: Column, ascent: Column, descent: Column, threshold: float = DIACRITIC_RATIO) -> Column:
    """Narrow or small glyphs; slightly larger ones too if they lie wholly in the upper or lower half."""
    first = (F.coalesce(advance, F.lit(DEFAULT_ADVANCE)) < DIACRITIC_ADVANCE) | (ratio < threshold)
    apart = (box["y0"] > ascent * 0.5) | (box["y1"] < descent * 0.5)
    second = (ratio < threshold + 0.1) & known(ascent) & known(descent) & F.coalesce(apart, F.lit(False))
    return first | second


def normalised(outline: Column, box: Column, target: Column) -> Column:
    """Moved to the origin, scaled so that the longer side is ``target`` and turned upside down (image y points down)."""
    longer = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    scale = F.when(longer == 0, 1.0).otherwise(target / longer)
    height = (box["y1"] - box["y0"]) * scale
    height = F.when(height == 0, 1.0).otherwise(height)
    move = lambda p: F.struct(((p["x"] - box["x0"]) * scale).alias("x"), (height - (p["y"] - box["y0"]) * scale).alias("y"))
    return F.transform(outline, lambda poly: F.transform(poly, move))
