"""Outline parsing, rasterising and cutting into cells. The only places of the core where rows pass through Python."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions import bits, geometry

STEPS = 8
CANVAS, CELL, GRID = 128, 8, 16
SUPERSAMPLE, FILL = 4, 0.5
OUTLINE = "array<array<struct<x:double,y:double>>>"

_T = np.arange(1, STEPS + 1) / STEPS
#: Bernstein bases at the steps of a curve, by number of control points
_BASIS = {3: np.stack([(1 - _T) ** 2, 2 * (1 - _T) * _T, _T**2], 1), 4: np.stack([(1 - _T) ** 3, 3 * (1 - _T) ** 2 * _T, 3 * (1 - _T) * _T**2, _T**3], 1)}


def _number(v) -> bool:
    return isinstance(v, (int, float))


def _point(p) -> bool:
    return isinstance(p, list) and len(p) == 2 and all(map(_number, p))


def _curve(*points) -> list[list[float]]:
    return (_BASIS[len(points)] @ np.array(points, float)).tolist()


class _Pen:
    """Draws commands into subpaths; those with fewer than three points are dropped."""

    def __init__(self):
        self.done: list[list] = []
        self.path: list = []

    def lift(self) -> None:
        if len(self.path) >= 3:
            self.done.append(self.path)
        self.path = []

    def quadratic(self, points: list) -> None:
        """TrueType style: between two off-curve points lies an implied on-curve one. A lone point is a straight line."""
        at = self.path[-1]
        if len(points) == 1:
            middle = [(a + b) / 2 for a, b in zip(at, points[0])]
            self.path += _curve(at, middle, points[0])
            return
        for i, control in enumerate(points[:-1]):
            last = i == len(points) - 2
            end = points[-1] if last else [(a + b) / 2 for a, b in zip(control, points[i + 1])]
            self.path += _curve(at, control, end)
            at = end

    def draw(self, op, payload) -> None:
        if op == "moveTo":
            self.lift()
        if op in ("moveTo", "lineTo") and _point(payload):
            self.path.append([float(v) for v in payload])
        elif op == "qCurveTo" and isinstance(payload, list) and self.path:
            points = [p for p in payload if _point(p)]
            if points:
                self.quadratic(points)
        elif op in ("curveTo", "cubicTo") and isinstance(payload, list) and len(payload) == 3 and self.path and all(map(_point, payload)):
            self.path += _curve(self.path[-1], *payload)
        elif op == "closePath":
            if self.path and self.path[0] != self.path[-1]:
                self.path.append(self.path[0])
            self.lift()


def outline(text: str | None) -> list[list[list[float]]]:
    """Subpaths of at least three points from any of the stored layouts; none for null, blank or broken JSON.

    A list of points is one subpath, a list of such lists several. A list of ``[operator, payload]`` pairs is drawn by one
    pen, a list of such lists by a new pen each.
    """
    if not text or not text.strip():
        return []
    try:
        data = json.loads(text)
    except ValueError:
        return []
    if not isinstance(data, list) or not data:
        return []
    if all(map(_point, data)):
        return [data] if len(data) >= 3 else []
    if all(isinstance(p, list) and p and all(map(_point, p)) for p in data):
        return [p for p in data if len(p) >= 3]
    command = lambda c: isinstance(c, list) and len(c) == 2 and isinstance(c[0], str)
    nested = all(isinstance(c, list) and c and all(map(command, c)) for c in data)
    out = []
    for part in data if nested else [data]:
        pen = _Pen()
        for c in part:
            if isinstance(c, list) and len(c) == 2:
                pen.draw(*c)
        pen.lift()
        out += pen.done
    return out


def parsed_outline(contours: Column) -> Column:
    """The outline of a JSON text, batch by batch through Arrow."""

    def parse(texts: pa.Array) -> pa.Array:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        drawn = [[[{"x": float(x), "y": float(y)} for x, y in poly] for poly in outline(t)] for t in texts.to_pylist()]
        return pa.array(drawn, pa.list_(pa.list_(point)))

    return F.arrow_udf(parse, OUTLINE)(contours)


def _winding(polys: list[np.ndarray], size: int) -> np.ndarray:
    """Winding numbers at the centres of size x size pixels: signed crossings of each scan line, summed from the left."""
    turns = np.zeros((size, size + 1), np.int32)
    for poly in polys:
        a, b = poly, np.roll(poly, -1, axis=0)
        up = b[:, 1] > a[:, 1]
        low, high = np.where(up[:, None], a, b), np.where(up[:, None], b, a)
        first = np.clip(np.ceil(low[:, 1] - 0.5), 0, size).astype(int)
        last = np.clip(np.ceil(high[:, 1] - 0.5), 0, size).astype(int)
        n = np.maximum(last - first, 0)
        edge = np.repeat(np.arange(len(a)), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        slope = (row + 0.5 - low[edge, 1]) / (high[edge, 1] - low[edge, 1])
        x = low[edge, 0] + slope * (high[edge, 0] - low[edge, 0])
        col = np.clip(np.ceil(x - 0.5), 0, size).astype(int)
        np.add.at(turns, (row, col), np.where(up[edge], 1, -1))
    return np.cumsum(turns[:, :size], axis=1)


def raster(polys: list[np.ndarray], engine: str = "winding") -> np.ndarray:
    """A CANVAS x CANVAS picture of 0 and 255 from outlines in canvas coordinates, y pointing down.

    ``winding`` fills what the outlines go around. ``orientation`` draws the largest area first; positive areas fill,
    negative ones carve out. Both average SUPERSAMPLE x SUPERSAMPLE samples a pixel and keep those at least half covered.
    """
    size = CANVAS * SUPERSAMPLE
    scaled = [p * SUPERSAMPLE for p in polys if len(p) >= 2]
    if engine == "winding":
        inside = _winding(scaled, size) != 0
    elif engine == "orientation":
        area = lambda p: 0.5 * float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]))
        inside = np.zeros((size, size), bool)
        for poly in sorted(scaled, key=lambda p: -abs(area(p))):
            inside[_winding([poly], size) != 0] = area(poly) > 0
    else:
        raise ValueError(f"unknown engine {engine}")
    cover = inside.reshape(CANVAS, SUPERSAMPLE, CANVAS, SUPERSAMPLE).mean(axis=(1, 3))
    return np.where(cover >= FILL, 255, 0).astype(np.uint8)


def measured(glyphs: DataFrame) -> DataFrame:
    """Adds outline, box, ratio, is_diacritic and target_dim to (contours, ascent, descent, advance_width)."""
    drawn = glyphs.withColumn("outline", parsed_outline(F.col("contours")))
    boxed = drawn.withColumn("box", geometry.extent(F.col("outline")))
    ratio = geometry.size_ratio(F.col("box"), F.col("ascent"), F.col("descent"))
    rated = boxed.withColumn("ratio", F.when(F.size("outline") > 0, ratio))
    flat = ((F.col("box.x1") - F.col("box.x0")) <= 0) | ((F.col("box.y1") - F.col("box.y0")) <= 0)
    small = geometry.is_diacritic(F.col("advance_width"), F.col("ratio"), F.col("box"), F.col("ascent"), F.col("descent"))
    rated = rated.withColumn("is_diacritic", F.when(~flat, small))
    return rated.withColumn("target_dim", F.when(F.col("is_diacritic"), geometry.DIACRITIC_DIM).when(~F.col("is_diacritic"), geometry.MAIN_DIM))


def rasterised(glyphs: DataFrame, key: str, engine: str = "winding") -> DataFrame:
    """(key, px binary): the pictures of ``measured`` glyphs; degenerate outlines give blank pictures."""
    placed = geometry.normalised(F.col("outline"), F.col("box"), F.coalesce(F.col("target_dim"), F.lit(geometry.MAIN_DIM)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pictures = []
            for polys in batch.column(1).to_pylist():
                points = [np.array([[p["x"], p["y"]] for p in poly]) for poly in polys or []]
                pictures.append((raster(points, engine) if points else np.zeros((CANVAS, CANVAS), np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pictures, pa.binary())], [key, "px"])

    blank = F.col("target_dim").isNull()
    rows = glyphs.select(key, F.when(blank, F.array().cast(OUTLINE)).otherwise(placed).alias("outline"))
    # drawing costs far more than moving an outline, and a fixed number of partitions isn't merged for being small
    parts = int(glyphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).mapInArrow(draw, f"`{key}` {dict(glyphs.dtypes)[key]}, px binary")


BINARISE = ("at_128", "above_0", "half", "unless_binary")


def set_pixels(cells: np.ndarray, rule: str) -> np.ndarray:
    """Which pixels of (..., 64) grey cells are set.

    ``at_128``: 128 and above; ``above_0``: anything but 0; ``half``: above half of the full range; ``unless_binary``: a cell
    whose largest value is 0 or 255 is taken as it stands, full pixels only, any other as by ``above_0``.
    """
    if rule == "at_128":
        return cells >= 128
    if rule == "above_0":
        return cells > 0
    if rule == "half":
        return cells > 127.5
    if rule == "unless_binary":
        ready = np.isin(cells.max(axis=-1, keepdims=True), (0, 255))
        return np.where(ready, cells == 255, cells > 0)
    raise ValueError(f"unknown rule {rule}")


def cells_of(pictures: DataFrame, key: str, rule: str) -> DataFrame:
    """(key, cells array<bigint>): the 16x16 cells of a 128x128 picture, row by row, each an 8x8 mask.

    ``rule``, one of BINARISE, says which pixels are set; there is no default, as they differ. Pictures of another size
    or null give null.
    """
    if rule not in BINARISE:
        raise ValueError(f"unknown rule {rule}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for px in batch.column(1).to_pylist():
                if px is None or len(px) != CANVAS * CANVAS:
                    out.append(None)
                    continue
                on = np.frombuffer(px, np.uint8).reshape(GRID, CELL, GRID, CELL).transpose(0, 2, 1, 3)
                on = set_pixels(on.reshape(GRID * GRID, 64), rule)
                out.append(np.packbits(on, axis=1, bitorder="little").view(np.int64).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], [key, "cells"])

    return pictures.select(key, "px").mapInArrow(cut, f"`{key}` {dict(pictures.dtypes)[key]}, cells array<bigint>")


def cell_rows(grids: DataFrame, key: str) -> DataFrame:
    """(key, cell_row, cell_col, mask, is_empty), one row a cell."""
    at = F.posexplode("cells").alias("at", "mask")
    rows = grids.select(key, at)
    return rows.select(key, F.floor(F.col("at") / GRID).cast("smallint").alias("cell_row"), (F.col("at") % GRID).cast("smallint").alias("cell_col"), "mask", (F.col("mask") == 0).alias("is_empty"))


def rebuilt(cells: Column) -> Column:
    """The coarse picture in which every occupied cell is solid."""
    return F.transform(cells, bits.solid)


def without_large_diacritics(measured_glyphs: DataFrame, advance: int = geometry.DIACRITIC_ADVANCE, ratio: float = geometry.DIACRITIC_RATIO) -> DataFrame:
    """Leaves out diacritics that neither a small advance nor a small ratio makes one: calligraphic outliers. Null measures stay."""
    large = F.col("is_diacritic") & (F.coalesce("advance_width", F.lit(geometry.DEFAULT_ADVANCE)) >= advance) & (F.col("ratio") >= ratio)
    return measured_glyphs.filter(~F.coalesce(large, F.lit(False)))
