"""What counts as a grid, and the two forms in which grids are compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.lsh import mix64
from typeloom.storage import balanced

GRID_CELLS = 256
_CHUNK = 2048


def _names(words: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """A 128-bit name for each of n groups of words: two sums of independent 64-bit mixes, whatever the words' order."""
    halves = np.zeros((n, 2), np.uint64)
    starts = np.searchsorted(owner, np.arange(n))
    for half, seed in enumerate((11, 12)):
        halves[:, half] = np.add.reduceat(mix64(words.view(np.uint64), seed), starts)
    data = halves.byteswap().tobytes()  # big-endian: the names order as numbers do
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 16), pa.py_buffer(data)])


def _mapped(cell_grids: DataFrame, form: Callable[[np.ndarray], tuple[pa.Array, pa.Array]], schema: str, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                cells = part.column(1)
                values = cells.flatten()
                holes = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, GRID_CELLS)
                grid = values.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, GRID_CELLS)
                good = ~holes.any(axis=1) & (grid != 0).any(axis=1)
                if good.any():
                    names, payload = form(np.ascontiguousarray(grid[good]))
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), names, payload], ["glyph_id", "fp", name])

    whole = F.col("glyph_id").isNotNull() & F.col("cells").isNotNull() & (F.size("cells") == GRID_CELLS)
    scan = balanced(cell_grids.select(F.col("glyph_id").cast("bigint").alias("glyph_id"), F.col("cells").cast("array<bigint>").alias("cells")))
    return scan.filter(whole).mapInArrow(run, schema)


def _value_sets(grid: np.ndarray) -> tuple[pa.Array, pa.Array]:
    ordered = np.sort(grid, axis=1)
    first = np.ones(ordered.shape, bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first &= ordered != 0
    values, counts = ordered[first], first.sum(axis=1)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return _names(values, np.repeat(np.arange(len(grid)), counts), len(grid)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _pictures(grid: np.ndarray) -> tuple[pa.Array, pa.Array]:
    placed = mix64(np.arange(GRID_CELLS, dtype=np.uint64), 13)[None, :] ^ mix64(grid.view(np.uint64), 14)
    names = _names(placed.ravel(), np.repeat(np.arange(len(grid)), GRID_CELLS), len(grid))
    offsets = np.arange(len(grid) + 1, dtype=np.int32) * GRID_CELLS
    return names, pa.ListArray.from_arrays(pa.array(offsets), pa.array(grid.ravel()))


def value_sets(cell_grids: DataFrame) -> DataFrame:
    """(glyph_id, fp, vals) of the grids that count: ``vals`` are the sorted distinct non-zero values, ``fp`` names their set.

    A grid counts if it has 256 entries, none of them null, and is not all blank; the glyph_id may not be null. Rows that
    came twice stay. One pass in Arrow batches sorts and names the sets: as expressions this took several times as long.
    """
    return _mapped(cell_grids, _value_sets, "glyph_id bigint, fp binary, vals array<bigint>", "vals")


def pictures(cell_grids: DataFrame) -> DataFrame:
    """(glyph_id, fp, cells) of the grids that count; ``fp`` names the picture, each cell at its place."""
    return _mapped(cell_grids, _pictures, "glyph_id bigint, fp binary, cells array<bigint>", "cells")


def folded(named: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Exact copies folded away: ``members(glyph_id, fp)`` and ``classes(fp, payload)`` of a table read from storage.

    Which row stands for a class is settled by glyph_id on narrow rows, so the payloads, equal within a class, are not
    aggregated; a class that holds a third of all rows is merged by the map-side part of both aggregations.
    """
    members = named.select("glyph_id", "fp").distinct()
    return members, named.groupBy("fp").agg(F.first(payload).alias(payload))
