"""Token grids: scattering cells into 16x16 grids, merging assignments, neighbours by id and grid statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.operators.ordering import ranked

SIDE = 16
TOKENS = SIDE * SIDE
UNASSIGNED = (-1, 65535)


def assigned(primitive: Column) -> Column:
    """The primitive, null where a sentinel says that there is none."""
    return F.when(~primitive.isin(*UNASSIGNED), primitive)


def token_grids(cells: DataFrame, order: Column) -> DataFrame:
    """(glyph_id, grid array<int>): each cell's primitive at row*16+col, 0 where none is assigned.

    Rows outside the grid are left out; of several rows for a place the last in ``order`` stays.
    """
    inside = cells.filter(F.col("cell_row").between(0, SIDE - 1) & F.col("cell_col").between(0, SIDE - 1) & F.col("glyph_id").isNotNull())
    place = (F.col("cell_row") * SIDE + F.col("cell_col")).cast("int")
    last = inside.groupBy("glyph_id", place.alias("at")).agg(F.max_by(F.coalesce(assigned(F.col("primitive_id")), F.lit(0)), order).alias("p"))
    # a glyph has at most TOKENS places, so its map is bounded
    maps = last.groupBy("glyph_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "p"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)))
    return maps.select("glyph_id", grid.alias("grid"))


def hybrid(assignment: Column, pred: Column, conf: Column, d_assigned: Column, d_pred: Column, least_conf: float, least_gain: float) -> Column:
    """The prediction where it differs, is confident and, if both distances are known, nearer by the least gain."""
    gain = d_assigned.isNull() | d_pred.isNull() | (d_assigned - d_pred >= least_gain)
    return F.when((pred != assignment) & (conf >= least_conf) & gain, pred).otherwise(assignment)


def with_context(spark: SparkSession, grids: DataFrame, key: str, payload: str, window: int, empty: Column) -> DataFrame:
    """(key, payload, context array<struct<delta, value>>): the payloads at key-window..key+window without the key itself.

    Ids have gaps, so the neighbours are looked up by id; a missing one is ``empty`` and keeps its delta. The deltas are a
    fixed short list, so each row makes 2*window lookups of one equi-join.
    """
    deltas = F.array(*[F.lit(d) for d in range(-window, window + 1) if d])
    asked = grids.select(key, F.explode(deltas).alias("delta")).withColumn("want", F.col(key) + F.col("delta"))
    found = asked.join(grids.select(F.col(key).alias("want"), F.col(payload).alias("value")), "want", "left")
    context = F.array_sort(F.collect_list(F.struct("delta", F.coalesce("value", empty).alias("value"))))
    return grids.select(key, payload).join(found.groupBy(key).agg(context.alias("context")), key)


def grid_statistics(grids: DataFrame) -> DataFrame:
    """(n, mean, std, median of the filled tokens; mean, min, max of the empty share) over all grids."""
    filled = F.size(F.filter("grid", lambda x: x != 0))
    empty = 1 - F.col("k") / F.lit(float(TOKENS))
    r = lambda c, name: F.round(c, 9).alias(name)
    return grids.select(filled.alias("k")).agg(
        F.count("*").alias("n"), r(F.avg("k"), "mean_filled"), r(F.stddev_pop("k"), "std_filled"), r(F.median("k"), "median_filled"),
        r(F.avg(empty), "mean_empty"), r(F.min(empty), "min_empty"), r(F.max(empty), "max_empty"),
    )


def pooled(tokens: DataFrame, rows: int, cols: int) -> DataFrame:
    """Block means of (key, r, c, x) over blocks of rows x cols."""
    return tokens.groupBy("key", F.floor(F.col("r") / rows).alias("pr"), F.floor(F.col("c") / cols).alias("pc")).agg(F.round(F.avg("x"), 9).alias("x"))


def row_major_ids(glyphs: DataFrame, key: str) -> DataFrame:
    """(key, first_cell_id): 256 consecutive ids a glyph, glyphs in key order."""
    return ranked(glyphs.select(key).distinct(), key).select(key, (F.col("rank") * TOKENS).alias("first_cell_id"))
