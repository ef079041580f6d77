"""Glyphs whose grids are mostly the same cells, wherever the cells stand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import lsh
from typeloom.llm.graph import min_label_components
from typeloom.llm.grids import folded, value_sets
from typeloom.storage import Stage

THRESHOLD = 0.7
BANDS, ROWS = 64, 4  # a pair at 0.7 shares no bucket with probability 2e-8
SEED = 20240108


def list_signatures(column: pa.Array, level: int = 0) -> np.ndarray:
    """64 bands of 4 for the first buckets; a split needs no more than its own bands."""
    offsets = column.offsets.to_numpy()
    bins = BANDS * ROWS if level == 0 else lsh.SPLIT * lsh.SPLIT_ROWS
    return lsh.set_signatures(column.flatten().to_numpy(), offsets - offsets[0], bins, SEED + 1009 * level)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _measured(pairs: DataFrame) -> DataFrame:
    return pairs.select("id_a", "id_b", "fp_a", "fp_b", jaccard(F.col("pa"), F.col("pb")).alias("sim"))


def near_duplicates(spark: SparkSession, cell_grids: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``members(glyph_id, fp)`` and ``pairs(fp_a, fp_b, sim)`` between the classes of exactly equal value sets.

    Null, short, incomplete or blank grids and null glyph ids don't take part. A glyph that came twice with the same
    cells is one member; with different cells it is a member of two classes. Order, position and number of equal cells
    play no part. Columns beside ``glyph_id`` and ``cells`` are ignored. An empty table gives empty results.
    """
    stage = Stage(spark, "near-duplicates")
    named = stage.keep(value_sets(cell_grids), "sets")
    members, classes = folded(named, "vals")
    classes = stage.keep(classes.select(F.xxhash64("fp").alias("id"), "fp", F.size("vals").alias("size"), "vals"), "classes")
    pairs = lsh.similar_pairs(stage, classes, "vals", list_signatures, _measured, threshold, BANDS, ROWS)
    return members, stage.keep(pairs, "pairs")


def expanded(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(glyph_a, glyph_b), smaller first: the pairs of classes and the copies within a class as pairs of glyphs."""
    a, b = members.select(F.col("glyph_id").alias("ga"), F.col("fp").alias("fp_a")), members.select(F.col("glyph_id").alias("gb"), F.col("fp").alias("fp_b"))
    across = pairs.select("fp_a", "fp_b").join(a, "fp_a").join(b, "fp_b").select("ga", "gb")
    within = a.join(b, F.col("fp_a") == F.col("fp_b")).filter("ga < gb").select("ga", "gb")
    both = across.unionByName(within).filter("ga <> gb")
    return both.select(F.least("ga", "gb").alias("glyph_a"), F.greatest("ga", "gb").alias("glyph_b")).distinct()


def duplicate_classes(spark: SparkSession, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(glyph_id, class_id, n_links): one row a glyph; links connect classes of copies, copies aren't spelled out.

    A glyph with two different grids joins what both belong to. ``class_id`` is the smallest glyph_id of everything that
    links connect; ``n_links`` counts the other contents that the glyph's content is similar to.
    """
    stage = Stage(spark, "duplicate-classes")
    twice = members.groupBy("glyph_id").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).filter("v <> most")
    same = members.join(twice, "glyph_id").select(F.col("fp").alias("u"), "v")
    edges = pairs.select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v")).unionByName(same)
    labels = min_label_components(stage, edges, members.select(F.col("fp").alias("id")))
    ends = pairs.select(F.col("fp_a").alias("fp")).unionByName(pairs.select(F.col("fp_b").alias("fp")))
    degree = ends.groupBy("fp").agg(F.count("*").alias("n_links"))
    of = members.groupBy("fp").agg(F.min("glyph_id").alias("first")).join(labels, F.col("fp") == F.col("id"))
    names = of.groupBy("label").agg(F.min("first").alias("class_id"))
    named = of.join(names, "label").select("fp", "class_id").join(degree, "fp", "left")
    rows = members.join(named, "fp").select("glyph_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return rows.groupBy("glyph_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
