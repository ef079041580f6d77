"""Masks, cells, token grids, vectors, outlines and rasters, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.catalog import table
from typeloom.functions import bits, geometry, vectors
from typeloom.operators import grids, models, nearest, outlines
from typeloom.sources import files

VOCABULARY = 1024  # primitives, EMPTY included


def _masks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cells").filter("mask IS NOT NULL").select("mask").distinct()


def bit_statistics(s: SparkSession, d: str) -> DataFrame:
    m = F.col("mask")
    return table(s, d, "cells").select("cell_id", "mask").distinct().select(
        "cell_id", F.bit_count(m).alias("n_on"), bits.pixel(m, F.lit(0), F.lit(0)).alias("first"), bits.pixel(m, F.lit(7), F.lit(7)).alias("last"), bits.occupied(m).alias("occupied"), bits.solid(m).alias("solid")
    )


def pack_round_trip(s: SparkSession, d: str) -> DataFrame:
    again = bits.pack(bits.unpack(F.col("mask")))
    return _masks(s, d).agg(F.count("*").alias("masks"), F.count_if(again == F.col("mask")).alias("same"))


def mirror_symmetry(s: SparkSession, d: str) -> DataFrame:
    return _masks(s, d).agg(F.count("*").alias("masks"), F.count_if(bits.mirrored(F.col("mask")) == F.col("mask")).alias("symmetric"))


def pixel_similarity(s: SparkSession, d: str) -> DataFrame:
    """Each mask against its mirror image: exact, differing pixels, Jaccard."""
    other = bits.mirrored(F.col("mask"))
    rows = _masks(s, d).select("mask", other.alias("other"))
    return rows.select("mask", (F.col("mask") == F.col("other")).cast("int").alias("exact"), bits.differing(F.col("mask"), F.col("other")).alias("differing"), F.round(bits.jaccard(F.col("mask"), F.col("other")), 9).alias("jaccard"))


def binarised_pixels(s: SparkSession, d: str) -> DataFrame:
    """Set pixels by position over all distinct cells: the dense tensor summed up."""
    rows = table(s, d, "cells").select("cell_id", "mask").distinct().select(F.posexplode(bits.unpack(F.col("mask"))).alias("at", "x"))
    return rows.groupBy("at").agg(F.sum("x").alias("n_on"))


def stored_vs_cells(s: SparkSession, d: str) -> DataFrame:
    """Glyphs whose stored grid and separate cells agree in every place.

    Grids stay whole in the join: exploded, a small file of them was taken for a small table and broadcast, all of it through the driver.
    """
    stored = table(s, d, "cell_grids").filter("size(cells) = 256").select("glyph_id", F.col("cells").alias("stored")).distinct()
    at = (F.col("cell_row") * 16 + F.col("cell_col")).cast("int")
    apart = table(s, d, "cells").select("glyph_id", at.alias("at"), "mask").filter(F.col("at").between(0, 255)).distinct()
    both = apart.join(stored.hint("merge"), "glyph_id")
    return both.groupBy("glyph_id").agg(F.count("*").alias("places"), F.count_if(F.col("mask").eqNullSafe(F.get("stored", F.col("at")))).alias("same"))


def empty_flag_check(s: SparkSession, d: str) -> DataFrame:
    expected = F.col("mask") == 0
    return table(s, d, "cells").groupBy(F.when(F.col("is_empty").isNull(), "unknown").when(F.col("is_empty") == expected, "right").otherwise("wrong").alias("flag")).agg(F.count("*").alias("n"))


def _token_grids(s: SparkSession, d: str) -> DataFrame:
    return grids.token_grids(table(s, d, "cells"), F.struct("extracted_at", "piece_no", "primitive_id"))


def token_grids(s: SparkSession, d: str) -> DataFrame:
    return _token_grids(s, d).select("glyph_id", F.posexplode("grid").alias("at", "p"))


def grid_statistics(s: SparkSession, d: str) -> DataFrame:
    return grids.grid_statistics(_token_grids(s, d))


def token_dropout(s: SparkSession, d: str) -> DataFrame:
    from typeloom.operators.splits import token_dropout as drop

    kept = drop(F.col("grid"), F.col("glyph_id"), 0.02, 1)
    filled = lambda c: F.size(F.filter(c, lambda x: x != 0))
    return _token_grids(s, d).select("glyph_id", filled("grid").alias("before"), filled(kept).alias("after"))


def neighbour_context(s: SparkSession, d: str) -> DataFrame:
    filled = F.size(F.filter("cells", lambda x: x != 0))
    one = table(s, d, "cell_grids").filter("cells IS NOT NULL").groupBy("glyph_id").agg(F.max(filled).alias("filled"))
    context = grids.with_context(s, one, "glyph_id", "filled", 2, F.lit(0))
    return context.select("glyph_id", F.explode("context").alias("c")).select("glyph_id", "c.delta", "c.value")


def patch_pool(s: SparkSession, d: str) -> DataFrame:
    tokens = table(s, d, "cells").select("cell_id", "glyph_id", "cell_row", "cell_col", "mask").distinct()
    return grids.pooled(tokens.select(F.col("glyph_id").alias("key"), F.col("cell_row").alias("r"), F.col("cell_col").alias("c"), F.bit_count("mask").alias("x")), 4, 4)


def heat_statistics(s: SparkSession, d: str) -> DataFrame:
    """Minimum, maximum, mean and population deviation of the ink in each grid row, and the global extremes."""
    cells = table(s, d, "cells").select("cell_id", "cell_row", F.bit_count("mask").alias("x")).distinct()
    r = lambda c, n: F.round(c, 9).alias(n)
    rows = cells.groupBy("cell_row").agg(F.min("x").alias("low"), F.max("x").alias("high"), r(F.avg("x"), "mean"), r(F.stddev_pop("x"), "std"))
    every = Window.partitionBy()
    return rows.withColumn("global_low", F.min("low").over(every)).withColumn("global_high", F.max("high").over(every))


def row_major_ids(s: SparkSession, d: str) -> DataFrame:
    return grids.row_major_ids(table(s, d, "glyphs").select("id"), "id")


def pixel_centroids(s: SparkSession, d: str) -> DataFrame:
    cells = table(s, d, "cells").select("cell_id", "primitive_id", "mask").distinct().withColumn("v", bits.unpack(F.col("mask")))
    means = nearest.mean_vectors(cells.withColumn("p", grids.assigned(F.col("primitive_id"))), "p", "v")
    return means.select("centroid_id", F.posexplode("v").alias("at", "x")).select("centroid_id", "at", F.round("x", 9).alias("x"))


def _class_means(s: SparkSession, d: str) -> DataFrame:
    return nearest.mean_vectors(table(s, d, "embeddings"), "label", "embedding")


def nearest_centroid(s: SparkSession, d: str) -> DataFrame:
    found = nearest.nearest_centroid(table(s, d, "embeddings"), "vec_id", "embedding", _class_means(s, d))
    return found.select("vec_id", "centroid_id", F.round("d2", 6).alias("d2"))


def cells_to_primitives(s: SparkSession, d: str) -> DataFrame:
    """Every distinct non-blank cell to the nearest primitive's mean picture."""
    cells = table(s, d, "cells").select("cell_id", "primitive_id", "mask").distinct().filter("mask <> 0").withColumn("v", bits.unpack(F.col("mask")))
    means = nearest.mean_vectors(cells.withColumn("p", grids.assigned(F.col("primitive_id"))).filter("p > 0"), "p", "v")
    return nearest.nearest_centroid(cells.select("cell_id", "v"), "cell_id", "v", means).select("cell_id", "centroid_id", F.round("d2", 6).alias("d2"))


def _primitive_pictures(s: SparkSession, d: str) -> np.ndarray:
    """The mean picture of each primitive, in the order of ids, zeros where there is none; a vocabulary, so it is small."""
    top = VOCABULARY
    out = np.zeros((top, 64))
    cells = table(s, d, "cells").select("cell_id", "primitive_id", "mask").distinct().withColumn("v", bits.unpack(F.col("mask"))).withColumn("p", grids.assigned(F.col("primitive_id")))
    for r in nearest.mean_vectors(cells.filter((F.col("p") >= 0) & (F.col("p") < top)), "p", "v").collect():  # at most VOCABULARY rows
        out[r["centroid_id"]] = r["v"]
    return out


def scored_cells(s: SparkSession, d: str) -> DataFrame:
    """Every distinct cell through the simplest cell model, with the distances to its choice and to the assigned primitive."""
    centroids = _primitive_pictures(s, d)
    cells = table(s, d, "cells").filter("cell_id IS NOT NULL").groupBy("cell_id").agg(F.min("mask").alias("mask"), F.max(grids.assigned(F.col("primitive_id"))).alias("p"))
    found = models.cell_scores(cells, "cell_id", "mask", models.centroid_network(centroids), centroids, "p")
    return found.select("cell_id", "pred", F.round("conf", 6).alias("conf"), F.round("d_pred", 6).alias("d_pred"), F.round("d_assigned", 6).alias("d_assigned"))


def rasters_to_grids(s: SparkSession, d: str) -> DataFrame:
    """Outlines to pictures to token grids: drawing, cutting, scoring and the rule for blank patches in one chain."""
    pictures = outlines.rasterised(_measured(s, d), "id")
    return models.picture_grids(pictures, "id", models.centroid_network(_primitive_pictures(s, d))).select("id", F.posexplode("grid").alias("at", "p")).filter("p <> 0")


def assigned_cells(s: SparkSession, d: str) -> DataFrame:
    """The cell manifest joined with an assignment of cells, last row wins, and with what is known of their glyphs."""
    cells = table(s, d, "cells")
    manifest = cells.select("cell_id", "glyph_id", "cell_row", "cell_col").distinct()
    assignment = files.last_wins(cells.select("cell_id", "primitive_id", F.struct("extracted_at", "piece_no", "primitive_id").alias("at")), "cell_id", "at")
    glyphs = table(s, d, "glyphs").filter("label IS NOT NULL").groupBy(F.col("id").alias("glyph_id")).agg(F.min("label").alias("label"))
    known = manifest.join(assignment.select("cell_id", grids.assigned(F.col("primitive_id")).alias("primitive_id")).filter("primitive_id IS NOT NULL"), "cell_id")
    return known.join(glyphs, "glyph_id", "left").select("cell_id", "glyph_id", "cell_row", "cell_col", "primitive_id", "label")


def plain_diacritics(s: SparkSession, d: str) -> DataFrame:
    """Measured glyphs without the large diacritics."""
    return outlines.without_large_diacritics(_measured(s, d)).groupBy("is_diacritic").agg(F.count("*").alias("n"))


def centroid_neighbours(s: SparkSession, d: str) -> DataFrame:
    vecs = table(s, d, "embeddings").select(F.col("vec_id").alias("centroid_id"), F.col("embedding").alias("v"))
    return nearest.neighbours(vecs, 0.5).select("centroid_id", "nearest_id", F.round("d2", 6).alias("d2"), "close")


def centroid_drift(s: SparkSession, d: str) -> DataFrame:
    """How far the class means move when every vector goes to its nearest one and the means are taken anew."""
    e, means = table(s, d, "embeddings"), _class_means(s, d)
    moved = e.join(nearest.nearest_centroid(e, "vec_id", "embedding", means), "vec_id")
    return nearest.drift(nearest.mean_vectors(moved, "centroid_id", "embedding"), means)


def hybrid_override(s: SparkSession, d: str) -> DataFrame:
    pred = nearest.nearest_centroid(table(s, d, "embeddings"), "vec_id", "embedding", _class_means(s, d))
    conf = 1 / (1 + F.col("d2"))
    merged = grids.hybrid(F.col("label").cast("bigint"), F.col("centroid_id"), conf, F.lit(None).cast("double"), F.col("d2"), 0.3, 0.05)
    return table(s, d, "embeddings").join(pred, "vec_id").select("vec_id", "label", merged.alias("merged"))


def softmax_top_k(s: SparkSession, d: str) -> DataFrame:
    top = F.posexplode(vectors.top_k(vectors.softmax(F.col("embedding")), 5)).alias("rank", "x")
    return table(s, d, "embeddings").select("vec_id", top).select("vec_id", "rank", "x.idx", F.round("x.prob", 9).alias("prob"))


def cross_entropy(s: SparkSession, d: str) -> DataFrame:
    e, t = F.col("embedding"), F.col("label")
    return table(s, d, "embeddings").select("vec_id", F.round(vectors.cross_entropy(e, t, 0.1), 6).alias("even"), F.round(vectors.cross_entropy(e, t, 0.1, off_target=True), 6).alias("off_target"))


def min_max_scaled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.posexplode(vectors.min_max(F.col("embedding"))).alias("at", "x")).select("vec_id", "at", F.round("x", 6).alias("x"))


def position_codes(s: SparkSession, d: str) -> DataFrame:
    rows = s.range(256).select((F.floor(F.col("id") / 16)).alias("r"), (F.col("id") % 16).alias("c"))
    code = F.posexplode(vectors.position_code(F.col("r"), F.col("c"), 8)).alias("at", "x")
    return rows.select("r", "c", code).select("r", "c", "at", F.round("x", 9).alias("x"))


def delta_codes(s: SparkSession, d: str) -> DataFrame:
    return s.range(-5, 6).select(F.col("id").alias("delta"), F.posexplode(vectors.one_hot_delta(F.col("id"), 3)).alias("at", "x"))


def _measured(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "glyphs").filter("contours IS NOT NULL AND has_contours <> 0")
    f = table(s, d, "fonts").select(F.col("file_hash").alias("f_id"), F.coalesce("typo_ascent", "ascent").alias("ascent"), F.coalesce("typo_descent", "descent").alias("descent"))
    one = g.groupBy("id").agg(F.max_by(F.struct("f_id", "contours", "advance_width"), F.struct("ingested_at", "f_id", "contours")).alias("x")).select("id", "x.*")
    return outlines.measured(one.join(f, "f_id"))


def outline_measures(s: SparkSession, d: str) -> DataFrame:
    area = F.aggregate(F.transform("outline", geometry.polygon_area), F.lit(0.0), lambda a, x: a + x)
    return _measured(s, d).select("id", F.size("outline").alias("subpaths"), F.size(F.flatten("outline")).alias("points"), F.round(area, 4).alias("area"), F.round("ratio", 6).alias("ratio"), "is_diacritic", "target_dim", "box.x0", "box.y0", "box.x1", "box.y1")


def polyline_measures(s: SparkSession, d: str) -> DataFrame:
    """The measures of outlines stored as one flat list of points, which SQL can check."""
    flat = _measured(s, d).filter(F.col("contours").rlike(r"^\s*\[\s*\[\s*-?[0-9]") & F.get_json_object("contours", "$[0][0]").isNotNull())
    one = flat.filter(F.size("outline") == 1)
    return one.select("id", F.size(F.col("outline")[0]).alias("points"), F.round(geometry.polygon_area(F.col("outline")[0]), 4).alias("area"), "box.x0", "box.y0", "box.x1", "box.y1")


def rasterised_glyphs(s: SparkSession, d: str, engine: str = "winding") -> DataFrame:
    """Outlines to pictures to cells; counts of set pixels and occupied cells."""
    pictures = outlines.rasterised(_measured(s, d), "id", engine)
    ink = F.aggregate("cells", F.lit(0), lambda a, x: a + F.bit_count(x))
    return outlines.cells_of(pictures, "id", "at_128").select("id", ink.alias("ink"), F.size(F.filter("cells", lambda x: x != 0)).alias("occupied"))


def carved_glyphs(s: SparkSession, d: str) -> DataFrame:
    return rasterised_glyphs(s, d, "orientation")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bit_statistics, pack_round_trip, mirror_symmetry, pixel_similarity, binarised_pixels, stored_vs_cells, empty_flag_check, token_grids, grid_statistics, token_dropout, neighbour_context, patch_pool,
        heat_statistics, row_major_ids, pixel_centroids, nearest_centroid, cells_to_primitives, centroid_neighbours, centroid_drift, hybrid_override, softmax_top_k, cross_entropy, min_max_scaled,
        position_codes, delta_codes, outline_measures, polyline_measures, rasterised_glyphs, carved_glyphs,
        scored_cells, rasters_to_grids, assigned_cells, plain_diacritics,
    )
}

_BIT = "((mask >> {i}) & 1)"
_FLIP = "list_sum(list_transform(range(64), lambda i: (((mask::BIT::VARCHAR)[64 - i])::INT * (1::HUGEINT << ((i // 8) * 8 + 7 - i % 8)))))"
_TOKENS = """
    SELECT k.glyph_id, r.range::INT AS at, coalesce(c.p, 0) AS p FROM (SELECT DISTINCT glyph_id FROM cells WHERE glyph_id IS NOT NULL AND cell_row BETWEEN 0 AND 15 AND cell_col BETWEEN 0 AND 15) k CROSS JOIN range(256) r
    LEFT JOIN (SELECT glyph_id, cell_row * 16 + cell_col AS at, arg_max(CASE WHEN primitive_id NOT IN (-1, 65535) THEN primitive_id ELSE 0 END, {'t': extracted_at, 'n': piece_no, 'p': primitive_id}) AS p FROM
        (SELECT glyph_id, cell_row, cell_col, coalesce(primitive_id, -1) AS primitive_id, extracted_at, piece_no FROM cells) GROUP BY 1, 2) c ON c.glyph_id = k.glyph_id AND c.at = r.range"""
_VEC = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS at FROM embeddings"
_MEANS = f"SELECT label::BIGINT AS c, \"at\", avg(x) AS x FROM ({_VEC}) WHERE label IS NOT NULL GROUP BY 1, 2"
_NEAR = f"""
    e AS ({_VEC}), m AS ({_MEANS}), far AS (SELECT vec_id, c, sum((e.x - m.x) * (e.x - m.x)) AS d2 FROM e JOIN m USING (\"at\") GROUP BY 1, 2),
    near AS (SELECT vec_id, arg_min(c, {{'d': d2, 'c': c}}) AS centroid_id, min(d2) AS d2 FROM far GROUP BY 1)"""
_SOFT = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE - list_max(embedding)::DOUBLE - ln(list_sum(list_transform(embedding, lambda y: exp(y::DOUBLE - list_max(embedding)::DOUBLE))))) AS l FROM embeddings"

ORACLE: dict[str, str] = {
    "bit_statistics": """
    SELECT cell_id, bit_count(mask)::INT AS n_on, (mask & 1)::INT AS first, (mask < 0)::INT AS last, (mask <> 0)::INT AS occupied, CASE WHEN mask <> 0 THEN -1 WHEN mask = 0 THEN 0 END::BIGINT AS solid FROM (SELECT DISTINCT cell_id, mask FROM cells)""",
    "pack_round_trip": "SELECT count(DISTINCT mask) AS masks, count(DISTINCT mask) AS same FROM cells",
    "mirror_symmetry": f"SELECT count(*) AS masks, count(*) FILTER (WHERE {_FLIP} = (CASE WHEN mask < 0 THEN mask::HUGEINT + 18446744073709551616::HUGEINT ELSE mask END)) AS symmetric FROM (SELECT DISTINCT mask FROM cells WHERE mask IS NOT NULL)",
    "pixel_similarity": f"""
    WITH m AS (SELECT mask, CASE WHEN f > 9223372036854775807 THEN (f - 18446744073709551616::HUGEINT)::BIGINT ELSE f::BIGINT END AS other FROM (SELECT mask, {_FLIP}::HUGEINT AS f FROM (SELECT DISTINCT mask FROM cells WHERE mask IS NOT NULL)))
    SELECT mask, (mask = other)::INT AS exact, bit_count(xor(mask, other))::INT AS differing, round(CASE WHEN (mask | other) = 0 THEN 1.0 ELSE bit_count(mask & other)::DOUBLE / bit_count(mask | other) END, 9) AS jaccard FROM m""",
    "binarised_pixels": "SELECT r.range::INT AS at, sum(CASE WHEN r.range = 63 THEN (mask < 0)::INT ELSE ((mask >> r.range::INT) & 1)::INT END)::BIGINT AS n_on FROM (SELECT DISTINCT cell_id, mask FROM cells) CROSS JOIN range(64) r GROUP BY 1",
    "stored_vs_cells": """
    WITH s AS (SELECT glyph_id, unnest(cells) AS stored, generate_subscripts(cells, 1) - 1 AS at FROM (SELECT DISTINCT glyph_id, cells FROM cell_grids WHERE len(cells) = 256))
    SELECT c.glyph_id, count(*) AS places, count(*) FILTER (WHERE mask IS NOT DISTINCT FROM stored) AS same FROM (SELECT DISTINCT glyph_id, cell_row * 16 + cell_col AS at, mask FROM cells) c JOIN s ON s.glyph_id = c.glyph_id AND s.at = c.at GROUP BY 1""",
    "empty_flag_check": "SELECT CASE WHEN is_empty IS NULL THEN 'unknown' WHEN is_empty = (mask = 0) THEN 'right' ELSE 'wrong' END AS flag, count(*) AS n FROM cells GROUP BY 1",
    "token_grids": _TOKENS,
    "grid_statistics": f"""
    SELECT count(*) AS n, round(avg(k), 9) AS mean_filled, round(stddev_pop(k), 9) AS std_filled, round(median(k), 9) AS median_filled, round(avg(1 - k / 256.0::DOUBLE), 9) AS mean_empty, round(min(1 - k / 256.0::DOUBLE), 9) AS min_empty,
        round(max(1 - k / 256.0::DOUBLE), 9) AS max_empty FROM (SELECT glyph_id, count(*) FILTER (WHERE p <> 0) AS k FROM ({_TOKENS}) GROUP BY 1)""",
    "neighbour_context": """
    WITH g AS (SELECT glyph_id, max(len(list_filter(cells, lambda x: x <> 0))) AS filled FROM cell_grids WHERE cells IS NOT NULL GROUP BY 1)
    SELECT g.glyph_id, o.d AS delta, coalesce(n.filled, 0)::INT AS value FROM g CROSS JOIN (VALUES (-2), (-1), (1), (2)) o(d) LEFT JOIN g n ON n.glyph_id = g.glyph_id + o.d""",
    "patch_pool": "SELECT glyph_id AS key, cell_row // 4 AS pr, cell_col // 4 AS pc, round(avg(bit_count(mask)), 9) AS x FROM (SELECT DISTINCT cell_id, glyph_id, cell_row, cell_col, mask FROM cells) GROUP BY 1, 2, 3",
    "heat_statistics": """
    SELECT cell_row, min(x)::INT AS low, max(x)::INT AS high, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, min(min(x)) OVER ()::INT AS global_low, max(max(x)) OVER ()::INT AS global_high
    FROM (SELECT DISTINCT cell_id, cell_row, bit_count(mask) AS x FROM cells) GROUP BY cell_row""",
    "row_major_ids": "SELECT id, (row_number() OVER (ORDER BY id) - 1) * 256 AS first_cell_id FROM (SELECT DISTINCT id FROM glyphs)",
    "pixel_centroids": """
    SELECT primitive_id::BIGINT AS centroid_id, r.range::INT AS at, round(avg(CASE WHEN r.range = 63 THEN (mask < 0)::INT ELSE ((mask >> r.range::INT) & 1)::INT END), 9) AS x
    FROM (SELECT DISTINCT cell_id, primitive_id, mask FROM cells WHERE primitive_id NOT IN (-1, 65535)) CROSS JOIN range(64) r GROUP BY 1, 2""",
    "nearest_centroid": f"WITH {_NEAR} SELECT vec_id, centroid_id, round(d2, 6) AS d2 FROM near",
    "centroid_neighbours": f"""
    WITH e AS ({_VEC}), p AS (SELECT a.vec_id AS i, b.vec_id AS j, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM e a JOIN e b ON a.at = b.at AND a.vec_id <> b.vec_id GROUP BY 1, 2)
    SELECT i AS centroid_id, arg_min(j, {{'d': d2, 'j': j}}) AS nearest_id, round(min(d2), 6) AS d2, count(*) FILTER (WHERE d2 <= 0.5) AS close FROM p GROUP BY 1""",
    "centroid_drift": f"""
    WITH {_NEAR}, n AS (SELECT centroid_id AS c, "at", avg(x) AS x FROM e JOIN near USING (vec_id) GROUP BY 1, 2),
    f AS (SELECT c, sqrt(sum((n.x - m.x) * (n.x - m.x))) AS d FROM n JOIN m USING (c, "at") GROUP BY c), k AS (SELECT count(DISTINCT n.c) = (SELECT count(DISTINCT c) FROM m) AS whole FROM n)
    SELECT count(*) AS n, round(avg(d), 6) AS mean_l2, round(median(d), 6) AS median_l2, round(max(d), 6) AS max_l2 FROM f, k WHERE whole""",
    "hybrid_override": f"WITH {_NEAR} SELECT v.vec_id, v.label, CASE WHEN centroid_id <> v.label AND 1 / (1 + d2) >= 0.3::DOUBLE THEN centroid_id ELSE v.label END::BIGINT AS merged FROM embeddings v JOIN near USING (vec_id)",
    "softmax_top_k": f"""
    SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, idx) - 1)::INT AS rank, idx::INT AS idx, round(p, 9) AS prob FROM (SELECT vec_id, exp(unnest(l)) AS p, generate_subscripts(l, 1) - 1 AS idx FROM ({_SOFT}))
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, idx) <= 5""",
    "cross_entropy": f"""
    SELECT vec_id, round(-(0.9::DOUBLE * l[label + 1] + 0.1::DOUBLE / len(l) * list_sum(l)), 6) AS even, round(-(0.9::DOUBLE * l[label + 1] + 0.1::DOUBLE / (len(l) - 1) * (list_sum(l) - l[label + 1])), 6) AS off_target FROM ({_SOFT})""",
    "min_max_scaled": """
    SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS at, round(least(greatest((unnest(embedding)::DOUBLE - list_min(embedding)::DOUBLE) / greatest(list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE, 1e-12), 0), 1), 6) AS x FROM embeddings""",
    "position_codes": """
    SELECT r.range AS r, c.range AS c, k.range::INT AS at, round(CASE WHEN k.range % 2 = 0 THEN sin(a) ELSE cos(a) END, 9) AS x FROM range(16) r, range(16) c, range(8) k,
        LATERAL (SELECT (CASE WHEN k.range < 4 THEN r.range ELSE c.range END) / pow(10000.0::DOUBLE, 2 * ((k.range % 4) // 2) / 4.0::DOUBLE) AS a) t""",
    "delta_codes": "SELECT d.range AS delta, k.range::INT AS at, (k.range = least(greatest(d.range, -3), 3) + 3)::INT AS x FROM range(-5, 6) d, range(7) k",
    "polyline_measures": """
    WITH g AS (SELECT id, arg_max({'f': f_id, 'c': contours}, {'t': ingested_at, 'f': f_id, 'c': contours}) AS x FROM glyphs WHERE contours IS NOT NULL AND has_contours <> 0 GROUP BY id),
    flat AS (SELECT id, try_cast(x.c AS DOUBLE[][]) AS p FROM g JOIN fonts ON file_hash = x.f WHERE regexp_matches(x.c, '^\\s*\\[\\s*\\[\\s*-?[0-9]') AND json_valid(x.c))
    SELECT id, len(p)::INT AS points, round(0.5::DOUBLE * list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i][1] * p[i % len(p) + 1][2] - p[i % len(p) + 1][1] * p[i][2])), 4) AS area,
        list_min(list_transform(p, lambda q: q[1])) AS x0, list_min(list_transform(p, lambda q: q[2])) AS y0, list_max(list_transform(p, lambda q: q[1])) AS x1, list_max(list_transform(p, lambda q: q[2])) AS y1
    FROM flat WHERE len(p) >= 3""",
    "assigned_cells": """
    WITH a AS (SELECT cell_id, arg_max(coalesce(primitive_id, -1), {'t': extracted_at, 'n': piece_no, 'p': coalesce(primitive_id, -1)}) AS primitive_id FROM cells GROUP BY 1)
    SELECT c.cell_id, c.glyph_id, c.cell_row, c.cell_col, a.primitive_id, g.label FROM (SELECT DISTINCT cell_id, glyph_id, cell_row, cell_col FROM cells) c JOIN a USING (cell_id)
    LEFT JOIN (SELECT id, min(label) AS label FROM glyphs WHERE label IS NOT NULL GROUP BY id) g ON g.id = c.glyph_id WHERE a.primitive_id NOT IN (-1, 65535)""",
    "cells_to_primitives": """
    WITH k AS (SELECT DISTINCT cell_id, primitive_id, mask FROM cells WHERE mask <> 0),
    px AS (SELECT mask, r.range::INT AS "at" FROM (SELECT DISTINCT mask FROM k) CROSS JOIN range(64) r WHERE CASE WHEN r.range = 63 THEN mask < 0 ELSE ((mask >> r.range::INT) & 1) = 1 END),
    c AS (SELECT primitive_id::BIGINT AS c, r.range::INT AS "at", avg(CASE WHEN r.range = 63 THEN (mask < 0)::INT ELSE ((mask >> r.range::INT) & 1)::INT END) AS x
        FROM (SELECT DISTINCT cell_id, primitive_id, mask FROM cells WHERE mask <> 0 AND primitive_id > 0 AND primitive_id <> 65535) CROSS JOIN range(64) r GROUP BY 1, 2),
    norm AS (SELECT c, sum(x * x) AS n FROM c GROUP BY c),
    d AS (SELECT mask, c, sum(1 - 2 * x) AS s FROM px JOIN c USING ("at") GROUP BY 1, 2),
    best AS (SELECT mask, arg_min(c, {'d': round(s + n, 9), 'c': c}) AS centroid_id, min(s + n) AS d2 FROM d JOIN norm USING (c) GROUP BY 1)
    SELECT k.cell_id, best.centroid_id, round(best.d2, 6) AS d2 FROM k JOIN best USING (mask)""",
}
