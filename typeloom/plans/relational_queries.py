"""Scans, joins, splits, samples, counts and series over the tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.catalog import register_views, table
from typeloom.functions import text, vectors
from typeloom.operators import counts, quality, series, splits
from typeloom.sources import files

_SPLIT = r"^\s*(train|val|test)"


def split_name(col: Column) -> Column:
    start = F.regexp_extract(F.lower(col), _SPLIT, 1)
    return F.when(start != "", start)


def source_join_filter(s: SparkSession, d: str) -> DataFrame:
    g, f = table(s, d, "glyphs"), table(s, d, "fonts")
    kept = g.filter("contours IS NOT NULL AND has_contours <> 0 AND label NOT ILIKE '%_shaped'")
    joined = kept.join(f, kept.f_id == f.file_hash)
    metric = lambda a, b: F.coalesce(a, b)
    return joined.select(
        F.col("id").alias("row_id"), "glyph_id", "f_id", "label", "char_class", "advance_width", metric("typo_ascent", "ascent").alias("used_ascent"), metric("typo_descent", "descent").alias("used_descent")
    )


CANONICAL = """
    SELECT g.id, g.f_id, g.label, g.advance_width FROM (SELECT DISTINCT id, f_id, label, advance_width FROM glyphs WHERE contours IS NOT NULL AND has_contours <> 0) g
    JOIN fonts f ON g.f_id = f.file_hash ORDER BY g.id DESC, g.f_id, g.label, g.advance_width LIMIT 500"""


def canonical_sql(s: SparkSession, d: str, sql: str = CANONICAL) -> DataFrame:
    """The ad-hoc surface: any SQL text over the registered views."""
    register_views(s, d, ("glyphs", "fonts"))
    return s.sql(sql)


def _glyphs_once(s: SparkSession, d: str) -> DataFrame:
    return quality.first_wins(table(s, d, "glyphs").select("id", "f_id", "label", "char_class", "advance_width", "ingested_at"), "id", "ingested_at")


def latest_ingest(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "glyphs").groupBy("id").agg(F.count("*").alias("n"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at"))


def key_list_lookup(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "meta_records").select(F.col("glyph_id").alias("id")).filter("id IS NOT NULL")
    widths = table(s, d, "glyphs").groupBy("id").agg(F.max("advance_width").alias("advance_width"))
    return quality.asked_for(ids, widths, "id", "advance_width")


def advance_consistency(s: SparkSession, d: str) -> DataFrame:
    grids = table(s, d, "cell_grids").select("glyph_id", "is_diacritic").distinct()
    widths = table(s, d, "glyphs").groupBy(F.col("id").alias("glyph_id")).agg(F.max("advance_width").alias("w"))
    return grids.join(widths, "glyph_id", "left").select("glyph_id", "is_diacritic", quality.consistency(F.col("w"), F.col("is_diacritic")).alias("consistent"))


def semi_coverage(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "samples").join(table(s, d, "cell_grids"), "glyph_id", "left_semi").select("sample_id", "glyph_id")


def anti_missing(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "glyphs").select("id").distinct().join(table(s, d, "cell_grids").select(F.col("glyph_id").alias("id")), "id", "left_anti")


def min_support_labels(s: SparkSession, d: str) -> DataFrame:
    return counts.minimum_support(table(s, d, "glyphs").select("id", "label"), "label", 5)


def label_map(s: SparkSession, d: str) -> DataFrame:
    return counts.dense_labels(table(s, d, "glyphs"), "label")


def label_lookup(s: SparkSession, d: str) -> DataFrame:
    """Two hops: sample to glyph label to class index."""
    labels = _glyphs_once(s, d).select(F.col("id").alias("glyph_id"), F.col("label").alias("g_label"))
    index = label_map(s, d).withColumnRenamed("label", "g_label")
    return table(s, d, "samples").select("sample_id", "glyph_id").join(labels, "glyph_id").join(index, "g_label").select("sample_id", "idx")


def name_lookup_default(s: SparkSession, d: str) -> DataFrame:
    classes = table(s, d, "glyphs").filter("label IS NOT NULL AND char_class IS NOT NULL").groupBy("label").agg(F.min("char_class").alias("char_class"))
    return table(s, d, "samples").select("sample_id", "label").join(classes, "label", "left").select("sample_id", F.coalesce("char_class", F.lit("?")).alias("char_class"))


def stratified_split(s: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(table(s, d, "customer"), "c_custkey", "c_mktsegment")


def group_split(s: SparkSession, d: str) -> DataFrame:
    return splits.group_split(table(s, d, "documents"), "source")


def hash_split(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", splits.hash_split(F.col("o_custkey")).alias("split"))


def test_rasters(s: SparkSession, d: str) -> DataFrame:
    """The rasters of the test split, by the id at the end of their names."""
    listed = table(s, d, "samples").filter(split_name(F.col("split")) == "test").select("glyph_id")
    return files.of_ids(table(s, d, "meta_records").select("record_id", "raster_filename"), "raster_filename", listed).select("record_id", "raster_filename")


def one_cycle(s: SparkSession, d: str) -> DataFrame:
    return s.range(40).select(F.col("id").alias("epoch"), F.round(vectors.one_cycle_rate(F.col("id"), 0.01, 40), 9).alias("lr"))


def split_precedence(s: SparkSession, d: str) -> DataFrame:
    listed = table(s, d, "samples").select("glyph_id", split_name(F.col("split")).alias("split"))
    return splits.first_claim(listed, "glyph_id")


def per_label_first_n(s: SparkSession, d: str) -> DataFrame:
    return splits.per_group_first(table(s, d, "events").select("event_id", "event_type"), "event_type", "event_id", 20, seed=3)


def deterministic_sample(s: SparkSession, d: str) -> DataFrame:
    return splits.sample_k(table(s, d, "documents").select("doc_id", "source"), "doc_id", 100, seed=11)


def downsample_empty(s: SparkSession, d: str) -> DataFrame:
    cells = table(s, d, "cells").select("cell_id", "mask").distinct()
    return splits.downsampled(cells, "cell_id", F.col("mask") == 0, 0.1, seed=5).select("cell_id")


def every_nth(s: SparkSession, d: str) -> DataFrame:
    return splits.every_nth(table(s, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 10)


def file_name_parse(s: SparkSession, d: str) -> DataFrame:
    stem = text.stem(F.col("raster_filename"))
    rows = table(s, d, "meta_records").select("record_id", stem.alias("stem"))
    return rows.select("record_id", text.stem_label(F.col("stem")).alias("label"), text.stem_id(F.col("stem")).alias("id"), text.safe_label(F.concat(F.col("stem"), F.lit(" (α) 1"))).alias("safe"))


def key_prefix_strip(s: SparkSession, d: str) -> DataFrame:
    keys = F.concat(F.element_at(F.array(*map(F.lit, ("model.", "module.", "net.model.", "_orig_mod.", "model.module.", ""))), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", text.strip_key_prefixes(keys).alias("key"))


def safe_casts(s: SparkSession, d: str) -> DataFrame:
    number = F.trim(F.regexp_replace("c_name", "^Customer#", "")).try_cast("bigint")
    return table(s, d, "customer").select("c_custkey", number.alias("n"), F.col("c_mktsegment").try_cast("double").alias("x"), text.blank(F.col("c_name")).cast("int").alias("blank"))


def raster_fallback(s: SparkSession, d: str) -> DataFrame:
    named = table(s, d, "meta_records").groupBy("glyph_id").agg(F.min("raster_filename").alias("meta_name"))
    listed = table(s, d, "file_checks").filter("raster_ok").groupBy("glyph_id").agg(F.min("raster_path").alias("checked"))
    ids = table(s, d, "glyphs").select(F.col("id").alias("glyph_id")).distinct()
    every = ids.join(named, "glyph_id", "left").join(listed, "glyph_id", "left")
    return every.select("glyph_id", F.coalesce("meta_name", "checked", F.concat(F.col("glyph_id").cast("string"), F.lit(".png"))).alias("path"))


def existence(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "grid_files").select(F.regexp_extract("file_path", r"(\d+)\.[A-Za-z0-9]+\s*$", 1).try_cast("bigint").alias("id")).distinct().withColumn("there", F.lit(1))
    return table(s, d, "glyphs").select("id").distinct().join(files, "id", "left").select("id", F.coalesce("there", F.lit(0)).alias("grid_there"))


def font_overlap(s: SparkSession, d: str) -> DataFrame:
    """Fonts with glyphs in both the training and the test split."""
    named = table(s, d, "samples").select("glyph_id", split_name(F.col("split")).alias("split")).join(table(s, d, "cell_grids").select("glyph_id", "font_hash"), "glyph_id").filter("font_hash IS NOT NULL")
    return named.filter("split = 'train'").select("font_hash").intersect(named.filter("split = 'test'").select("font_hash"))


def all_paths(s: SparkSession, d: str) -> DataFrame:
    checks = table(s, d, "file_checks")
    every = checks.select(F.col("grid_path").alias("path")).union(checks.select("raster_path")).union(table(s, d, "grid_files").select("file_path"))
    return every.groupBy("path").agg(F.count("*").alias("n"))


def newest_artifact(s: SparkSession, d: str) -> DataFrame:
    newest = F.max_by(F.struct("file_id", "file_path"), F.struct("modified_at", "file_id")).alias("x")
    kind = F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)\s*$", 1).alias("kind")
    return table(s, d, "grid_files").groupBy(kind).agg(newest).select("kind", "x.file_id", "x.file_path")


def anomaly_report(s: SparkSession, d: str) -> DataFrame:
    glyphs, grids, docs = table(s, d, "glyphs"), table(s, d, "cell_grids"), table(s, d, "documents")
    ids = glyphs.select("id").distinct()
    found = quality.anomalies(
        ("no_grid", ids.join(grids.select(F.col("glyph_id").alias("id")), "id", "left_anti"), "id", F.lit("")),
        ("no_font", glyphs.join(table(s, d, "fonts"), F.col("f_id") == F.col("file_hash"), "left_anti"), "id", F.coalesce("f_id", F.lit("null"))),
        ("bad_grid", grids.filter(F.col("cells").isNull() | (F.size("cells") != 256)), "glyph_id", F.coalesce(F.size("cells"), F.lit(-1))),
        ("bad_length", docs.filter(F.col("text").isNotNull() & (F.col("n_chars") != F.length("text"))), "doc_id", F.length("text")),
    )
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("glyph_id").alias("ids"))


def group_statistics(s: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: F.round(c, 6).alias(n)
    v = F.col("o_totalprice")
    of = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.avg(v), "mean"), r(F.stddev_pop(v), "std"), F.min(v).alias("low"), F.max(v).alias("high"))
    middle = counts.medians(table(s, d, "orders"), "o_orderpriority", "o_totalprice").select(F.col("o_orderpriority").alias("p"), r(F.col("median"), "median"))
    return of.join(middle, F.col("o_orderpriority").eqNullSafe(F.col("p")), "left").drop("p")


def order_statistics(s: SparkSession, d: str) -> DataFrame:
    return counts.order_statistics(table(s, d, "lineitem"), "l_returnflag", "l_quantity")


def filled_histogram(s: SparkSession, d: str) -> DataFrame:
    return counts.filled_histogram(s, table(s, d, "cells"), "primitive_id", 1024)


def population_buckets(s: SparkSession, d: str) -> DataFrame:
    return counts.bucketed(filled_histogram(s, d))


def class_frequency_bins(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "glyphs").filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    return counts.bucketed(n, counts.CLASS_EDGES)


def class_weights(s: SparkSession, d: str) -> DataFrame:
    return counts.class_weights(table(s, d, "glyphs"), "label")


def top_k_frequency(s: SparkSession, d: str) -> DataFrame:
    return counts.top_frequencies(table(s, d, "cells"), "primitive_id", 25)


def distinct_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cells").agg(F.count_distinct("cell_id").alias("cells"), F.count_distinct("glyph_id").alias("glyphs"), F.count_distinct("font_hash").alias("fonts"), F.count_distinct("mask").alias("masks"))


def json_extract(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def moving_average(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("event_id", "user_id", "value")
    return series.moving_average(rows, "user_id", "event_id", "value", 4).select("event_id", F.round("smooth", 6).alias("smooth"))


def running_best(s: SparkSession, d: str) -> DataFrame:
    rows = series.running_best(table(s, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    return rows.select("event_id", "best", F.col("improved").cast("int").alias("improved"))


def early_stop(s: SparkSession, d: str) -> DataFrame:
    return series.early_stop(table(s, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value", 5e-4, 5)


def phase_pivot(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("v"), F.max("o_orderkey").alias("k"))
    return series.wide(orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "v", "k").withColumn("gap", F.round(F.col("F") - F.col("O"), 4))


def best_kept(s: SparkSession, d: str) -> DataFrame:
    return series.best_kept(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50)


def prefix_offsets(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("len"))
    return series.prefix_offsets(rows, "l_orderkey", "l_linenumber", "len").select("l_orderkey", "l_linenumber", "start", "end")


def learning_rates(s: SparkSession, d: str) -> DataFrame:
    return s.range(60).select(F.col("id").alias("epoch"), F.round(vectors.learning_rate(F.col("id"), 0.001, 60, 5, 1e-5), 12).alias("lr"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        source_join_filter, canonical_sql, latest_ingest, key_list_lookup, advance_consistency, semi_coverage, anti_missing, min_support_labels, label_map, label_lookup, name_lookup_default,
        stratified_split, group_split, hash_split, split_precedence, test_rasters, one_cycle, per_label_first_n, deterministic_sample, downsample_empty, every_nth, file_name_parse, key_prefix_strip, safe_casts,
        raster_fallback, existence, font_overlap, all_paths, newest_artifact, anomaly_report, group_statistics, order_statistics, filled_histogram, population_buckets, class_frequency_bins,
        class_weights, top_k_frequency, distinct_counts, json_extract, moving_average, running_best, early_stop, phase_pivot, best_kept, prefix_offsets, learning_rates,
    )
}

_NAMED = "SELECT sample_id, glyph_id, nullif(regexp_extract(lower(split), '^\\s*(train|val|test)', 1), '') AS split FROM samples"
_BINS = "CASE WHEN n < 10 THEN 0 WHEN n < 100 THEN 1 WHEN n < 1000 THEN 2 WHEN n < 10000 THEN 3 WHEN n < 100000 THEN 4 ELSE 5 END"
_CLASS_BINS = "CASE WHEN n < 1 THEN 0 WHEN n < 2 THEN 1 WHEN n < 5 THEN 2 WHEN n < 10 THEN 3 WHEN n < 20 THEN 4 WHEN n < 50 THEN 5 WHEN n < 100 THEN 6 ELSE 7 END"
_HIST = "SELECT r.range AS value, count(primitive_id) AS n FROM range(1024) r LEFT JOIN cells c ON c.primitive_id = r.range GROUP BY 1"
_FIRST = "SELECT id, x.label FROM (SELECT id, arg_min({'label': label}, ingested_at) AS x FROM glyphs GROUP BY id)"

ORACLE: dict[str, str] = {
    "source_join_filter": """
    SELECT g.id AS row_id, g.glyph_id, g.f_id, g.label, g.char_class, g.advance_width, coalesce(f.typo_ascent, f.ascent) AS used_ascent, coalesce(f.typo_descent, f.descent) AS used_descent
    FROM glyphs g JOIN fonts f ON g.f_id = f.file_hash WHERE g.contours IS NOT NULL AND g.has_contours <> 0 AND g.label NOT ILIKE '%_shaped'""",
    "canonical_sql": CANONICAL.replace("ORDER BY g.id DESC, g.f_id, g.label, g.advance_width", "ORDER BY g.id DESC, g.f_id NULLS FIRST, g.label NULLS FIRST, g.advance_width NULLS FIRST"),
    "latest_ingest": "SELECT id, count(*) AS n, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM glyphs GROUP BY id",
    "key_list_lookup": "SELECT m.id, max(g.advance_width) AS advance_width FROM (SELECT DISTINCT glyph_id AS id FROM meta_records WHERE glyph_id IS NOT NULL) m LEFT JOIN glyphs g ON g.id = m.id GROUP BY m.id",
    "advance_consistency": """
    SELECT c.glyph_id, c.is_diacritic, CASE WHEN w IS NOT NULL THEN (w < 100) = c.is_diacritic END AS consistent
    FROM (SELECT DISTINCT glyph_id, is_diacritic FROM cell_grids) c LEFT JOIN (SELECT id, max(advance_width) AS w FROM glyphs GROUP BY id) g ON g.id = c.glyph_id""",
    "semi_coverage": "SELECT sample_id, glyph_id FROM samples WHERE glyph_id IN (SELECT glyph_id FROM cell_grids)",
    "anti_missing": "SELECT DISTINCT id FROM glyphs WHERE NOT EXISTS (SELECT 1 FROM cell_grids c WHERE c.glyph_id = glyphs.id)",
    "min_support_labels": "SELECT id, label FROM glyphs WHERE label IN (SELECT label FROM glyphs GROUP BY label HAVING count(*) >= 5)",
    "label_map": "SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM glyphs WHERE label IS NOT NULL AND trim(label) <> '')",
    "label_lookup": f"""
    WITH m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM glyphs WHERE label IS NOT NULL AND trim(label) <> ''))
    SELECT sample_id, idx FROM samples s JOIN ({_FIRST}) g ON g.id = s.glyph_id JOIN m ON m.label = g.label""",
    "name_lookup_default": """
    SELECT sample_id, coalesce(c.char_class, '?') AS char_class FROM samples s
    LEFT JOIN (SELECT label, min(char_class) AS char_class FROM glyphs WHERE label IS NOT NULL AND char_class IS NOT NULL GROUP BY label) c ON c.label = s.label""",
    "stratified_split": """
    SELECT c_custkey, c_mktsegment, CASE WHEN rk <= nt THEN 'train' WHEN rk <= nt + floor((n - nt) * (0.1::DOUBLE / (0.1::DOUBLE + 0.04::DOUBLE))) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0:' || c_custkey), c_custkey) AS rk, count(*) OVER (PARTITION BY c_mktsegment) AS n,
        greatest(1, floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.86::DOUBLE)) AS nt FROM customer)""",
    "group_split": """
    SELECT source, CASE WHEN rk <= nt THEN 'train' WHEN rk <= nt + least(round_even(n * 0.1::DOUBLE, 0), n - nt) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT source, row_number() OVER (ORDER BY md5('0:' || source), source) AS rk, count(*) OVER () AS n, round_even(count(*) OVER () * 0.8::DOUBLE, 0) AS nt
        FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))""",
    "hash_split": """
    SELECT o_orderkey, CASE WHEN u < 0.8::DOUBLE THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split
    FROM (SELECT o_orderkey, concat('0x', substr(md5('0:' || o_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders)""",
    "split_precedence": f"SELECT glyph_id, arg_min(split, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS split FROM ({_NAMED}) WHERE split IS NOT NULL GROUP BY glyph_id",
    "per_label_first_n": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('3:' || event_id), event_id) <= 20",
    "deterministic_sample": "SELECT doc_id, source FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 100",
    "downsample_empty": """
    SELECT cell_id FROM (SELECT DISTINCT cell_id, mask FROM cells)
    WHERE NOT coalesce(mask = 0, false) OR concat('0x', substr(md5('5:' || cell_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1::DOUBLE""",
    "every_nth": "SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) WHERE i % 10 = 0",
    "file_name_parse": """
    SELECT record_id, CASE WHEN contains(stem, '_') THEN regexp_extract(stem, '^(.*)_[^_]*$', 1) ELSE stem END AS label, try_cast(regexp_extract(stem, '_([0-9]+)$', 1) AS BIGINT) AS id,
        substr(regexp_replace(stem || ' (α) 1', '[^A-Za-z0-9_-]+', '_', 'g'), 1, 64) AS safe
    FROM (SELECT record_id, regexp_replace(raster_filename, '\\.[^.]*$', '') AS stem FROM meta_records)""",
    "key_prefix_strip": r"""
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(k, '^model\.', ''), '^module\.', ''), '^net\.', ''), '^_orig_mod\.', '') AS key
    FROM (SELECT p_partkey, (['model.', 'module.', 'net.model.', '_orig_mod.', 'model.module.', ''])[(p_partkey % 6 + 1)::INT] || p_brand AS k FROM part)""",
    "safe_casts": "SELECT c_custkey, try_cast(trim(regexp_replace(c_name, '^Customer#', '')) AS BIGINT) AS n, try_cast(c_mktsegment AS DOUBLE) AS x, (c_name IS NULL OR trim(c_name) = '')::INT AS blank FROM customer",
    "raster_fallback": """
    SELECT g.glyph_id, coalesce(m.p, f.p, g.glyph_id || '.png') AS path FROM (SELECT DISTINCT id AS glyph_id FROM glyphs) g
    LEFT JOIN (SELECT glyph_id, min(raster_filename) AS p FROM meta_records GROUP BY 1) m ON m.glyph_id = g.glyph_id
    LEFT JOIN (SELECT glyph_id, min(raster_path) AS p FROM file_checks WHERE raster_ok GROUP BY 1) f ON f.glyph_id = g.glyph_id""",
    "existence": """
    SELECT g.id, (f.id IS NOT NULL)::INT AS grid_there FROM (SELECT DISTINCT id FROM glyphs) g
    LEFT JOIN (SELECT DISTINCT try_cast(regexp_extract(file_path, '([0-9]+)[.][A-Za-z0-9]+\\s*$', 1) AS BIGINT) AS id FROM grid_files) f ON f.id = g.id""",
    "font_overlap": f"""
    WITH n AS (SELECT s.split, c.font_hash FROM ({_NAMED}) s JOIN cell_grids c USING (glyph_id) WHERE font_hash IS NOT NULL)
    SELECT font_hash FROM n WHERE split = 'train' INTERSECT SELECT font_hash FROM n WHERE split = 'test'""",
    "all_paths": "SELECT path, count(*) AS n FROM (SELECT grid_path AS path FROM file_checks UNION ALL SELECT raster_path FROM file_checks UNION ALL SELECT file_path FROM grid_files) GROUP BY path",
    "newest_artifact": """
    SELECT kind, x.file_id, x.file_path FROM (SELECT regexp_extract(file_path, '[.]([A-Za-z0-9]+)\\s*$', 1) AS kind,
        arg_max({'file_id': file_id, 'file_path': file_path}, {'m': modified_at, 'i': file_id}) AS x FROM grid_files GROUP BY 1)""",
    "anomaly_report": """
    SELECT kind, count(*) AS n, count(DISTINCT i) AS ids FROM (
        SELECT 'no_grid' AS kind, id AS i FROM (SELECT DISTINCT id FROM glyphs) g WHERE NOT EXISTS (SELECT 1 FROM cell_grids c WHERE c.glyph_id = g.id)
        UNION ALL SELECT 'no_font', id FROM glyphs WHERE NOT EXISTS (SELECT 1 FROM fonts WHERE file_hash = f_id)
        UNION ALL SELECT 'bad_grid', glyph_id FROM cell_grids WHERE cells IS NULL OR len(cells) <> 256
        UNION ALL SELECT 'bad_length', doc_id FROM documents WHERE text IS NOT NULL AND n_chars <> length(text)) GROUP BY kind""",
    "group_statistics": """
    SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS std, round(median(o_totalprice), 6) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high
    FROM orders GROUP BY 1""",
    "order_statistics": """
    SELECT l_returnflag, n, low, high, mean, a[n // 2 + 1] AS p50, a[(CASE WHEN floor(n * 0.9::DOUBLE) < 1 THEN n ELSE floor(n * 0.9::DOUBLE) END)::BIGINT] AS p90,
        a[(CASE WHEN floor(n * 0.95::DOUBLE) < 1 THEN n ELSE floor(n * 0.95::DOUBLE) END)::BIGINT] AS p95
    FROM (SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, list_sort(list(l_quantity)) AS a FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1)""",
    "filled_histogram": f"SELECT value, n, round(100.0::DOUBLE * n / sum(n) OVER (), 9) AS pct FROM ({_HIST})",
    "population_buckets": f"""
    SELECT bucket, count(*) AS "values", sum(n)::BIGINT AS population, round(100.0::DOUBLE * sum(n) / sum(sum(n)) OVER (), 9) AS population_pct FROM (SELECT {_BINS} AS bucket, n FROM ({_HIST})) GROUP BY bucket""",
    "class_frequency_bins": f"""
    SELECT bucket, count(*) AS "values", sum(n)::BIGINT AS population, round(100.0::DOUBLE * sum(n) / sum(sum(n)) OVER (), 9) AS population_pct
    FROM (SELECT {_CLASS_BINS} AS bucket, n FROM (SELECT label, count(*) AS n FROM glyphs WHERE label IS NOT NULL GROUP BY label)) GROUP BY bucket""",
    "class_weights": """
    SELECT label, n, round(w / avg(w) OVER (), 9) AS weight FROM (SELECT label, n, pow(sum(n) OVER () / (n + 1.0::DOUBLE), 0.5::DOUBLE) AS w FROM (SELECT label, count(*) AS n FROM glyphs WHERE label IS NOT NULL GROUP BY label))""",
    "top_k_frequency": "SELECT primitive_id, count(*) AS n FROM cells WHERE primitive_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, primitive_id LIMIT 25",
    "distinct_counts": "SELECT count(DISTINCT cell_id) AS cells, count(DISTINCT glyph_id) AS glyphs, count(DISTINCT font_hash) AS fonts, count(DISTINCT mask) AS masks FROM cells",
    "json_extract": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "moving_average": "SELECT event_id, round(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), value), 6) AS smooth FROM events",
    "running_best": """
    SELECT event_id, best, (best IS NULL OR value > best)::INT AS improved
    FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)""",
    "phase_pivot": """
    SELECT o_orderpriority, "F", "O", "P", round("F" - "O", 4) AS gap FROM (SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS "F",
        round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS "O", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS "P" FROM orders GROUP BY 1)""",
    "best_kept": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "prefix_offsets": """
    SELECT l_orderkey, l_linenumber, e - n AS start, e AS "end" FROM (SELECT l_orderkey, l_linenumber, n, sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS e
        FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT)::BIGINT AS n FROM lineitem GROUP BY 1, 2))""",
    "learning_rates": """
    SELECT range AS epoch, round(CASE WHEN range < 5 THEN 0.001::DOUBLE * (range + 1) / 5.0::DOUBLE
        ELSE 1e-5::DOUBLE + (0.001::DOUBLE - 1e-5::DOUBLE) * 0.5::DOUBLE * (1 + cos(least(greatest((range - 5) / 55.0::DOUBLE, 0), 1) * pi())) END, 12) AS lr FROM range(60)""",
    "test_rasters": """
    SELECT record_id, raster_filename FROM meta_records WHERE regexp_extract(raster_filename, '_([0-9]+)[.][A-Za-z0-9]+$', 1) <> ''
    AND regexp_extract(raster_filename, '_([0-9]+)[.][A-Za-z0-9]+$', 1)::BIGINT IN (SELECT glyph_id FROM samples WHERE regexp_matches(lower(split), '^\\s*test') AND glyph_id IS NOT NULL)""",
    "one_cycle": """
    SELECT range AS epoch, round(CASE WHEN range / 39.0::DOUBLE < 0.3::DOUBLE THEN 0.01::DOUBLE / 25 + (0.01::DOUBLE - 0.01::DOUBLE / 25) * (range / 39.0::DOUBLE) / 0.3::DOUBLE
        ELSE 0.01::DOUBLE * (1 - (range / 39.0::DOUBLE - 0.3::DOUBLE) / 0.7::DOUBLE) END, 9) AS lr FROM range(40)""",
}
