"""Queries of the training-data problems and, where SQL on whole tables is bearable, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.catalog import table
from typeloom.llm import cell_pictures, density_peaks, fixed_sample, grouped_splits, leakage, near_duplicates, packing, split_overlap, term_counts, truncation
from typeloom.storage import Stage


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = near_duplicates.near_duplicates(spark, table(spark, d, "cell_grids"))
    return near_duplicates.expanded(members, pairs)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = near_duplicates.near_duplicates(spark, table(spark, d, "cell_grids"))
    return near_duplicates.duplicate_classes(spark, members, pairs)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = split_overlap.overlaps(spark, table(spark, d, "samples"), table(spark, d, "cell_grids"))
    ends = F.least("train_id", "eval_id"), F.greatest("train_id", "eval_id")
    return found.select(ends[0].alias("sample_a"), ends[1].alias("sample_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.report(spark, table(spark, d, "samples"), table(spark, d, "cell_grids"))


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.span_report(spark, table(spark, d, "samples"), table(spark, d, "cell_grids"))


SAMPLE_SIZE = 1000


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return fixed_sample.fixed_sample(spark, table(spark, d, "cells").filter("mask <> 0"), "cell_id", SAMPLE_SIZE, seed=7)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.primitive_counts(spark, table(spark, d, "cells")).filter("mark IS NOT NULL").select("primitive_id", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.primitive_counts(spark, table(spark, d, "cells"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    grouped = grouped_splits.groups(spark, table(spark, d, "meta_records"), table(spark, d, "fonts"))
    return grouped.filter(~F.col("group_id").rlike("^[gr]:")).select("record_id", F.col("group_id").alias("group_font")).distinct()


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    grouped = grouped_splits.groups(spark, table(spark, d, "meta_records"), table(spark, d, "fonts"))
    return grouped_splits.assign(spark, grouped)


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    return grouped_splits.split_checks(p6_splits(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return density_peaks.clusters(spark, table(spark, d, "cell_grids")).select("glyph_id", "cluster_id").distinct()


def p7_clusters(spark: SparkSession, d: str) -> DataFrame:
    found = density_peaks.described(density_peaks.clusters(spark, table(spark, d, "cell_grids")))
    return found.withColumn("typical", F.array_join("typical", ","))


def p7_cells(spark: SparkSession, d: str) -> DataFrame:
    return cell_pictures.cell_clusters(spark, table(spark, d, "cells")).select("cell_id", "cluster_id").distinct()


def p7_cell_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cell_pictures.described(cell_pictures.cell_clusters(spark, table(spark, d, "cells")))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(spark, packing.token_counts(table(spark, d, "documents")))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p8_packed(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    items = Stage(spark, "sizes").keep(packing.token_counts(table(spark, d, "documents")), "tokens")
    return packing.packing_checks(items, Stage(spark, "packed").keep(packing.packed(spark, items), "packed"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(spark, table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.item_report(table(spark, d, "eval_items"), p9_found(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(spark, table(spark, d, "documents")).filter("cut").select("doc_id").distinct()


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(truncation.truncated(spark, table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_spans": p3_spans,
    "p4_sample": p4_sample,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_checks": p6_checks,
    "p7_found": p7_found,
    "p7_clusters": p7_clusters,
    "p7_cells": p7_cells,
    "p7_cell_clusters": p7_cell_clusters,
    "p10_found": p10_found,
    "p10_report": p10_report,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p8_packed": p8_packed,
    "p8_summary": p8_summary,
    "p8_checks": p8_checks,
}

_VALID = "cells IS NOT NULL AND len(cells) = 256 AND NOT list_contains(list_transform(cells, lambda x: x IS NULL), true) AND list_bool_or(list_transform(cells, lambda x: x <> 0))"

_P2_PAIRS = f"""
    sets AS (SELECT DISTINCT glyph_id, list_sort(list_distinct(list_filter(cells, lambda x: x <> 0))) AS vals FROM cell_grids WHERE {_VALID}),
    vals AS (SELECT glyph_id, len(vals) AS n, unnest(vals) AS v FROM sets),
    p2 AS (
        SELECT a.glyph_id AS glyph_a, b.glyph_id AS glyph_b
        FROM vals a JOIN vals b ON a.v = b.v AND a.glyph_id < b.glyph_id
        GROUP BY 1, 2, a.n, b.n
        HAVING count(*) >= 0.7::DOUBLE * (a.n + b.n - count(*))
    )"""

_P3 = f"""{_P2_PAIRS},
    s AS (
        SELECT sample_id, glyph_id, source, CASE WHEN regexp_matches(lower(split), '^\\s*train') THEN 'train' WHEN regexp_matches(lower(split), '^\\s*val') THEN 'val'
            WHEN regexp_matches(lower(split), '^\\s*test') THEN 'test' END AS split
        FROM samples),
    alike AS (SELECT glyph_a AS g, glyph_b AS h FROM p2 UNION SELECT glyph_b, glyph_a FROM p2 UNION SELECT glyph_id, glyph_id FROM sets),
    p3 AS (SELECT DISTINCT t.sample_id AS t_id, e.sample_id AS e_id, e.split, e.source, t.glyph_id AS tg, e.glyph_id AS eg
        FROM s t JOIN alike ON alike.g = t.glyph_id JOIN s e ON e.glyph_id = alike.h WHERE t.split = 'train' AND e.split <> 'train')"""

# sizes rule most pairs out before their pixels are counted
_P7 = f"""
    pics AS (SELECT DISTINCT glyph_id, cells FROM cell_grids WHERE {_VALID} AND glyph_id IS NOT NULL),
    u AS (SELECT cells, row_number() OVER (ORDER BY min(glyph_id)) AS pic, min(glyph_id) AS g, count(*) AS copies, list_sum(list_transform(cells, lambda x: bit_count(x)))::BIGINT AS on_ FROM pics GROUP BY cells),
    alike AS (SELECT a.pic AS p, b.pic AS q, a.on_ + b.on_ AS two, list_sum(list_transform(list_zip(a.cells, b.cells), lambda x: bit_count(x[1] & x[2])))::BIGINT AS common
        FROM u a JOIN u b ON a.pic < b.pic AND a.on_ >= 0.7::DOUBLE * b.on_ AND b.on_ >= 0.7::DOUBLE * a.on_),
    links AS (SELECT p, q, common::DOUBLE / (two - common) AS sim FROM alike WHERE common::DOUBLE / (two - common) >= 0.7::DOUBLE),
    named AS (SELECT glyph_id, pic FROM pics JOIN u USING (cells)),
    ends AS (SELECT p, q, sim FROM links UNION ALL SELECT q, p, sim FROM links),
    joined AS (SELECT p, q FROM ends UNION SELECT a.pic, b.pic FROM named a JOIN named b ON a.glyph_id = b.glyph_id AND a.pic <> b.pic)"""

_P7_LABELS = """
    reach AS (SELECT p, q FROM joined UNION SELECT r.p, j.q FROM reach r JOIN joined j ON r.q = j.p),
    label AS (SELECT pic, least(pic, coalesce(min(q), pic)) AS label FROM u LEFT JOIN reach ON p = pic GROUP BY pic),
    placed AS (SELECT DISTINCT glyph_id, label FROM named JOIN label USING (pic)),
    sizes AS (SELECT label, min(glyph_id) AS cluster_id FROM placed GROUP BY label HAVING count(DISTINCT glyph_id) >= 3)"""

_P5 = """
    places AS (SELECT DISTINCT cell_id, glyph_id, primitive_id FROM cells WHERE primitive_id NOT IN (-1, 65535) AND cell_id IS NOT NULL),
    n AS (SELECT count(DISTINCT glyph_id) AS n FROM places),
    counts AS (SELECT primitive_id, count(*) AS occurrences, count(DISTINCT glyph_id) AS records FROM places GROUP BY 1),
    p5 AS (SELECT counts.*, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.5::DOUBLE * n.n THEN 'common' END AS mark FROM counts, n)"""

_P6 = """
    bare AS (SELECT record_id, glyph_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(font_hash, '\\s+', '', 'g')), '^([a-z]+[0-9]*[:/]+|sha-?[0-9]+[-_:]|font[-_:])+', ''),
        '(\\.[a-z0-9]+|#[0-9]*)+$', ''), '-', '', 'g') AS h FROM meta_records),
    hexed AS (SELECT record_id, glyph_id, CASE WHEN regexp_full_match(h, '[0-9a-f]{6,40}') THEN h END AS h FROM bare),
    known AS (SELECT file_hash AS f FROM fonts UNION SELECT h FROM hexed WHERE length(h) = 40),
    short AS (SELECT h, min(f) AS f FROM (SELECT DISTINCT h FROM hexed WHERE length(h) < 40) JOIN known ON starts_with(f, h) GROUP BY h HAVING count(*) = 1),
    named AS (SELECT record_id, 'g:' || glyph_id AS g, CASE WHEN length(x.h) = 40 THEN x.h ELSE s.f END AS f FROM hexed x LEFT JOIN short s ON s.h = x.h),
    pairs AS (SELECT DISTINCT f, g FROM named WHERE f IS NOT NULL AND g IS NOT NULL),
    hops AS (SELECT DISTINCT a.f AS u, b.f AS v FROM pairs a JOIN pairs b ON a.g = b.g),
    reach AS (SELECT u, v FROM hops UNION SELECT r.u, h.v FROM reach r JOIN hops h ON r.v = h.u),
    of_font AS (SELECT f, min(coalesce(v, f)) AS label FROM (SELECT DISTINCT f FROM named WHERE f IS NOT NULL) LEFT JOIN reach ON u = f GROUP BY f),
    of_glyph AS (SELECT g, min(label) AS label FROM pairs JOIN of_font USING (f) GROUP BY g)"""

ORACLE: dict[str, str] = {
    "p2_found": f"WITH {_P2_PAIRS} SELECT DISTINCT glyph_a, glyph_b FROM p2",
    "p2_classes": f"""
    WITH RECURSIVE {_P2_PAIRS},
    ends AS (SELECT glyph_a AS u, glyph_b AS v FROM p2 UNION SELECT glyph_b, glyph_a FROM p2),
    reach AS (SELECT u, v FROM ends UNION SELECT r.u, b.v FROM reach r JOIN ends b ON r.v = b.u),
    least_of AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
    contents AS (SELECT a.glyph_id, count(DISTINCT b.vals) AS n FROM sets a JOIN ends p ON p.u = a.glyph_id JOIN sets b ON b.glyph_id = p.v AND b.vals <> a.vals GROUP BY 1)
    SELECT s.glyph_id, least(s.glyph_id, coalesce(l.m, s.glyph_id)) AS class_id, coalesce(c.n, 0) AS n_links
    FROM (SELECT DISTINCT glyph_id FROM sets) s LEFT JOIN least_of l ON l.u = s.glyph_id LEFT JOIN contents c ON c.glyph_id = s.glyph_id""",
    "p3_found": f"WITH {_P3} SELECT DISTINCT least(t_id, e_id) AS sample_a, greatest(t_id, e_id) AS sample_b FROM p3",
    "p3_report": f"""
    WITH {_P3},
    common AS (SELECT a.glyph_id AS tg, b.glyph_id AS eg, max(len(list_intersect(a.vals, b.vals))) AS n, bool_or(a.vals = b.vals) AS same
        FROM (SELECT DISTINCT tg, eg FROM p3) x JOIN sets a ON a.glyph_id = x.tg JOIN sets b ON b.glyph_id = x.eg GROUP BY 1, 2),
    per AS (SELECT e_id, count(*) AS pairs, bool_or(same) AS exact, sum(n) AS n FROM p3 JOIN common USING (tg, eg) GROUP BY e_id)
    SELECT split, source, count(*) AS n_samples, count(pairs) AS n_leaked, count(*) FILTER (WHERE exact) AS n_exact, coalesce(sum(pairs), 0)::BIGINT AS n_pairs, coalesce(sum(n), 0)::BIGINT AS n_values
    FROM s LEFT JOIN per ON per.e_id = s.sample_id WHERE split <> 'train' GROUP BY split, source""",
    "p4_sample": """
    SELECT row_number() OVER (ORDER BY md5('7:' || cell_id), cell_id) AS position, cell_id FROM (SELECT DISTINCT cell_id FROM cells WHERE mask <> 0 AND cell_id IS NOT NULL)
    ORDER BY position LIMIT 1000""",
    "p5_found": f"WITH {_P5} SELECT primitive_id, mark FROM p5 WHERE mark IS NOT NULL",
    "p5_counts": f"WITH {_P5} SELECT * FROM p5",
    "p7_clusters": f"""
    WITH RECURSIVE {_P7}, {_P7_LABELS},
    rho AS (SELECT a.pic, a.g, a.copies + coalesce(sum(b.copies), 0)::BIGINT AS rho FROM u a LEFT JOIN ends ON p = a.pic LEFT JOIN u b ON b.pic = q GROUP BY a.pic, a.g, a.copies),
    up AS (SELECT e.p, arg_max(e.q, {{'s': sim, 'r': b.rho, 'g': b.g}}) AS q, 1 - max(sim) AS delta FROM ends e JOIN rho a ON a.pic = e.p JOIN rho b ON b.pic = e.q WHERE b.rho > a.rho OR (b.rho = a.rho AND b.g > a.g) GROUP BY e.p),
    pts AS (SELECT pic, g, rho, delta, q, rho >= 3 AND (delta IS NULL OR delta >= 0.2::DOUBLE) AS is_peak FROM rho LEFT JOIN up ON p = pic),
    step AS (SELECT pic, CASE WHEN is_peak OR q IS NULL THEN pic ELSE q END AS next FROM pts),
    walk AS (SELECT pic, next FROM step UNION SELECT w.pic, s.next FROM walk w JOIN step s ON s.pic = w.next),
    tops AS (SELECT w.pic, w.next AS top FROM walk w JOIN step s ON s.pic = w.next AND s.next = s.pic),
    one AS (SELECT top, glyph_id, max(rho) AS r FROM named JOIN tops USING (pic) JOIN pts USING (pic) GROUP BY 1, 2)
    SELECT t.g AS peak_id, z.cluster_id, count(*) AS size, t.rho, round(t.delta, 9) AS delta, array_to_string(list(one.glyph_id ORDER BY r DESC, one.glyph_id)[1:3], ',') AS typical
    FROM pts t JOIN one ON one.top = t.pic JOIN label USING (pic) JOIN sizes z USING (label) WHERE t.is_peak GROUP BY t.pic, t.g, z.cluster_id, t.rho, t.delta""",
    "p7_found": f"""
    WITH RECURSIVE {_P7}, {_P7_LABELS}
    SELECT DISTINCT glyph_id, cluster_id FROM placed JOIN sizes USING (label)""",
    "p6_found": f"""
    WITH RECURSIVE {_P6}
    SELECT DISTINCT record_id, coalesce(a.label, b.label) AS group_font FROM named LEFT JOIN of_font a ON a.f = named.f LEFT JOIN of_glyph b ON b.g = named.g
    WHERE coalesce(a.label, b.label) IS NOT NULL""",
    # what must hold of results that SQL can't make
    "p6_checks": "SELECT count(*) AS n_records, 0::BIGINT AS torn_groups, 0::BIGINT AS splits_off FROM meta_records",
    "p8_checks": "SELECT count(*) AS n_docs, 0::BIGINT AS n_missing, 0::BIGINT AS overfull, 0::BIGINT AS torn, false AS wasteful FROM documents WHERE text <> ''",
}
