"""Every registered query of the core and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from typeloom.catalog import table
from typeloom.operators import compaction
from typeloom.plans import evaluation_queries, grid_queries, relational_queries
from typeloom.storage import Stage


SMALL_TARGET = 16 * 1024  # for the report over the test tables, so that there are many bins


def _consolidated(spark: SparkSession, d: str, target: int = compaction.TARGET) -> DataFrame:
    grids = table(spark, d, "grid_files")
    manifest = compaction.stored_manifest(grids, table(spark, d, "file_checks"))
    return compaction.consolidate(spark, manifest, compaction.stored_contents(grids), Stage(spark, "consolidated").root, target)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _consolidated(spark, d).select("glyph_id", "content_kind")


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    return compaction.file_summary(_consolidated(spark, d, SMALL_TARGET))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the files, whichever bins the records fall into."""
    return compaction.file_checks(p1_files(spark, d), SMALL_TARGET)


flagship = evaluation_queries.flagship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_files": p1_files,
    "p1_checks": p1_checks,
    **relational_queries.QUERIES,
    **grid_queries.QUERIES,
    **evaluation_queries.QUERIES,
}

_P1 = """
    SELECT DISTINCT regexp_extract(file_path, '([0-9]+)[.][A-Za-z0-9]+\\s*$', 1)::BIGINT AS glyph_id, 'grid' AS content_kind, 512 AS size FROM grid_files
    WHERE (octet_length(payload) = 512 AND file_path ILIKE '%.u16') OR (octet_length(payload) = 640 AND file_path ILIKE '%.npy')
    UNION ALL
    SELECT glyph_id, 'raster', octet_length(encode(regexp_replace(regexp_replace(regexp_replace(replace(trim(x.p), '\\', '/'), '/+', '/', 'g'), '(^|/)([.]/)+', '\\1', 'g'), '^.*?(dataset/)', '\\1')))
    FROM (SELECT regexp_extract(raster_path, '([0-9]+)[.][A-Za-z0-9]+\\s*$', 1)::BIGINT AS glyph_id, arg_max({'ok': raster_ok, 'n': raster_bytes, 'p': raster_path}, {'t': checked_at, 'i': check_id}) AS x
        FROM file_checks GROUP BY 1) WHERE x.ok AND x.n > 0"""

ORACLE: dict[str, str] = {
    "p1_checks": f"""
    SELECT count(*) AS n_records, count(*) FILTER (WHERE content_kind = 'grid') AS n_grids, count(*) FILTER (WHERE content_kind = 'raster') AS n_rasters, sum(size)::BIGINT AS bytes,
        0::BIGINT AS overfull, false AS sparse FROM ({_P1})""",
    "p1_found": """
    SELECT DISTINCT regexp_extract(file_path, '([0-9]+)[.][A-Za-z0-9]+\\s*$', 1)::BIGINT AS glyph_id, 'grid' AS content_kind FROM grid_files
    WHERE (octet_length(payload) = 512 AND file_path ILIKE '%.u16') OR (octet_length(payload) = 640 AND file_path ILIKE '%.npy')
    UNION ALL
    SELECT glyph_id, 'raster' FROM (SELECT regexp_extract(raster_path, '([0-9]+)[.][A-Za-z0-9]+\\s*$', 1)::BIGINT AS glyph_id, arg_max({'ok': raster_ok, 'n': raster_bytes}, {'t': checked_at, 'i': check_id}) AS x
        FROM file_checks GROUP BY 1) WHERE x.ok AND x.n > 0""",
    **relational_queries.ORACLE,
    **grid_queries.ORACLE,
    **evaluation_queries.ORACLE,
}
