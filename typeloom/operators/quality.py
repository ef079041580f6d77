"""Checks: required columns, three-valued consistency, existence and a union of anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, required: set[str]) -> list[str]:
    return sorted(required - set(df.columns))


def asked_for(ids: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): every asked id has a row, with null where the table lacks it."""
    return ids.select(key).distinct().join(table.select(key, value), key, "left")


def consistency(advance: Column, flagged: Column, limit: int = 100) -> Column:
    """Whether a flag agrees with what the advance width says; null without an advance width."""
    return F.when(advance.isNotNull(), (advance < limit) == flagged)


def anomalies(*parts: tuple[str, DataFrame, str, Column]) -> DataFrame:
    """(glyph_id, kind, detail) from (kind, rows, key column, detail) parts."""
    out = None
    for kind, rows, key, detail in parts:
        one = rows.select(F.col(key).cast("bigint").alias("glyph_id"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
        out = one if out is None else out.unionByName(one)
    return out


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the first in order. The row travels as one aggregate value, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("__x")).select(key, *[F.col(f"__x.{c}") for c in rest])


def covered(rows: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """The rows whose key stands in every one of ``tables``, each of which has that key; raises if no row is left."""
    for other in tables:
        rows = rows.join(other.select(key), key, "left_semi")
    if not rows.limit(1).count():
        raise ValueError(f"no row has its {key} in all of the tables")
    return rows


def uncovered(rows: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """(key, missing): the keys that ``covered`` leaves out, each with the first table, by the order given, that lacks it."""
    left, out = rows.select(key).distinct(), None
    for name, other in tables.items():
        lost = left.join(other.select(key), key, "left_anti").withColumn("missing", F.lit(name))
        out = lost if out is None else out.unionByName(lost)
        left = left.join(other.select(key), key, "left_semi")
    return out if out is not None else left.withColumn("missing", F.lit("")).limit(0)


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """Adds ``value`` by ``key`` from a table with one row a key; a key that the table lacks raises when the row is read."""
    joined = rows.join(table.select(key, F.col(value).alias("__found")), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    kind = table.schema[value].dataType
    return joined.withColumn(value, F.when(F.col("__found").isNull(), missing.cast(kind)).otherwise(F.col("__found"))).drop("__found")
