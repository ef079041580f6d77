"""Readers for the plain files around a pipeline. Bad lines are dropped, as the consumers of these files expect."""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.sources.npy import NpySource

GRID_BYTES = 512
HOLES = (-1, 65535)


def jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Records of a JSON-lines file; blank, broken and incomplete lines are dropped before the limit counts."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for name in required:
        rows = rows.filter(F.col(name).isNotNull())
    return rows if limit is None else rows.limit(limit)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id) of the lines that are whole numbers."""
    return spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("id")).filter("id IS NOT NULL")


def blank_labels(spark: SparkSession, path: str) -> int:
    """How many rows of a headed CSV file ``label_rows`` leaves out."""
    return spark.read.option("header", True).csv(path).filter(F.coalesce(F.trim("label"), F.lit("")) == "").count()


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a headed CSV file with a ``label`` that isn't blank."""
    rows = spark.read.option("header", True).csv(path)
    if "label" not in rows.columns:
        raise ValueError(f"{path} has no label column")
    return rows.filter(F.trim("label") != "")


def label_map(spark: SparkSession, path: str, unknown: str = "<UNK_{}>") -> DataFrame:
    """(idx, label) of a ``{label: idx}`` file; missing indexes get a name of their own (``unknown`` may be empty)."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("label", "idx"))
    top = pairs.agg(F.max("idx")).first()[0]
    every = spark.range(0 if top is None else top + 1).withColumnRenamed("id", "idx")
    before, _, after = unknown.partition("{}")
    name = F.concat(F.lit(before), F.col("idx").cast("string"), F.lit(after)) if unknown else F.lit("")
    return every.join(pairs, "idx", "left").select("idx", F.coalesce("label", name).alias("label"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in ``order``; the order column is dropped."""
    kept = [c for c in rows.columns if c not in (key, order)]
    last = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("__x"))
    return last.select(key, *[F.col(f"__x.{c}").alias(c) for c in kept])


def of_ids(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """The rows whose file name ends in ``_<id>.<suffix>`` with one of the ids in the first column of ``ids``. An empty list of ids
    asks for nothing to be left out: all rows stay."""
    if not ids.limit(1).count():
        return rows
    wanted = ids.select(F.col(ids.columns[0]).cast("bigint").alias("__id")).filter("__id IS NOT NULL").distinct()
    own = F.regexp_extract(name, r"_([0-9]{1,18})\.[A-Za-z0-9]+$", 1).try_cast("bigint")
    return rows.withColumn("__id", own).join(wanted, "__id", "left_semi").drop("__id")


def cell_store(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, mask) of a folder of 8x8 cells, numbered over all its files in name order.

    Of the layouts the first that is there counts: ``cells.npy``, ``shard_*.npy`` (both with a byte a pixel) and
    ``cells_bitpack_shard_*.npy`` (a 64-bit mask a cell, pixel r*8+c in bit r*8+c). Anything else raises.
    """
    from typeloom.functions.bits import pack

    spark.dataSource.register(NpySource)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    for pattern, packed in (("cells.npy", False), ("shard_*.npy", False), ("cells_bitpack_shard_*.npy", True)):
        if fnmatch.filter(names, pattern):
            rows = spark.read.format("npy").options(path=folder, pattern=pattern).load()
            mask = F.col("v")[0] if packed else pack(F.transform("v", lambda x: (x != 0).cast("int")))
            return rows.select("row_id", mask.cast("bigint").alias("mask"))
    raise FileNotFoundError(f"{folder} holds no known layout of cells")


def packed_grids(spark: SparkSession, grids: str, ids: str) -> DataFrame:
    """(glyph_id, grid array<int>) of a header-less file of 256 uint16 a grid and the ``.npy`` file of its row ids.

    Raises if the file is no whole number of grids, or if there are not as many ids.
    """
    spark.dataSource.register(NpySource)
    rows = spark.read.format("npy").options(path=grids, raw="true", dtype="uint16", width="256").load()
    named = spark.read.format("npy").option("path", ids).load().select("row_id", F.col("v")[0].alias("glyph_id"))
    if (n := rows.count()) != (k := named.count()):
        raise ValueError(f"{n} grids but {k} row ids")
    return rows.join(named, "row_id").select("glyph_id", F.col("v").cast("array<int>").alias("grid"))


def weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays of a model that ``sinks.weights`` wrote; a model fits on the driver."""
    rows = spark.read.parquet(path).collect()
    return {r["name"]: np.array(r["v"]).reshape(r["shape"]) for r in rows}


def assignments(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(cell_id, primitive_id) from parquet, jsonl, csv or a dense npy array; sentinels mean unassigned and are dropped.

    In a dense array the position is the cell. Elsewhere a cell that is listed twice has what its last row says, by file
    name and place in the file, also where that is a sentinel.
    """
    if kind == "npy":
        spark.dataSource.register(NpySource)
        rows = spark.read.format("npy").option("path", path).load().select(F.col("row_id").alias("cell_id"), F.col("v")[0].alias("primitive_id"))
    else:
        reader = {"parquet": spark.read.parquet, "jsonl": spark.read.json, "csv": spark.read.option("header", True).csv}[kind]
        rows = reader(path)
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
        rows = rows.select(F.col("cell_id").try_cast("bigint").alias("cell_id"), F.col("primitive_id").try_cast("int").alias("primitive_id"), place.alias("__at"))
        rows = last_wins(rows.filter("primitive_id IS NOT NULL"), "cell_id", "__at")
    typed = rows.select(F.col("cell_id").try_cast("bigint").alias("cell_id"), F.col("primitive_id").try_cast("int").alias("primitive_id"))
    return typed.filter(F.col("cell_id").isNotNull() & F.col("primitive_id").isNotNull() & ~F.col("primitive_id").isin(*HOLES))


def grids_of(grids: DataFrame, ids: DataFrame, missing: str = "raise") -> DataFrame:
    """(glyph_id, grid) for every id in the first column of ``ids``; ids without a grid raise when read, or get ``zeros``."""
    wanted = ids.select(F.col(ids.columns[0]).cast("bigint").alias("glyph_id")).distinct()
    if missing == "zeros":
        default = F.array_repeat(F.lit(0), GRID_BYTES // 2)
    elif missing == "raise":
        default = F.raise_error(F.concat(F.lit("no grid for "), F.col("glyph_id").cast("string"))).cast("array<int>")
    else:
        raise ValueError(f"unknown policy {missing}")
    found = wanted.join(grids.withColumnRenamed("grid", "__grid"), "glyph_id", "left")
    return found.select("glyph_id", F.when(F.col("__grid").isNull(), default).otherwise(F.col("__grid")).alias("grid"))


def grid_files(spark: SparkSession, folder: str) -> DataFrame:
    """(glyph_id, grid array<int>) of a folder of ``<id>.u16`` and ``<id>.npy`` files, ``.u16`` first; another size raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    known = files.filter(name.rlike(r"^\d+\.(u16|npy)$")).select(
        F.regexp_extract(name, r"^(\d+)", 1).cast("bigint").alias("glyph_id"), name.endswith(".u16").alias("plain"), "content"
    )
    best = known.groupBy("glyph_id").agg(F.max_by(F.struct("plain", "content"), "plain").alias("x")).select("glyph_id", "x.*")

    def decode(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            grids = []
            for glyph, plain, raw in zip(pdf["glyph_id"], pdf["plain"], pdf["content"]):
                body = raw if plain else raw[-GRID_BYTES:]
                if len(raw) != (GRID_BYTES if plain else GRID_BYTES + 128):
                    raise ValueError(f"grid {glyph} has {len(raw)} bytes")
                grids.append(np.frombuffer(body, "<u2").astype(np.int32).tolist())
            yield pd.DataFrame({"glyph_id": pdf["glyph_id"], "grid": grids})

    return best.mapInPandas(decode, "glyph_id bigint, grid array<int>")


def images(spark: SparkSession, folder: str, side: int = 128, other: str = "drop") -> DataFrame:
    """(path, px) of single-channel pictures of side x side; others are left out, or raise when read (``other="raise"``)."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(folder).select("image.*")
    fits = (F.col("nChannels") == 1) & (F.col("width") == side) & (F.col("height") == side)
    if other == "raise":
        wrong = F.raise_error(F.concat(F.lit(f"not one channel of {side}x{side}: "), F.col("origin"))).cast("binary")
        return rows.select(F.col("origin").alias("path"), F.when(fits, F.col("data")).otherwise(wrong).alias("px"))
    return rows.filter(fits).select(F.col("origin").alias("path"), F.col("data").alias("px"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Epoch metrics of a CSV log: numbers that can't be read are null, rows without an epoch are dropped, and a lone
    ``macro_f1`` stands for both variants."""
    raw = spark.read.option("header", True).csv(path)
    number = lambda c: F.trim(c).try_cast("double").alias(c)
    rows = raw.select(F.trim("epoch").try_cast("int").alias("epoch"), F.trim("phase").alias("phase"), *[number(c) for c in raw.columns if c not in ("epoch", "phase")])
    for c in ("macro_f1_seen", "macro_f1_all"):
        if "macro_f1" in raw.columns and c not in raw.columns:
            rows = rows.withColumn(c, F.col("macro_f1"))
    return rows.filter("epoch IS NOT NULL")


def newest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path of the last modified file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


@dataclass
class RasterSettings:
    """Geometry of pictures and grids; ``validate`` refuses what the fixed layout can't hold."""

    canvas: int = 128
    grid: int = 16
    cell: int = 8
    diacritic_ratio: float = 0.15
    diacritic_advance: int = 100
    engine: str = "winding"
    labels: list[str] = field(default_factory=list)

    def validate(self) -> RasterSettings:
        if self.grid * self.cell != self.canvas:
            raise ValueError("grid * cell must equal canvas")
        if self.engine not in ("winding", "orientation"):
            raise ValueError(f"unknown engine {self.engine}")
        return self

    @classmethod
    def load(cls, path: str) -> RasterSettings:
        """From a JSON file; unknown keys are ignored, missing ones keep their defaults."""
        with open(path) as f:
            given = json.load(f)
        return cls(**{x.name: given[x.name] for x in fields(cls) if x.name in given}).validate()
