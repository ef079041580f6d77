"""Many small files rewritten as few well-sized ones, each record exactly once, committed atomically.

1. A frozen manifest of files: one row for each record that must come out, with the path and id of its winning file, the
   bytes it will take, and a checksum of its content. It is written before anything else, and decides everything after:
   the rewrite takes from the source only the files it lists, so files that arrive meanwhile wait for the next run.
2. First-fit decreasing into bins of ``target`` bytes. Files are spread over groups of a bounded number of files at
   random, and each group is packed on its own. A group holds many bins, so the last, half-empty one matters little.
3. Each bin is written as one file, into a version folder that nothing reads yet.
4. The written files are read again; per bin, row counts, bytes and order-free checksums must equal the manifest's.
5. One small file, ``CURRENT``, names the version that readers see, and is replaced in one step. No data is renamed, so this
   holds on object stores as well. Earlier versions stay until ``remove_old`` takes them away.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = 64 * 1024 * 1024
GROUP_FILES = 100_000
GRID_SIZES = {"u16": 512, "npy": 640}
NPY_HEADER = 128
MANIFEST = "glyph_id bigint, content_kind string, path string, file_id bigint, size bigint, check bigint"
COMMITTED = "glyph_id bigint, content_kind string, path string, file_id bigint, payload binary, bin bigint"


def clean_path(col: Column) -> Column:
    """One spelling of a path: forward slashes, no empty or ``.`` parts, and nothing before ``dataset/``."""
    slashed = F.regexp_replace(F.translate(F.trim(col), "\\", "/"), r"/+", "/")
    dotless = F.regexp_replace(slashed, r"(?:(?<=/)|^)(?:\./)+", "")
    return F.regexp_replace(dotless, r"^.*?(?=(?:^|/)dataset/)/?", "")


def path_id(col: Column) -> Column:
    """The id at the end of a file's stem."""
    return F.regexp_extract(col, r"(\d{1,18})\.[A-Za-z0-9]+\s*$", 1).try_cast("bigint")


def _grid_rows(grid_files: DataFrame) -> DataFrame:
    """(file_id, path, glyph_id, plain, raw, modified_at) of whole files; ``raw`` are the 512 bytes of the grid."""
    suffix = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)\s*$", 1))
    files = grid_files.select("file_id", clean_path(F.col("file_path")).alias("path"), path_id(F.col("file_path")).alias("glyph_id"), suffix.alias("suffix"), "payload", "modified_at")
    size = F.octet_length("payload")
    whole = ((F.col("suffix") == "u16") & (size == GRID_SIZES["u16"])) | ((F.col("suffix") == "npy") & (size == GRID_SIZES["npy"]))
    raw = F.when(F.col("suffix") == "npy", F.substring("payload", NPY_HEADER + 1, GRID_SIZES["u16"])).otherwise(F.col("payload"))
    return files.filter(whole & F.col("glyph_id").isNotNull()).select("file_id", "path", "glyph_id", (F.col("suffix") == "u16").alias("plain"), raw.alias("raw"), "modified_at")


def grid_manifest(grid_files: DataFrame) -> DataFrame:
    """(glyph_id, content_kind, path, file_id, size, check): the best whole file of each glyph.

    Whole are 512 bytes of ``.u16`` and 640 bytes of ``.npy``. Of several, ``.u16`` wins, then the last modified, then the
    largest path and file_id. Rows without payload, path or an id in the path, and cut or empty files are left out. Contents
    are hashed where they are read; none is shuffled.
    """
    order = F.struct("plain", "modified_at", "path", "file_id", F.xxhash64("raw").alias("check"))
    best = _grid_rows(grid_files).groupBy("glyph_id").agg(F.max(order).alias("x"))
    return best.select("glyph_id", F.lit("grid").alias("content_kind"), "x.path", "x.file_id", F.lit(GRID_SIZES["u16"]).cast("bigint").alias("size"), "x.check")


def raster_manifest(file_checks: DataFrame) -> DataFrame:
    """(glyph_id, content_kind, path, file_id, size, check): rasters whose last check found them in order and not empty.

    The glyph is the id at the end of ``raster_path``. Of checks at the same moment the one with the highest check_id
    counts. Checks without a time count only where a glyph has no other. The bytes of rasters are not at hand: the record
    refers to its path, whose length is its size, and ``file_id`` is null.
    """
    checks = file_checks.select(path_id(F.col("raster_path")).alias("glyph_id"), clean_path(F.col("raster_path")).alias("path"), "raster_ok", "raster_bytes", "checked_at", "check_id")
    last = F.max_by(F.struct("path", "raster_ok", "raster_bytes"), F.struct("checked_at", "check_id"))
    latest = checks.filter("glyph_id IS NOT NULL").groupBy("glyph_id").agg(last.alias("x"))
    good = latest.filter("x.raster_ok AND x.raster_bytes > 0").select("glyph_id", F.lit("raster").alias("content_kind"), F.col("x.path").alias("path"))
    return good.withColumn("file_id", F.lit(None).cast("bigint")).withColumn("size", F.octet_length("path").cast("bigint")).withColumn("check", F.xxhash64("path"))


def first_fit_decreasing(sizes: np.ndarray, target: int) -> np.ndarray:
    """The bin of each size. A tree of the bins' free room finds the first bin that fits in logarithmic time."""
    order = np.argsort(-sizes, kind="stable")
    width = 1 << max(1, int(np.ceil(np.log2(max(2, len(sizes))))))
    room = [target] * (2 * width)
    bins = np.empty(len(sizes), np.int64)
    for i in order:
        size = min(int(sizes[i]), target)
        at = 1
        while at < width:
            at = 2 * at if room[2 * at] >= size else 2 * at + 1
        bins[i] = at - width
        room[at] -= size
        at //= 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
    return bins


def binned(manifest: DataFrame, target: int, group_files: int = GROUP_FILES) -> DataFrame:
    """``manifest`` with ``bin``, a name for each bin; ``size`` may not be null."""
    n = manifest.count()
    groups = max(1, -(-n // group_files))
    keys = [c for c in manifest.columns if c != "size"]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(keys, kind="stable", ignore_index=True)
        rows["bin"] = first_fit_decreasing(rows["size"].to_numpy(), target) * groups + rows["grp"]
        return rows.drop(columns="grp")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema) + ", bin bigint"
    spread = manifest.withColumn("grp", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    return spread.groupBy("grp").applyInPandas(pack, schema)


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _set_current(spark: SparkSession, out: str, version: str) -> None:
    """Replaces ``out/CURRENT`` in one step."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at, fs = _filesystem(spark, f"{out}/CURRENT.{version}")
    stream = fs.create(at, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    to = jvm.org.apache.hadoop.fs.Path(f"{out}/CURRENT")
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(at, to, rename)


def current_version(spark: SparkSession, out: str) -> str | None:
    """The name of the version that readers see, null before the first commit."""
    at, fs = _filesystem(spark, f"{out}/CURRENT")
    if not fs.exists(at):
        return None
    return spark.read.text(f"{out}/CURRENT").first()[0]


def current(spark: SparkSession, out: str) -> DataFrame:
    """The committed rows of the current version."""
    version = current_version(spark, out)
    if version is None:
        raise FileNotFoundError(f"nothing was committed below {out}")
    return spark.read.schema(COMMITTED).parquet(f"{out}/version-{version}")


def remove_old(spark: SparkSession, out: str) -> int:
    """Deletes all versions, with their manifests, but the current one; returns how many."""
    keep = current_version(spark, out)
    at, fs = _filesystem(spark, out)
    old = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith(("version-", "_manifest-")) and not x.getPath().getName().endswith(str(keep))]
    for path in old:
        fs.delete(path, True)
    return sum(1 for x in old if x.getName().startswith("version-"))


def consolidate(spark: SparkSession, manifest: DataFrame, contents: Callable[[DataFrame], DataFrame], out: str, target: int = TARGET) -> DataFrame:
    """Writes the records of ``manifest(glyph_id, content_kind, path, file_id, size, check)`` below ``out``; returns the committed rows.

    ``contents`` adds ``payload`` to manifest rows, from the source; null where only the path is at hand. ``check`` is the
    xxhash64 of the payload, or of the path. (glyph_id, content_kind) must be unique. Raises, and leaves the current version
    in place, if what was written differs from the manifest, as where a listed file has changed or gone. No records give
    an empty version.
    """
    version = uuid.uuid4().hex
    frozen, final = f"{out}/_manifest-{version}", f"{out}/version-{version}"
    manifest.select("glyph_id", "content_kind", "path", "file_id", "size", "check").write.parquet(f"{frozen}/files")
    listed = spark.read.schema(MANIFEST).parquet(f"{frozen}/files")
    if listed.groupBy("glyph_id", "content_kind").count().filter("count > 1").limit(1).count():
        raise ValueError("a record stands in the manifest twice")
    binned(listed, target).write.parquet(f"{frozen}/bins")
    bins = spark.read.schema(f"{MANIFEST}, bin bigint").parquet(f"{frozen}/bins")
    n_bins = bins.select("bin").distinct().count()
    placed = contents(bins).select("glyph_id", "content_kind", "path", "file_id", "payload", "bin")
    parts = max(1, min(n_bins, 100_000))
    # the manifest stands first; nothing below reads the source's listing again
    placed.repartition(parts, "bin").sortWithinPartitions("bin", "content_kind", "glyph_id").write.partitionBy("bin").parquet(final)
    if not n_bins:
        placed.drop("bin").limit(0).write.mode("overwrite").parquet(final)
    written = spark.read.schema(COMMITTED).parquet(final)
    sums = lambda df, name: df.groupBy("bin").agg(
        F.count("*").alias(f"{name}_rows"), F.sum("size").alias(f"{name}_bytes"), F.bit_xor("check").alias(f"{name}_sum"), F.sum(F.pmod("check", F.lit(2**31))).alias(f"{name}_mod")
    )
    # the record's own name is part of the sums, so contents can't change places
    named = lambda check: F.xxhash64("glyph_id", "content_kind", "path", "file_id", check)
    stored = F.coalesce("payload", F.col("path").cast("binary"))
    want = sums(bins.withColumn("check", named("check")), "want")
    have = sums(written.withColumn("size", F.octet_length(stored)).withColumn("check", named(F.when(F.col("payload").isNotNull(), F.xxhash64("payload")).otherwise(F.xxhash64("path")))), "have")
    same = [F.col(f"want_{x}").eqNullSafe(F.col(f"have_{x}")) for x in ("rows", "bytes", "sum", "mod")]
    if want.join(have, "bin", "full").filter(~(same[0] & same[1] & same[2] & same[3])).limit(1).count():
        at, fs = _filesystem(spark, final)
        fs.delete(at, True)
        raise RuntimeError("the consolidated files differ from the manifest; nothing was committed")
    _set_current(spark, out, version)
    return written


def stored_manifest(grid_files: DataFrame, file_checks: DataFrame) -> DataFrame:
    """Every readable grid and raster, each once."""
    return grid_manifest(grid_files).unionByName(raster_manifest(file_checks))


def stored_contents(grid_files: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds the payloads of the files that a manifest lists; a row that came twice in the source gives one."""

    def add(manifest: DataFrame) -> DataFrame:
        rows = _grid_rows(grid_files).select("file_id", "path", F.col("raw").alias("payload"))
        grids = manifest.filter(F.col("content_kind") == "grid").join(rows, ["file_id", "path"]).filter(F.xxhash64("payload") == F.col("check"))
        grids = grids.dropDuplicates(["glyph_id", "content_kind"])
        rest = manifest.filter(F.col("content_kind") != "grid").withColumn("payload", F.lit(None).cast("binary"))
        return grids.select(rest.columns).unionByName(rest)

    return add


def file_summary(committed: DataFrame) -> DataFrame:
    """(bin, n_records, n_grids, n_rasters, bytes) of each consolidated file."""
    kind, stored = F.col("content_kind"), F.octet_length(F.coalesce("payload", F.col("path").cast("binary")))
    return committed.groupBy("bin").agg(
        F.count("*").alias("n_records"), F.count_if(kind == "grid").alias("n_grids"), F.count_if(kind == "raster").alias("n_rasters"), F.sum(stored).cast("bigint").alias("bytes")
    )


def file_checks(summary: DataFrame, target: int) -> DataFrame:
    """(n_records, n_grids, n_rasters, bytes, overfull, sparse) over all files: those beyond ``target`` bytes, and whether there
    are more of them than first-fit decreasing may use, 11/9 of the fewest and one."""
    fewest = F.ceil(F.sum("bytes") / F.lit(target))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_records", "n_grids", "n_rasters", "bytes")]
    return summary.agg(*sums, F.count_if(F.col("bytes") > target).alias("overfull"), F.coalesce(F.count("*") > 11 / 9 * fewest + 1, F.lit(False)).alias("sparse"))
