"""Clusters of similar pictures by density peaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.llm import lsh
from typeloom.llm.graph import MAX_ROUNDS, min_label_components
from typeloom.llm.grids import folded, pictures
from typeloom.storage import Stage, balanced

THRESHOLD = 0.7
BANDS, ROWS = 128, 6  # a pair at 0.7 shares no block with probability 1e-7
MIN_SIZE = 3
TYPICAL = 3
DELTA = 0.2  # a picture this far from every denser one is a peak of its own
SEED = 20240111
_BINS = 256  # of one permutation of the picture's pixels
ENTRIES, LEAST_BANDS = 2_500_000, 5  # entries of buckets on disk at once, but no fewer than those of so many bands
PORTION = 500_000  # pairs measured at once, but no fewer than there are pictures
_PAIRS = 65_536


def pixel_signatures(column: pa.Array) -> np.ndarray:
    """Signatures of pictures of one width (any number of 64-pixel words), at least one pixel of each set."""
    n = len(column)
    words = column.flatten().to_numpy().reshape(n, -1).view(np.uint64)
    pixels = words.shape[1] * 64
    bins = min(_BINS, pixels // 8)
    turns = -(-BANDS * ROWS // bins)
    rng = np.random.default_rng(SEED)
    orders = [rng.permutation(pixels) for _ in range(turns)]
    probes = [lsh.probe_table(bins, SEED + t) for t in range(turns)]
    out = np.zeros((n, turns * bins), np.uint64)
    for at in range(0, n, 256):
        bits = np.unpackbits(words[at : at + 256].view(np.uint8), axis=1, bitorder="little")
        for t, order in enumerate(orders):
            mixed = bits[:, order].reshape(len(bits), bins, -1)
            sig = mixed.argmax(axis=2).astype(np.uint64) + (np.arange(bins, dtype=np.uint64) << np.uint64(32))
            out[at : at + 256, t * bins : (t + 1) * bins] = lsh.densify(sig, mixed.max(axis=2) == 0, probes[t])
    return out


def _words(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).view(np.uint64)


def _measured(pairs: DataFrame) -> DataFrame:
    """Adds ``sim``, common pixels by all pixels of either, in place of the pictures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                a, b = _words(part.column(4)), _words(part.column(5))
                common, either = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64), np.bitwise_count(a | b).sum(axis=1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(common / either)], ["id_a", "id_b", "fp_a", "fp_b", "sim"])

    return pairs.mapInArrow(run, "id_a bigint, id_b bigint, fp_a binary, fp_b binary, sim double")


def signed(classes: DataFrame, per: int) -> DataFrame:
    """(id, size, sketch, n0, n1, ...) of ``classes(id, cells)``: the number of pixels, the pixels of each of 64 squares of 2x2
    cells in a byte (256 counts as 255), and the names of the buckets, 4 bytes a band, in columns of ``per`` bands."""
    cuts = range(0, BANDS, per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                on = np.bitwise_count(_words(part.column(1))).astype(np.int32)
                squares = on.reshape(len(on), 8, 2, 8, 2).sum(axis=(2, 4)).reshape(len(on), 64)
                names = lsh.band_names(pixel_signatures(part.column(1)), BANDS, ROWS).view(np.uint64).astype(np.uint32)
                columns = [_blobs(np.minimum(squares, 255).astype(np.uint8)), *(_blobs(names[:, k : k + per]) for k in cuts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(on.sum(axis=1, dtype=np.int32)), *columns], ["id", "size", "sketch", *(f"n{i}" for i in range(len(cuts)))])

    return balanced(classes.select("id", "cells")).mapInArrow(run, "id bigint, size int, sketch binary, " + ", ".join(f"n{i} binary" for i in range(len(cuts))))


def _blobs(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows that ``_blobs`` wrote."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), -1).view(kind)


def _entries(signed: DataFrame, column: str, first: int) -> DataFrame:
    """(bucket, size, id, sketch): one row for each band of a column of names; the band's number is part of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names = _matrix(part.column(3), np.uint32).astype(np.int64)
                bands = names.shape[1]
                buckets = names + (np.arange(first, first + bands, dtype=np.int64) << 32)
                ids, sizes = (np.repeat(part.column(i).to_numpy(), bands) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), pa.array(sizes), pa.array(ids), _blobs(np.repeat(_matrix(part.column(2), np.uint8), bands, axis=0))], ["bucket", "size", "id", "sketch"])

    return signed.select("id", "size", "sketch", column).mapInArrow(run, "bucket bigint, size int, id bigint, sketch binary")


def bucket_pairs(bucket: np.ndarray, size: np.ndarray, sketch: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of a bucket that sizes and sketches allow, block by block; rows in order of bucket and size.

    Common pixels are at most the sum of the smaller counts of each square, and a square of two 255s may hold one more.
    """
    n = len(bucket)
    key = (np.cumsum(np.r_[0, bucket[1:] != bucket[:-1]]) << 32) + size
    limit = (key >> 32 << 32) + np.floor(size / threshold + 1e-6).astype(np.int64)
    ends = np.searchsorted(key, limit, "right")
    upto = np.cumsum(ends - np.arange(n) - 1)  # pairs whose smaller end stands no later
    full = (sketch == 255).sum(axis=1)
    for at in range(0, int(upto[-1]) if n else 0, _PAIRS):
        pair = np.arange(at, min(at + _PAIRS, int(upto[-1])))
        i = np.searchsorted(upto, pair, "right")
        j = ends[i] - (upto[i] - pair)
        most = np.minimum(sketch[i], sketch[j]).sum(axis=1, dtype=np.int32) + np.minimum(full[i], full[j])
        keep = most >= threshold * (size[i] + size[j] - most) - 1e-9
        yield i[keep], j[keep]


def _candidates(entries: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of a bucket, however large, that can reach the threshold.

    The entries stream through in order, so a task holds one bucket and a batch.
    """

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        for part in whole:
            ids, size = part.column(2).to_numpy(), part.column(1).to_numpy().astype(np.int64)
            for i, j in bucket_pairs(part.column(0).to_numpy(), size, _matrix(part.column(3), np.uint8), threshold):
                a, b = ids[i], ids[j]
                apart = a != b
                if apart.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[apart]), pa.array(np.maximum(a, b)[apart])], ["id_a", "id_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # from the start of the bucket that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut or (held and held[-1].column(0)[-1].as_py() != bucket[-1]):
                yield from pairs([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs(held)

    return entries.repartition("bucket").sortWithinPartitions("bucket", "size").mapInArrow(run, "id_a bigint, id_b bigint")


def picture_links(stage: Stage, cell_grids: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """members(glyph_id, fp) and links(fp_a, fp_b, sim) between different pictures.

    Bands are gone through a few at a time and pairs measured in portions, so that disk holds neither all entries of the
    buckets nor the pictures of all pairs at once. All pairs of a bucket are looked at: no bucket is split or cut.
    """
    named = stage.keep(pictures(cell_grids), "pictures")
    members, classes = folded(named, "cells")
    members = stage.keep(members, "members")
    classes = stage.keep(classes.withColumn("id", F.xxhash64("fp")), "classes")
    stage.drop(named)
    n = classes.count()
    per = min(BANDS, max(LEAST_BANDS, ENTRIES // max(1, n)))
    names = stage.keep(signed(classes, per), "signed")
    found = None
    for k, first in enumerate(range(0, BANDS, per)):
        new = _candidates(_entries(names, f"n{k}", first), threshold)
        both = stage.keep((new if found is None else found.unionByName(new)).distinct(), "pairs")
        stage.drop(found)
        found = both
    stage.drop(names)
    portions = -(-found.count() // max(PORTION, n))
    a, b = (classes.select(F.col("id").alias(f"id_{x}"), F.col("fp").alias(f"f{x}"), F.col("cells").alias(f"p{x}")) for x in "ab")
    links = None
    for k in range(max(1, portions)):
        here = F.lit(True) if portions <= 1 else F.pmod(F.xxhash64("id_b"), F.lit(portions)) == k
        # should two pictures share an id, both are measured
        sided = found.filter(here).join(a, "id_a").join(b.filter(here), "id_b")
        sided = sided.select("id_a", "id_b", F.least("fa", "fb").alias("fp_a"), F.greatest("fa", "fb").alias("fp_b"), "pa", "pb")
        more = stage.keep(_measured(sided).filter(F.col("sim") >= threshold).select("fp_a", "fp_b", "sim"), "links")
        links = more if links is None else links.unionByName(more)
    stage.drop(found)
    stage.drop(classes)
    return members, links


def peaks_and_basins(stage: Stage, weights: DataFrame, links: DataFrame, min_rho: int = MIN_SIZE, min_delta: float = DELTA) -> tuple[DataFrame, DataFrame]:
    """``points(fp, rho, delta, top, is_peak)`` from ``weights(fp, copies, first)``, and the links seen from both ends.

    rho counts the glyphs within the cutoff of a picture, its own copies included; delta is the distance to the nearest
    denser picture among its neighbours, null where there is none within the cutoff. Ties of rho go by the smallest glyph, so
    pointers never form a ring. Peaks are the pictures of rho >= min_rho whose delta is null or >= min_delta. All others follow
    their denser neighbours, each the nearest, to ``top``: a peak, or a picture too lonely to be one.
    """
    both = links.select(F.col("fp_a").alias("fp"), F.col("fp_b").alias("other"), "sim").unionByName(
        links.select(F.col("fp_b").alias("fp"), F.col("fp_a").alias("other"), "sim")
    )
    around = both.join(weights.select(F.col("fp").alias("other"), "copies"), "other").groupBy("fp").agg(F.sum("copies").alias("near"))
    rho = stage.keep(weights.join(around, "fp", "left").select("fp", "first", (F.col("copies") + F.coalesce("near", F.lit(0))).alias("rho")), "rho")
    own, their = F.struct("rho", "first", "fp"), F.struct(F.col("orho").alias("rho"), F.col("ofirst").alias("first"), F.col("other").alias("fp"))
    seen = both.join(rho, "fp").join(rho.select(F.col("fp").alias("other"), F.col("rho").alias("orho"), F.col("first").alias("ofirst")), "other")
    nearest = F.max(F.struct("sim", "orho", "ofirst", "other")).alias("x")
    denser = seen.filter(their > own).groupBy("fp").agg(nearest).select("fp", F.col("x.other").alias("up"), (1 - F.col("x.sim")).alias("delta"))
    far = F.col("delta").isNull() | (F.col("delta") >= min_delta)
    points = rho.join(denser, "fp", "left").withColumn("is_peak", (F.col("rho") >= min_rho) & far)
    up = F.when(F.col("is_peak") | F.col("up").isNull(), F.col("fp")).otherwise(F.col("up"))
    points = stage.keep(points.select("fp", "rho", "delta", "is_peak", up.alias("top")), "pointers")
    for _ in range(MAX_ROUNDS):
        jump = points.select(F.col("fp").alias("top"), F.col("top").alias("upper"))
        moved = points.join(jump, "top").select("fp", "rho", "delta", "is_peak", F.col("upper").alias("top"), (F.col("upper") != F.col("top")).alias("moved"))
        new = stage.keep(moved, "jumped")
        stage.drop(points)
        points = new.drop("moved")
        points._typeloom_path = new._typeloom_path
        if not new.filter("moved").limit(1).count():
            return points, both
    raise RuntimeError("pointers not settled")


def clusters(spark: SparkSession, cell_grids: DataFrame, threshold: float = THRESHOLD, min_size: int = MIN_SIZE) -> DataFrame:
    """(glyph_id, fp, cluster_id, top, rho, delta, is_peak): one row for each glyph and picture of a cluster of at least min_size glyphs.

    Every picture follows its pointers to ``top``; basins that a link joins are one cluster (``cluster_id``: its smallest
    glyph_id), so a cluster is what links connect, whichever pictures are peaks. Null, short, incomplete and blank grids
    don't take part. Rows that came twice count once; a glyph with two different grids joins what both belong to. Further
    columns are ignored. An empty table gives no rows.
    """
    stage = Stage(spark, "density-peaks", tidy=True)
    members, links = picture_links(stage, cell_grids, threshold)
    weights = members.groupBy("fp").agg(F.count("*").alias("copies"), F.min("glyph_id").alias("first"))
    points, both = peaks_and_basins(stage, weights, links, min_size)
    top = points.select("fp", "top")
    borders = both.join(top, "fp").join(top.select(F.col("fp").alias("other"), F.col("top").alias("v")), "other")
    borders = borders.select(F.col("top").alias("u"), "v").filter("u <> v").distinct()
    twice = members.groupBy("glyph_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b")
    same = members.join(twice, "glyph_id").select("fp", F.col("a").alias("other")).join(top, "fp").join(top.select(F.col("fp").alias("other"), F.col("top").alias("v")), "other")
    edges = borders.unionByName(same.select(F.col("top").alias("u"), "v"))
    labels = min_label_components(stage, edges, points.filter("fp = top").select(F.col("fp").alias("id")))
    placed = stage.keep(members.join(points, "fp").join(labels.withColumnRenamed("id", "top"), "top"), "placed")
    sizes = placed.groupBy("label").agg(F.min("glyph_id").alias("cluster_id"), F.count_distinct("glyph_id").alias("size")).filter(F.col("size") >= min_size)
    return placed.join(sizes, "label").select("glyph_id", "fp", "cluster_id", "top", "rho", "delta", "is_peak")


def described(found: DataFrame, typical: int = TYPICAL) -> DataFrame:
    """(peak_id, cluster_id, size, rho, delta, typical array<bigint>): one row for each peak and those that follow it.

    ``peak_id`` is the smallest glyph of the peak's picture, ``size`` the number of glyphs that follow it, ``rho`` and
    ``delta`` the peak's own, ``typical`` the densest of them, ties by glyph_id; ``cluster_id`` names what links connect.
    """
    peaks = found.filter("is_peak").groupBy("top").agg(F.min("glyph_id").alias("peak_id"), F.max("rho").alias("rho"), F.round(F.max("delta"), 9).alias("delta"), F.min("cluster_id").alias("cluster_id"))
    one = found.groupBy("top", "glyph_id").agg(F.max("rho").alias("r"))
    # row_number <= k is a window group limit: each task keeps k rows a cluster before the shuffle
    w = Window.partitionBy("top").orderBy(F.desc("r"), "glyph_id")
    heads = one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= typical)
    lists = heads.groupBy("top").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "glyph_id"))), lambda x: x["glyph_id"]).alias("typical"))
    sizes = one.groupBy("top").agg(F.count("*").alias("size"))
    return peaks.join(sizes, "top").join(lists, "top").select("peak_id", "cluster_id", "size", "rho", "delta", "typical")
