"""Nearest-centroid assignment and comparisons between sets of centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.functions import vectors
from typeloom.storage import Stage, open_shared

BLOCK = 8_192  # centroids that a task holds at a time
POINTS = 32_768  # points that a task holds while it goes through the blocks
_CHUNK = 2_048


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _in_blocks(stage: Stage, centroids: DataFrame) -> tuple[str, int]:
    """Writes the centroids once, in blocks of about BLOCK, and returns where and how many."""
    kept = stage.keep(centroids.select(F.col("centroid_id").cast("bigint").alias("centroid_id"), F.col("v").cast("array<double>").alias("v")), "centroids")
    blocks = max(1, -(-kept.count() // BLOCK))
    path = stage.path("blocks")
    kept.withColumn("block", F.pmod(F.col("centroid_id"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(path)
    return path, blocks


def _block(path: str, block: int, held: dict) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, vectors) of a block in the order of ids, read from the shared folder unless it was the last one read."""
    if held.get("block") != block:
        rows = open_shared(f"{path}/block={block}")
        held["block"], held["rows"] = block, None
        if rows is not None and rows.num_rows:
            rows = rows.sort_by("centroid_id").combine_chunks()
            held["rows"] = rows["centroid_id"].to_numpy(), _matrix(rows["v"].combine_chunks())
    return held["rows"]


def _against(points: DataFrame, key: str, vector: str, path: str, blocks: int, start: Callable, compare: Callable, finish: Callable, schema: str) -> DataFrame:
    """``finish`` of a state that ``start`` makes for some points and ``compare`` carries through all centroids.

    Points are scanned once. A task holds some of them and one block of centroids, however many there are of either.
    """

    def through(keys: pa.Array, x: np.ndarray, held: dict) -> pa.RecordBatch:
        state = start(len(x))
        for block in range(blocks):
            rows = _block(path, block, held)
            if rows is not None:
                for at in range(0, len(x), _CHUNK):
                    compare(x[at : at + _CHUNK], keys[at : at + _CHUNK], *rows, {k: s[at : at + _CHUNK] for k, s in state.items()})
        return finish(keys, state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        keys: list[pa.Array] = []
        xs: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column(0))
                xs.append(_matrix(batch.column(1)))
            if sum(map(len, xs)) >= POINTS:
                yield through(pa.concat_arrays(keys), np.concatenate(xs), held)
                keys, xs = [], []
        if xs:
            yield through(pa.concat_arrays(keys), np.concatenate(xs), held)

    return points.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema)


def _rough(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; off by rounding."""
    return (x * x).sum(1)[:, None] - 2 * x @ v.T + (v * v).sum(1)


def _nearer(rough: np.ndarray, x: np.ndarray, v: np.ndarray, ids: np.ndarray, state: dict) -> None:
    """Carries the least distance and its id on; what lies within the rounding of the least is measured again."""
    close = rough <= rough.min(1)[:, None] + 1e-6 * (1 + np.abs(np.where(np.isfinite(rough.min(1)), rough.min(1), 0)))[:, None]
    row, col = np.nonzero(close & np.isfinite(rough))
    exact = np.full(rough.shape, np.inf)
    exact[row, col] = ((x[row] - v[col]) ** 2).sum(1)
    best = exact.argmin(1)  # ids rise, so ties go to the smallest
    d2 = exact[np.arange(len(x)), best]
    better = (d2 < state["d2"]) | ((d2 == state["d2"]) & np.isfinite(d2) & (ids[best] < state["id"]))
    state["d2"][better], state["id"][better] = d2[better], ids[best][better]


def nearest_centroid(points: DataFrame, key: str, vector: str, centroids: DataFrame, offset: int = 0) -> DataFrame:
    """(key, centroid_id, d2) for ``centroids(centroid_id, v)``: the least squared distance, ties to the smallest id.

    The centroids are written once and read by the tasks in blocks; each block is one matrix product a batch of points. Ids
    are raised by ``offset``. Points without a vector are left out; no centroids give no rows.
    """
    path, blocks = _in_blocks(Stage(points.sparkSession, "nearest"), centroids)

    def compare(x, keys, ids, v, state) -> None:  # noqa: ANN001
        _nearer(_rough(x, v), x, v, ids, state)

    def finish(keys: pa.Array, state: dict) -> pa.RecordBatch:
        some = pa.array(np.isfinite(state["d2"]))
        return pa.RecordBatch.from_arrays([keys.filter(some), pa.array(state["id"] + offset).filter(some), pa.array(state["d2"]).filter(some)], [key, "centroid_id", "d2"])

    start = lambda n: {"d2": np.full(n, np.inf), "id": np.zeros(n, np.int64)}
    return _against(points, key, vector, path, blocks, start, compare, finish, f"`{key}` {dict(points.dtypes)[key]}, centroid_id bigint, d2 double")


def centroid_distances(points: DataFrame, key: str, vector: str, centroids: DataFrame) -> DataFrame:
    """(key, d2 array<double>): the squared distances to all of ``centroids``, in the order of their ids.

    For the scores of a classifier, whose classes are few against the points.
    """
    path, blocks = _in_blocks(Stage(points.sparkSession, "distances"), centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, found = _matrix(part.column(1)), []
                for block in range(blocks):
                    rows = _block(path, block, held)
                    if rows is not None:
                        found.append((rows[0], ((x[:, None, :] - rows[1][None, :, :]) ** 2).sum(2)))
                if found:
                    order = np.argsort(np.concatenate([ids for ids, _ in found]))
                    d2 = np.concatenate([d for _, d in found], axis=1)[:, order]
                    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * d2.shape[1])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(d2.ravel()))], [key, "d2"])

    return points.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"`{key}` {dict(points.dtypes)[key]}, d2 array<double>")


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(centroid_id, v): element-wise means of each group; partial sums by position combine before the shuffle."""
    spread = rows.filter(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).cast("bigint").alias("centroid_id"), F.posexplode(vector).alias("at", "x"))
    means = spread.groupBy("centroid_id", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("centroid_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))


def neighbours(centroids: DataFrame, limit: float) -> DataFrame:
    """(centroid_id, nearest_id, d2, close): each centroid's nearest other one and how many lie within ``limit``.

    The centroids are the stated query set; they meet each other in blocks, as matrix products. A lone centroid has no row.
    """
    path, blocks = _in_blocks(Stage(centroids.sparkSession, "neighbours"), centroids)

    def compare(x, keys, ids, v, state) -> None:  # noqa: ANN001
        rough = _rough(x, v)
        rough[keys.to_numpy()[:, None] == ids[None, :]] = np.inf
        slack = 1e-6 * (1 + abs(limit))
        row, col = np.nonzero(np.abs(rough - limit) <= slack)
        state["close"] += (rough < limit - slack).sum(1)
        np.add.at(state["close"], row, ((x[row] - v[col]) ** 2).sum(1) <= limit)
        _nearer(rough, x, v, ids, state)

    def finish(keys: pa.Array, state: dict) -> pa.RecordBatch:
        some = pa.array(np.isfinite(state["d2"]))
        columns = [keys, pa.array(state["id"]), pa.array(state["d2"]), pa.array(state["close"])]
        return pa.RecordBatch.from_arrays([c.filter(some) for c in columns], ["centroid_id", "nearest_id", "d2", "close"])

    start = lambda n: {"d2": np.full(n, np.inf), "id": np.zeros(n, np.int64), "close": np.zeros(n, np.int64)}
    points = centroids.select(F.col("centroid_id").cast("bigint").alias("centroid_id"), "v")
    return _against(points, "centroid_id", "v", path, blocks, start, compare, finish, "centroid_id bigint, nearest_id bigint, d2 double, close bigint")


def drift(new: DataFrame, old: DataFrame) -> DataFrame:
    """(n, mean_l2, median_l2, max_l2) between centroids of one id; no row if the two sets differ in number."""
    if new.count() != old.count():
        return new.select(F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(x) for x in ("mean_l2", "median_l2", "max_l2")]).limit(0)
    far = new.join(old.withColumnRenamed("v", "w"), "centroid_id").select(vectors.l2(F.col("v"), F.col("w")).alias("d"))
    return far.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_l2"), F.round(F.median("d"), 6).alias("median_l2"), F.round(F.max("d"), 6).alias("max_l2"))
