"""Clusters of similar single cells: every link between 64-pixel pictures counted exactly, none of them spelled out.

Solid and nearly solid masks are all alike, so links grow much faster than masks and no table of them is made. Masks stand in
blocks of one pixel count; each pair of blocks that can hold a link gives, for each of its masks, how many cells are linked to
it, and the smallest mask that it is connected to within the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.llm.density_peaks import MIN_SIZE, THRESHOLD, TYPICAL
from typeloom.llm.graph import min_label_components
from typeloom.storage import Stage

BLOCK = 32_768  # masks in a block at most, on average
ENTRIES = 1 << 20  # comparisons made at once
PAIRS = 32  # of blocks in a task, about
_LOW = np.uint64(0xFFFFFFFF)


def least_common(p: int, q: int, threshold: float) -> int:
    """The fewest common pixels of linked pictures of p and q pixels; above both if there is no link."""
    return next((c for c in range(min(p, q) + 1) if c / (p + q - c) >= threshold), 65)


def _merged(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the smallest member's place) after the places u and v are joined."""
    u, v = label[u], label[v]
    while (u != v).any():
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label != (up := label[label])).any():
            label = up
        u, v = label[u], label[v]
    return label


def block_links(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two blocks of masks, each of one pixel count: weight linked to each of a, to each of b, and labels over a and then b.

    A label is a place in a and b, the same for all that links connect. Masks are sorted by the pixels of their lower half: with
    p, q pixels and at least c in common, two halves differ by p-c or q-c at most, which leaves a range of b for each part of a.
    """
    n, label = len(a), np.arange(len(a) + len(b))
    near_a, near_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    p, q = int(np.bitwise_count(a[0])), int(np.bitwise_count(b[0]))
    least = least_common(p, q, threshold)
    if least > min(p, q):
        return near_a, near_b, label
    low_a, low_b = np.bitwise_count(a & _LOW).astype(np.int64), np.bitwise_count(b & _LOW).astype(np.int64)
    rows, cols = np.argsort(low_a, kind="stable"), np.argsort(low_b, kind="stable")
    low_a, low_b, step = low_a[rows], low_b[cols], max(1, ENTRIES // len(b))
    for at in range(0, n, step):
        i, low = rows[at : at + step], low_a[at : at + step]
        j = cols[np.searchsorted(low_b, low[0] - (p - least)) : np.searchsorted(low_b, low[-1] + (q - least), side="right")]
        linked = np.bitwise_count(a[i][:, None] & b[j][None, :]) >= least
        i, linked = i[keep := linked.any(axis=1)], linked[keep]
        if not len(i):
            continue
        ones = linked.astype(np.float64)  # sums below 2^53 are exact
        near_a[i] += (ones @ wb[j].astype(np.float64)).astype(np.int64)
        near_b[j] += (wa[i].astype(np.float64) @ ones).astype(np.int64)
        while True:  # each picture joins the first that is linked and not yet connected, until none is left
            apart = linked & (label[i][:, None] != label[n + j][None, :])
            r, c = np.nonzero(apart.any(axis=1))[0], np.nonzero(apart.any(axis=0))[0]
            if not len(r):
                break
            u = np.concatenate([i[r], i[apart[:, c].argmax(axis=0)]])
            v = np.concatenate([n + j[apart[r].argmax(axis=1)], n + j[c]])
            label = _merged(label, u, v)
    return near_a, near_b, label


def _measure(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch["a"][k].as_py() == batch["b"][k].as_py()
                a, wa, b, wb = (batch[c][k].values.to_numpy() for c in ("masks_a", "copies_a", "masks_b", "copies_b"))
                near_a, near_b, label = block_links(a.view(np.uint64), wa, b.view(np.uint64), wb, threshold)
                both = np.concatenate([a, b])
                near = np.concatenate([near_a, np.zeros_like(near_b) if same else near_b])
                some = (near > 0) | (both != both[label])
                yield pa.RecordBatch.from_arrays([pa.array(both[some]), pa.array(near[some]), pa.array(both[label][some])], ["mask", "near", "other"])

    return run


def linked_masks(stage: Stage, weights: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(mask, near, other) from ``weights(mask, copies)``: summed by mask, near is the weight of all masks linked to it, its own

    included; the pairs of mask and other connect what links connect.
    """
    on = F.bit_count("mask").alias("p")
    sizes = {r["p"]: r["n"] for r in weights.groupBy(on).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    parts = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p, n in sizes.items() for x in (p, -(-n // BLOCK)))), F.col("p")), F.lit(1)) if sizes else F.lit(1)
    named = weights.withColumn("p", F.bit_count("mask")).withColumn("part", F.pmod(F.xxhash64("mask"), parts).cast("int"))
    blocks = named.groupBy("p", "part").agg(F.collect_list(F.struct("mask", "copies")).alias("x"))
    blocks = stage.keep(blocks.select("p", "part", F.col("x.mask").alias("masks"), F.col("x.copies").alias("copies")), "blocks")
    ids = [(p, k) for p, n in sorted(sizes.items()) for k in range(-(-n // BLOCK))]
    fits = {(p, q) for p in sizes for q in sizes if least_common(p, q, threshold) <= min(p, q)}
    pairs = [(i, *x, *y) for i, (x, y) in enumerate((x, y) for x in ids for y in ids if x <= y and (x[0], y[0]) in fits)]
    pairs = stage.keep(stage.spark.createDataFrame(pairs, "pair long, pa int, ka int, pb int, kb int"), "pairs")
    tasks = max(4 * stage.spark.sparkContext.defaultParallelism, pairs.count() // PAIRS)
    sides = [
        blocks.join(F.broadcast(pairs), (F.col("p") == F.col(f"p{s}")) & (F.col("part") == F.col(f"k{s}")))
        .select("pair", F.struct("p", "part").alias(s), F.col("masks").alias(f"masks_{s}"), F.col("copies").alias(f"copies_{s}"))
        .repartition(tasks, "pair")
        for s in "ab"
    ]
    return stage.keep(sides[0].join(sides[1], "pair").mapInArrow(_measure(threshold), "mask bigint, near bigint, other bigint"), "linked")


def cell_clusters(spark: SparkSession, cells: DataFrame, threshold: float = THRESHOLD, min_size: int = MIN_SIZE) -> DataFrame:
    """(cell_id, mask, cluster_id, rho): one row for each cell and picture of a cluster of at least min_size cells.

    Two cells are linked if the pixels set in both are at least ``threshold`` of the pixels set in either; a cluster is what links
    connect, ``cluster_id`` its smallest cell_id. rho counts the cells linked to a cell, itself and its copies included. Blank cells
    and null ids don't take part, whatever ``is_empty`` says. Rows that came twice count once; a cell with two different
    masks joins what both belong to. An empty table gives no rows.
    """
    stage = Stage(spark, "cell-clusters")
    members = stage.keep(cells.filter("mask <> 0 AND cell_id IS NOT NULL").select("cell_id", "mask").distinct(), "members")
    weights = stage.keep(members.groupBy("mask").agg(F.count("*").alias("copies")), "weights")
    linked = linked_masks(stage, weights, threshold)
    twice = members.groupBy("cell_id").agg(F.min("mask").alias("least"), F.max("mask").alias("most")).filter("least <> most")
    same = members.join(twice, "cell_id").select(F.col("mask").alias("u"), F.col("least").alias("v"))
    edges = linked.filter("mask <> other").select(F.col("mask").alias("u"), F.col("other").alias("v")).unionByName(same)
    labels = min_label_components(stage, edges, weights.select(F.col("mask").alias("id")))
    rho = linked.groupBy("mask").agg(F.sum("near").alias("rho"))
    placed = stage.keep(members.join(rho.join(labels.withColumnRenamed("id", "mask"), "mask"), "mask"), "placed")
    sizes = placed.groupBy("label").agg(F.min("cell_id").alias("cluster_id"), F.count_distinct("cell_id").alias("size")).filter(F.col("size") >= min_size)
    return placed.join(sizes, "label").select("cell_id", "mask", "cluster_id", "rho")


def described(found: DataFrame, typical: int = TYPICAL) -> DataFrame:
    """(cluster_id, size, typical array<bigint>): the typical members are the densest, ties by cell_id."""
    one = found.groupBy("cluster_id", "cell_id").agg(F.max("rho").alias("rho"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("rho"), "cell_id")
    heads = one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= typical)
    lists = heads.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cell_id"))), lambda x: x["cell_id"]).alias("typical"))
    return one.groupBy("cluster_id").agg(F.count("*").alias("size")).join(lists, "cluster_id")
