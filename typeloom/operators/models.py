"""Vocabulary clustering and model scoring: trainable stand-ins from pyspark.ml, and a host for NumPy forward passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.storage import Stage, open_shared, write_shared

OVERSIZE = 1.15
LEAST_SHARE, LEAST_COUNT, LEAST_GAP = 0.2, 10, 0.22
NOISE = 0.02
STEPS, LOCAL_ROUNDS = 2, 30
SETTLED = 1e-4
PART, CHUNK = 262_144, 512  # points that a task of a round holds, and that meet the same candidates


def prune(centres: np.ndarray, population: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Exactly k of the over-clustered centres, all of them small arrays on the driver.

    Kept are centres with enough members that aren't near another; if none is, the largest. Too many are cut by
    population. Missing ones are filled with the rest of those that have members, by population and then gap, and at last with noisy copies.
    """
    norms = (centres**2).sum(1)
    d2 = np.maximum(norms[:, None] + norms[None, :] - 2 * centres @ centres.T, 0)
    np.fill_diagonal(d2, np.inf)
    gap = d2.min(1) if len(centres) > 1 else np.full(len(centres), np.inf)
    expected = population.sum() / max(1, len(centres))
    good = (population >= max(LEAST_COUNT, math.floor(LEAST_SHARE * expected))) & (gap > LEAST_GAP)
    ranked = lambda idx: sorted(idx, key=lambda i: (-population[i], -gap[i], i))
    kept = ranked(np.nonzero(good)[0])[:k] if good.any() else ranked(range(len(centres)))[:k]
    kept += [i for i in ranked(np.nonzero(population > 0)[0]) if i not in set(kept)][: k - len(kept)]
    out = centres[kept]
    rng = np.random.default_rng(seed)
    while len(out) < k:
        out = np.vstack([out, np.clip(out[len(out) % len(kept)] + rng.normal(0, NOISE, out.shape[1]), 0, 1)])
    return out


def _points(column: pa.Array) -> np.ndarray:
    """Rows of 64 pixels from masks, or the vectors as they are, with a last column of 1 for the norms of centres."""
    if pa.types.is_integer(column.type):
        x = np.unpackbits(column.to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    else:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.hstack([x, np.ones((len(x), 1))])


def _blocks(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, points, nearest centre, squared distance), 1,024 rows at a time: one single-precision product with all centres."""
    table = np.hstack([centres, -(centres**2).sum(1)[:, None] / 2]).astype(np.float32).T.copy()
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            x = _points(part.column(0))
            score = x.astype(np.float32) @ table
            best = score.argmax(1)
            x = x[:, :-1]
            yield part, x, best, np.maximum((x**2).sum(1) - 2.0 * score[np.arange(len(x)), best], 0)


def _vectors(rows: DataFrame) -> np.ndarray:
    """The points of a few rows, on the driver."""
    found = rows.select("v").toArrow().column(0).combine_chunks()
    return _points(found)[:, :-1] if len(found) else np.zeros((0, 0))


def _assigned(data: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted sum of the points nearest to each centre, and their weight; one row a task comes to the driver, all tasks at a time."""
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1))
        for part, x, best, _ in _blocks(batches, centres):
            w = part.column(1).to_numpy()
            order = np.argsort(best, kind="stable")
            starts = np.nonzero(np.r_[True, np.diff(best[order]) > 0])[0]
            total[best[order][starts]] += np.add.reduceat(np.hstack([x * w[:, None], w[:, None]])[order], starts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = sum(np.frombuffer(r["total"]).reshape(k, width + 1) for r in data.select("v", "weight").mapInArrow(run, "total binary").collect())
    return total[:, :-1], total[:, -1]


def _starts(data: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means|| over ``data(v, weight, h)``: in each of STEPS rounds every point is drawn with its share of the cost, 2k in all;
    k of the drawn, weighted by the points nearest to them, are left by k-means++ and a few rounds among them."""
    centres = _vectors(data.orderBy("h", "v").limit(1))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, d2 in _blocks(batches, centres):
            yield pa.RecordBatch.from_arrays([pa.array([float((part.column(1).to_numpy() * d2).sum())])], ["c"])

    for step in range(STEPS):
        total = data.select("v", "weight").mapInArrow(costs, "c double").agg(F.sum("c")).first()[0]

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, _, d2 in _blocks(batches, centres):
                h = (part.column(2).to_numpy().view(np.uint64) ^ np.uint64(step + 1)) * np.uint64(0x9E3779B97F4A7C15)  # noqa: B023
                u = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)) / 2.0**53
                yield part.filter(pa.array(u < 2.0 * k * part.column(1).to_numpy() * d2 / max(total, 1e-300)))  # noqa: B023

        new = _vectors(data.mapInArrow(drawn, data.schema))
        centres = np.unique(np.vstack([centres, new]) if len(new) else centres, axis=0)
    if len(centres) < k:  # too few were drawn: points in the order of their hashes
        more = _vectors(data.orderBy("h", "v").limit(k + len(centres)))
        fresh = [v for v in more if not (centres == v).all(1).any()]
        return np.vstack([centres, *fresh])[:k]
    weights = _assigned(data, centres)[1]
    rng = np.random.default_rng(seed)
    norms = (centres**2).sum(1)
    chosen = [int(rng.choice(len(centres), p=weights / weights.sum()))]
    d2 = np.full(len(centres), np.inf)
    while len(chosen) < k:
        d2 = np.minimum(d2, np.maximum(norms + norms[chosen[-1]] - 2 * centres @ centres[chosen[-1]], 0))
        d2[chosen] = 0
        p = weights * d2
        p = p if p.sum() > 0 else np.where(np.isin(np.arange(len(centres)), chosen), 0.0, 1.0)
        chosen.append(int(rng.choice(len(centres), p=p / p.sum())))
    out = centres[chosen]
    for _ in range(LOCAL_ROUNDS):
        near = (centres @ out.T - (out**2).sum(1) / 2).argmax(1)
        w = np.bincount(near, weights, k)
        sums = np.zeros_like(out)
        np.add.at(sums, near, centres * weights[:, None])
        new = np.where(w[:, None] > 0, sums / np.maximum(w, 1e-300)[:, None], out)
        if np.array_equal(new, out):
            break
        out = new
    return out


def _sums(x: np.ndarray, w: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, rows): for each centre in ``near`` the weighted sum of its points, their weight and their number."""
    order = np.argsort(near, kind="stable")
    starts = np.nonzero(np.r_[True, np.diff(near[order]) > 0])[0]
    return near[order][starts], np.add.reduceat(np.hstack([x * w[:, None], w[:, None], np.sign(w)[:, None]])[order], starts)


def _reach(column: pa.Array, near: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The squared distance from a point's own centre at which another may be as near: that of twice its own distance."""
    out = np.empty(len(near))
    for at in range(0, len(near), 4096):
        some = slice(at, at + 4096)
        out[some] = 4 * ((_points(column[some])[:, :-1] - centres[near[some]]) ** 2).sum(1)
    return out


def _renewed(column: pa.Array, near: np.ndarray, reach: np.ndarray, centres: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and its ``reach``, from what they were before the ``moved`` centres moved.

    A point u away from its centre has no nearer one 2u or more from that centre, and where its own stayed, only those that
    moved can have come nearer. Candidates meet in single precision; a point goes over only if it is nearer in double precision too.
    """
    norms = (centres**2).sum(1)
    table = np.hstack([centres, -norms[:, None] / 2]).astype(np.float32)
    here, row = np.unique(near, return_inverse=True)
    far = np.full((len(here), len(centres)), np.inf)
    for rows, columns in ((np.nonzero(moved[here])[0], np.arange(len(centres))), (np.nonzero(~moved[here])[0], np.nonzero(moved)[0])):
        far[np.ix_(rows, columns)] = norms[here[rows]][:, None] + norms[columns] - 2 * centres[here[rows]] @ centres[columns].T
    far[np.arange(len(here)), here] = np.inf
    far -= 1e-9 * (1 + norms.max())  # rounding
    least = far.min(1)
    far[np.arange(len(here)), here] = -np.inf  # its own is always among the candidates
    out, reach, start = near.copy(), reach.copy(), 0
    went = np.nonzero(moved[near])[0]
    reach[went] = _reach(column.take(pa.array(went)), near[went], centres)
    todo = np.nonzero(reach > least[row])[0]
    todo = todo[np.lexsort((reach[todo], row[todo]))]
    points = np.empty((len(todo), table.shape[1]), np.float32)
    for at in range(0, len(todo), 16_384):
        points[at : at + 16_384] = _points(column.take(pa.array(todo[at : at + 16_384])))
    for end in np.nonzero(np.diff(row[todo], append=-1))[0] + 1:
        g = row[todo[start]]
        for at in range(start, end, CHUNK):
            own = todo[at : min(at + CHUNK, end)]
            some = np.flatnonzero(far[g] < reach[own[-1]])
            best = some[(points[at : at + len(own)] @ table[some].T).argmax(1)]
            over = np.flatnonzero(best != here[g])
            if len(over):
                own, best = own[over], best[over]
                x = _points(column.take(pa.array(own)))[:, :-1]
                d2 = ((x - centres[best]) ** 2).sum(1)
                nearer = d2 < ((x - centres[here[g]]) ** 2).sum(1)
                out[own[nearer]], reach[own[nearer]] = best[nearer], 4 * d2[nearer]
        start = end
    return out, reach


def _line(centres: np.ndarray) -> np.ndarray:
    """An order in which centres beside each other are mostly near each other: halves along the direction in which they differ most."""
    if len(centres) <= 8:
        return np.arange(len(centres))
    from_mean = centres - centres.mean(0)
    order = np.argsort(from_mean @ np.linalg.eigh(from_mean.T @ from_mean)[1][:, -1], kind="stable")
    return np.concatenate([half[_line(centres[half])] for half in np.array_split(order, 2)])


class _Rounds:
    """Lloyd's rounds over ``data(v, weight, h)``: ``total`` has the weighted sum, weight and number of the points of each of ``centres``.

    Points lie in parts by the centre they start with, at most about PART in each, near centres together, so that a task has many
    points of few centres. Which centre is the nearest is kept in the shared folder beside the points, a file a part; the driver gets
    what changed in the sums.
    """

    def __init__(self, stage: Stage, data: DataFrame, centres: np.ndarray):
        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, best, _ in _blocks(batches, centres):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.astype(np.int32))], ["v", "weight", "h", "near"])

        self.stage, self.spark, self.centres, self.round = stage, stage.spark, centres, 0
        kind = dict(data.dtypes)["v"]
        placed = stage.keep(data.mapInArrow(nearest, f"v {kind}, weight double, h bigint, near int"), "placed")
        sizes = np.zeros(len(centres), np.int64)
        for r in placed.groupBy("near").count().collect():
            sizes[r["near"]] = r["count"]
        line, before, points = _line(centres), np.zeros_like(sizes), sizes.sum()
        before[line] = np.cumsum(sizes[line]) - sizes[line]
        self.parts = parts = int(max(self.spark.sparkContext.defaultParallelism, -(-points // PART)))

        def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = b.column(3).to_numpy()
                at = before[near] + b.column(2).to_numpy().view(np.uint64) % sizes[near].astype(np.uint64)  # spreads the points of one centre evenly
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array((at * parts // points).astype(np.int32))], ["v", "weight", "near", "part"])

        self.points = stage.path("parts")
        placed.mapInArrow(parted, f"v {kind}, weight double, near int, part int").repartition("part").write.partitionBy("part").parquet(self.points)
        stage.drop(placed)
        self.state = stage.path("nearest")
        self.total = np.zeros((len(centres), centres.shape[1] + 2))
        self._assign(np.zeros(len(centres), bool))

    def _assign(self, moved: np.ndarray) -> None:
        centres, points, state, at = self.centres, self.points, self.state, self.round

        def run(part: int) -> tuple[np.ndarray, np.ndarray] | None:
            rows = open_shared(f"{points}/part={part}")
            if rows is None:
                return None
            column, w, found = rows["v"].combine_chunks(), rows["weight"].to_numpy(), None
            if at == 0:
                new = rows["near"].to_numpy()
                reach = _reach(column, new, centres)
                found = _sums(_points(column)[:, :-1], w, new)
            else:
                old, reach = (c.to_numpy() for c in open_shared(f"{state}/{at - 1}/{part}").select(["near", "reach"]).columns)
                new, reach = _renewed(column, old, reach, centres, moved)
                other = np.nonzero(new != old)[0]
                if len(other):
                    found = _sums(np.tile(_points(column.take(pa.array(other)))[:, :-1], (2, 1)), np.r_[w[other], -w[other]], np.r_[new[other], old[other]])
            write_shared(f"{state}/{at}/{part}", pa.table({"near": new, "reach": reach}))
            return found

        for found in self.spark.sparkContext.parallelize(range(self.parts), self.parts).map(run).collect():
            if found:
                self.total[found[0]] += found[1]
        self.total[self.total[:, -1] == 0] = 0  # nothing of rounding stays where no point does
        if at:
            self.stage.remove(f"{state}/{at - 1}")
        self.round += 1

    def move(self) -> float:
        """Moves the centres to the means of their points and gives each point its nearest again; how far the centres went at most."""
        weight = self.total[:, -2:-1]
        new = np.where(weight > 0, self.total[:, :-2] / np.maximum(weight, 1e-300), self.centres)
        moved = (new != self.centres).any(1)
        most = float(np.sqrt(((new - self.centres) ** 2).sum(1).max()))
        self.centres = new
        if moved.any():
            self._assign(moved)
        return most


def vocabulary(spark: SparkSession, points: DataFrame, vector: str, k: int, seed: int = 0, iterations: int = 20, weight: str | None = None) -> DataFrame:
    """(centroid_id, v): k centroids from over-clustering and pruning, after the all-zero EMPTY centroid of id 0.

    ``vector`` holds arrays or 64-pixel masks. ``weight``: a column with the number of points that a row stands for, in the means as in
    the populations. Rounds of Lloyd's method go on until no centre moves by more than SETTLED, or for ``iterations``.
    """
    times = (F.col(weight) if weight else F.lit(1)).cast("double").alias("weight")
    mask = dict(points.dtypes)[vector] == "bigint"
    own = points.filter(F.col(vector).isNotNull()).select((F.col(vector) if mask else F.col(vector).cast("array<double>")).alias("v"), times)
    stage = Stage(spark, "vocabulary")
    # as many files as cores, so that each round's scan takes all of them
    data = own.groupBy("v").agg(F.sum("weight").alias("weight")).filter("weight > 0").withColumn("h", F.xxhash64("v", F.lit(seed)))
    data = stage.keep(data.repartition(spark.sparkContext.defaultParallelism), "points")
    first = math.ceil(OVERSIZE * k)
    centres = _starts(data, first, seed) if data.count() > first else _vectors(data.orderBy("h", "v"))
    if not len(centres):
        raise ValueError("no points")
    rounds = _Rounds(stage, data, centres)
    for _ in range(iterations):
        if rounds.move() <= SETTLED:
            break
    centres, population = rounds.centres, np.rint(rounds.total[:, -2]).astype(np.int64)
    stage.close()
    kept = prune(centres, population, k, seed)
    rows = [(0, [0.0] * kept.shape[1])] + [(i + 1, [float(x) for x in v]) for i, v in enumerate(kept)]
    return spark.createDataFrame(rows, "centroid_id bigint, v array<double>")


def fit_classifier(rows: DataFrame, vector: str, label: str, hidden: int, classes: int, seed: int = 0, iterations: int = 30) -> MultilayerPerceptronClassificationModel:
    """The trainable stand-in for the cell classifier."""
    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    width = len(data.first()["features"])
    return MultilayerPerceptronClassifier(layers=[width, hidden, classes], seed=seed, maxIter=iterations).fit(data)


def scored(rows: DataFrame, key: str, vector: str, forward: Callable[[np.ndarray], np.ndarray], batch: int = 1024) -> DataFrame:
    """(key, pred, conf, second): any NumPy forward pass from (n, width) inputs to (n, classes) logits, in Arrow batches.

    The weights travel with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                z = forward(x)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int64)), pa.array(p.max(1)), pa.array(second)], [key, "pred", "conf", "second"])

    kind = dict(rows.dtypes)[key]
    return rows.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"`{key}` {kind}, pred bigint, conf double, second double")


def cell_scores(cells: DataFrame, key: str, mask: str, forward: Callable[[np.ndarray], np.ndarray], centroids: np.ndarray, assigned: str | None = None, batch: int = 4096) -> DataFrame:
    """(key, pred, conf, d_pred, d_assigned): a cell model's choice for each 64-pixel mask, and how far the cell's pixels lie from
    the centroid of that choice and of the ``assigned`` one.

    Distances are null beyond the ``centroids`` (one row a primitive, EMPTY at 0) and for a null or negative assignment. Masks
    travel as 8 bytes and are unpacked in the task. Rows with a null mask are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                masks = part.column(1).to_numpy()
                x = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                z = forward(x)
                p = np.exp(z - z.max(1, keepdims=True))
                best = p.argmax(1)
                far = lambda ids: pa.array(np.sqrt(((x - centroids[np.clip(ids, 0, len(centroids) - 1)]) ** 2).sum(1)), mask=(ids < 0) | (ids >= len(centroids)))  # noqa: B023, E731
                own = part.column(2).fill_null(-1).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int64)), pa.array(p.max(1) / p.sum(1)), far(best), far(own)], [key, "pred", "conf", "d_pred", "d_assigned"])

    rows = cells.filter(F.col(mask).isNotNull()).select(key, F.col(mask).cast("bigint"), (F.col(assigned) if assigned else F.lit(None)).cast("bigint").alias("assigned"))
    return rows.mapInArrow(run, f"`{key}` {dict(cells.dtypes)[key]}, pred bigint, conf double, d_pred double, d_assigned double")


def picture_grids(pictures: DataFrame, key: str, forward: Callable[[np.ndarray], np.ndarray], side: int = 128, least_ink: float = 0.0) -> DataFrame:
    """(key, grid array<int>): raster to token grid in one step; each 8x8 patch of ``px`` goes through a cell model.

    Patches without a set pixel, or with no more than ``least_ink`` of scaled grey in all, are 0, whatever the model says.
    Pictures of another size raise; null ones are left out. The model sees grey values scaled to 0..1.
    """
    n = side // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                raw = part.column(1).to_pylist()
                if wrong := [len(px) for px in raw if len(px) != side * side]:
                    raise ValueError(f"a picture has {wrong[0]} pixels instead of {side * side}")
                patches = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), n, 8, n, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 64)
                grey = patches / 255.0 if patches.max(initial=0) > 1 else patches.astype(np.float64)
                tokens = np.zeros(len(patches), np.int32)
                inked = (patches.max(1) > 0) & ((least_ink <= 0) | (grey.sum(1) > least_ink))
                if inked.any():
                    tokens[inked] = forward(grey[inked]).argmax(1)
                offsets = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * n * n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(tokens))], [key, "grid"])

    return pictures.filter(F.col("px").isNotNull()).select(key, "px").mapInArrow(run, f"`{key}` {dict(pictures.dtypes)[key]}, grid array<int>")


def centroid_network(centroids: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The simplest cell model: the logit of a primitive is its centroid's negative squared distance."""
    norms = (centroids**2).sum(1)
    return lambda x: 2 * x @ centroids.T - norms - (x * x).sum(1)[:, None]


def cell_network(weights: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """The forward pass of a small convolutional cell classifier over 8x8 inputs of 0 and 1.

    Two rounds of 3x3 convolution (same padding), folded batch norm, ReLU and 2x2 max pooling, then two dense layers.
    ``weights``: conv1 (c1,1,3,3), scale1, shift1, conv2 (c2,c1,3,3), scale2, shift2, dense1 (h, c2*4), bias1, dense2 (k, h), bias2.
    """

    def conv(x: np.ndarray, kernel: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
        padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(2, 3))
        y = np.einsum("nchwij,ocij->nohw", windows, kernel, optimize=True) * scale[:, None, None] + shift[:, None, None]
        y = np.maximum(y, 0)
        n, c, h, w = y.shape
        return y.reshape(n, c, h // 2, 2, w // 2, 2).max(axis=(3, 5))

    def forward(x: np.ndarray) -> np.ndarray:
        y = x.reshape(-1, 1, 8, 8).astype(np.float64)
        y = conv(y, weights["conv1"], weights["scale1"], weights["shift1"])
        y = conv(y, weights["conv2"], weights["scale2"], weights["shift2"])
        y = np.maximum(y.reshape(len(y), -1) @ weights["dense1"].T + weights["bias1"], 0)
        return y @ weights["dense2"].T + weights["bias2"]

    return forward


def _gelu(x: np.ndarray) -> np.ndarray:
    """x * Phi(x), with an approximation of the error function that is off by 1.5e-7 at most (Abramowitz and Stegun 7.1.26)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return x * np.where(x >= 0, 1 - tail / 2, tail / 2)


def convolved(x: np.ndarray, layer: dict) -> np.ndarray:
    """Odd square kernel, zeros around the edge, stride, then a scale and shift a channel (folded batch norm)."""
    kernel, stride = layer["kernel"], layer.get("stride", 1)
    size = kernel.shape[2]
    pad = size // 2
    padded = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (size, size), axis=(2, 3))[:, :, ::stride, ::stride]
    return np.einsum("nchwij,ocij->nohw", windows, kernel, optimize=True) * layer["scale"][:, None, None] + layer["shift"][:, None, None]


def grid_network(weights: dict, activation: str = "gelu", unit: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """The forward pass of a convolutional classifier of 16x16 token grids: embedding, stem, stages, mean over places, head.

    ``weights``: embed (vocabulary, d); stem, a layer of kernel (o, d, k, k), scale, shift (o) and stride; stages, a list whose
    entries are one layer (a change of width or size) or a pair of them (a residual block: x plus both in turn); norm, shift
    (c) of the head's layer norm; head (k, c or h), bias; with a hidden layer also dense (h, c), dense_bias. ``unit``: token
    vectors are scaled to length 1.
    """
    act = {"gelu": _gelu, "relu": lambda x: np.maximum(x, 0)}[activation]

    def forward(tokens: np.ndarray) -> np.ndarray:
        x = weights["embed"][tokens.astype(np.int64)]
        if unit:
            x = x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
        x = act(convolved(x.reshape(len(x), 16, 16, -1).transpose(0, 3, 1, 2), weights["stem"]))
        for step in weights["stages"]:
            x = act(convolved(x, step)) if isinstance(step, dict) else x + act(convolved(act(convolved(x, step[0])), step[1]))
        y = x.mean(axis=(2, 3))
        y = (y - y.mean(-1, keepdims=True)) / np.sqrt(y.var(-1, keepdims=True) + 1e-5) * weights["norm"] + weights["shift"]
        if "dense" in weights:
            y = act(y @ weights["dense"].T + weights["dense_bias"])
        return y @ weights["head"].T + weights["bias"]

    return forward


def transformer_network(weights: dict, heads: int, pool: str = "mean") -> Callable[[np.ndarray], np.ndarray]:
    """The forward pass of a grid transformer over 256 tokens: embedding plus position code, pre-norm encoder layers, pooling, head.

    ``weights``: embed (vocabulary, d), position (256, d), layers (list of wq, wk, wv, wo (d, d), bq, bk, bv, bo, n1, m1, n2, m2 (d),
    up (f, d), bu, down (d, f), bd), norm, shift (d), head (k, d), bias; with ``pool='cls'`` also cls (d).
    """

    def norm(x: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * g + b

    def forward(tokens: np.ndarray) -> np.ndarray:
        x = weights["embed"][tokens.astype(np.int64)] + weights["position"]
        if pool == "cls":
            x = np.concatenate([np.broadcast_to(weights["cls"], (len(x), 1, x.shape[2])), x], axis=1)
        n, t, d = x.shape
        split = lambda y: y.reshape(n, t, heads, d // heads).transpose(0, 2, 1, 3)
        for w in weights["layers"]:
            y = norm(x, w["n1"], w["m1"])
            q, k, v = (split(y @ w[f"w{c}"].T + w[f"b{c}"]) for c in "qkv")
            a = q @ k.transpose(0, 1, 3, 2) / math.sqrt(d // heads)
            a = np.exp(a - a.max(-1, keepdims=True))
            a /= a.sum(-1, keepdims=True)
            x = x + (a @ v).transpose(0, 2, 1, 3).reshape(n, t, d) @ w["wo"].T + w["bo"]
            y = np.maximum(norm(x, w["n2"], w["m2"]) @ w["up"].T + w["bu"], 0)
            x = x + y @ w["down"].T + w["bd"]
        pooled = x[:, 0] if pool == "cls" else x.mean(1)
        return norm(pooled, weights["norm"], weights["shift"]) @ weights["head"].T + weights["bias"]

    return forward


def checkpoint_report(tensors: DataFrame) -> DataFrame:
    """(family, n_tensors, parameters, vocabulary, width, classes) from (key, shape array<bigint>) of a checkpoint."""
    key, shape = F.col("key"), F.col("shape")
    size = F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)
    first = lambda pattern, i: F.max(F.when(key.rlike(pattern), F.element_at(shape, i)))
    has = lambda pattern: F.bool_or(key.rlike(pattern))
    family = F.when(has("context|fusion|delta"), "sequence_cnn").when(has("encoder|self_attn|cls_token"), "transformer").when(has("stage|stem"), "grid_cnn").otherwise("cell_cnn")
    return tensors.agg(
        family.alias("family"), F.count("*").alias("n_tensors"), F.sum(size).alias("parameters"), first("embed.*weight$", 1).alias("vocabulary"), first("embed.*weight$", 2).alias("width"),
        first("(head|classifier|fc).*weight$", 1).alias("classes"),
    )
