import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeloom.operators import compaction, counts, evaluation, grids, models, nearest, outlines, quality, series, splits


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stratified_split_sizes(spark):
    df = spark.createDataFrame([(i, lab) for lab, n in (("a", 1), ("b", 2), ("c", 7), ("d", 100)) for i in range(n)], "k int, label string").withColumn("key", F.concat("label", F.col("k").cast("string")))
    got = {(r.label, r.split): r["count"] for r in splits.stratified_split(df, "key", "label").groupBy("label", "split").count().collect()}
    assert got == {("a", "train"): 1, ("b", "train"): 1, ("b", "test"): 1, ("c", "train"): 6, ("c", "test"): 1, ("d", "train"): 86, ("d", "val"): 10, ("d", "test"): 4}


def test_group_split_is_half_even_and_disjoint(spark):
    df = spark.createDataFrame([(f"g{i % 25}", i) for i in range(100)], "g string, i int")
    got = splits.group_split(df, "g").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 20, "val": 2, "test": 3}
    with pytest.raises(ValueError):
        splits.group_split(df, "g", train=0.9)


def test_first_claim_and_selectors(spark):
    df = spark.createDataFrame([(1, "test"), (1, "train"), (2, "val"), (2, "test"), (3, None)], "id int, split string")
    assert rows(splits.first_claim(df, "id")) == [(1, "train"), (2, "val")]
    ids = spark.range(100)
    assert [r.id for r in splits.every_nth(ids, "id", 25).orderBy("id").collect()] == [0, 25, 50, 75]
    assert splits.selected(ids, "id").count() == 10 and splits.selected(ids, "id", k=7).count() == 7 and splits.sample_k(ids, "id", 0).count() == 100
    assert splits.downsampled(ids, "id", F.col("id") < 50, 0.0).count() == 50


def test_histogram_fills_zeros_and_buckets(spark):
    df = spark.createDataFrame([(0,)] * 12 + [(3,), (-1,), (9,)], "v int")
    h = counts.filled_histogram(spark, df, "v", 5)
    assert [r.n for r in h.orderBy("value").collect()] == [12, 0, 0, 1, 0]
    assert {(r.bucket, r["values"], r.population) for r in counts.bucketed(h).collect()} == {(0, 4, 1), (1, 1, 12)}
    assert counts.filled_histogram(spark, df.limit(0), "v", 2).agg(F.sum("n")).first()[0] == 0


def test_order_statistics_wrap(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 11)] + [("b", 7)], "g string, v int")
    got = {r.g: (r.n, r.p50, r.p90, r.p95) for r in counts.order_statistics(df, "g", "v").collect()}
    assert got == {"a": (10, 6, 9, 9), "b": (1, 7, 7, 7)}


def test_macro_f1_ignores_classes_without_support(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (None, 1)], "truth int, pred int")
    scores = evaluation.class_scores(evaluation.confusion(df))
    assert {r.label: (r.support, r.predicted, r.hits) for r in scores.collect()} == {0: (2, 1, 1), 1: (2, 2, 1), 2: (0, 1, 0)}
    r = evaluation.macro_f1(scores, spark.createDataFrame([(0,)], "label int")).first()
    assert r.macro_f1_all == pytest.approx((2 / 3 + 0.5) / 2, abs=1e-9) and r.macro_f1_seen == pytest.approx(2 / 3, abs=1e-9)
    empty = evaluation.macro_f1(evaluation.class_scores(evaluation.confusion(df.limit(0)))).first()
    assert empty.macro_f1_all == 0.0


def test_confused_pairs_order(spark):
    df = spark.createDataFrame([(0, 1, 3), (1, 0, 2), (2, 3, 9), (0, 0, 99)], "t int, p int, n long")
    assert [tuple(r)[:4] for r in evaluation.confused_pairs(df, 5).collect()] == [(0, 1, 3, 2), (2, 3, 9, 0)]


def test_nearest_centroid_ties_blocks_and_nulls(spark, monkeypatch):
    points = spark.createDataFrame([(1, [0.5, 0.0]), (2, [1.0, 0.0]), (3, None)], "id long, v array<double>")
    cents = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "centroid_id long, v array<double>")
    assert rows(nearest.nearest_centroid(points, "id", "v", cents)) == [(1, 0, 0.25), (2, 1, 0.0)]
    monkeypatch.setattr(nearest, "BLOCK", 2)
    assert rows(nearest.nearest_centroid(points, "id", "v", cents)) == [(1, 0, 0.25), (2, 1, 0.0)]
    assert rows(nearest.neighbours(cents, 1.0)) == [(0, 1, 1.0, 1), (1, 0, 1.0, 2), (2, 1, 1.0, 2), (3, 2, 1.0, 1)]
    assert nearest.nearest_centroid(points, "id", "v", cents.limit(0)).count() == 0


def test_token_grid_last_wins_and_sentinels(spark):
    df = spark.createDataFrame([(1, 0, 1, 5, 1), (1, 0, 1, 6, 2), (1, 15, 15, 65535, 1), (1, 16, 0, 9, 1), (1, 2, 2, None, 1)], "glyph_id long, cell_row short, cell_col short, primitive_id int, at int")
    grid = grids.token_grids(df, F.col("at")).first().grid
    assert len(grid) == 256 and grid[1] == 6 and sum(grid) == 6


def test_context_keeps_deltas_over_gaps(spark):
    df = spark.createDataFrame([(10, 1), (11, 2), (13, 3)], "id long, v int")
    got = {r.id: [(c.delta, c.value) for c in r.context] for r in grids.with_context(spark, df, "id", "v", 2, F.lit(0)).collect()}
    assert got == {10: [(-2, 0), (-1, 0), (1, 2), (2, 0)], 11: [(-2, 0), (-1, 1), (1, 0), (2, 3)], 13: [(-2, 2), (-1, 0), (1, 0), (2, 0)]}


def test_hybrid_rules(spark):
    df = spark.createDataFrame([(1, 1, 0.99, None, None), (1, 2, 0.5, None, None), (1, 2, 0.95, None, 3.0), (1, 2, 0.95, 1.0, 0.99), (1, 2, 0.95, 1.0, 0.5)], "a int, p int, c double, da double, dp double")
    assert [r[0] for r in df.select(grids.hybrid(*map(F.col, ("a", "p", "c", "da", "dp")), 0.9, 0.1)).collect()] == [1, 1, 2, 1, 2]


def test_series(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0003, 1.0004, 1.2, 1.2, 1.2, 5.0])], "g string, e int, v double")
    assert series.early_stop(df, "g", "e", "v", 5e-4, 2).first()[:] == ("a", 1.0, 2)
    smooth = [r.smooth for r in series.moving_average(df.filter("e < 3"), "g", "e", "v", 2).orderBy("e").collect()]
    assert smooth == [1.0, pytest.approx(1.00015), pytest.approx(1.00035)]
    assert [r.end for r in series.prefix_offsets(df.withColumn("n", F.lit(2)), "g", "e", "n").orderBy("e").collect()] == [2, 4, 6, 8, 10, 12, 14]


def test_quality(spark):
    df = spark.createDataFrame([(1, 50), (2, None)], "id int, w int")
    assert quality.missing_columns(df, {"id", "x"}) == ["x"]
    assert rows(quality.asked_for(spark.createDataFrame([(1,), (3,)], "id int"), df, "id", "w")) == [(1, 50), (3, None)]
    assert [r[0] for r in df.orderBy("id").select(quality.consistency(F.col("w"), F.lit(True))).collect()] == [True, None]


def test_prune_gives_exactly_k():
    rng = np.random.default_rng(0)
    c = rng.random((12, 64))
    c[1] = c[0]
    assert models.prune(c, np.arange(12) * 20, 8, 0).shape == (8, 64)
    assert models.prune(c, np.zeros(12, int), 15, 0).shape == (15, 64)


def test_networks_shapes(spark):
    rng = np.random.default_rng(1)
    w = {"conv1": rng.normal(size=(4, 1, 3, 3)), "scale1": np.ones(4), "shift1": np.zeros(4), "conv2": rng.normal(size=(8, 4, 3, 3)), "scale2": np.ones(8), "shift2": np.zeros(8)}
    w |= {"dense1": rng.normal(size=(16, 32)), "bias1": np.zeros(16), "dense2": rng.normal(size=(10, 16)), "bias2": np.zeros(10)}
    forward = models.cell_network(w)
    assert forward(rng.integers(0, 2, (8, 64))).shape == (8, 10)
    df = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 2, 64)]) for i in range(5)], "id long, v array<double>")
    assert all(0 <= r.pred < 10 and 0 < r.second <= r.conf <= 1 for r in models.scored(df, "id", "v", forward).collect())
    d = 8
    layer = {f"w{c}": rng.normal(size=(d, d)) for c in "qkvo"} | {f"b{c}": np.zeros(d) for c in "qkvo"} | {"n1": np.ones(d), "m1": np.zeros(d), "n2": np.ones(d), "m2": np.zeros(d)}
    layer |= {"up": rng.normal(size=(16, d)), "bu": np.zeros(16), "down": rng.normal(size=(d, 16)), "bd": np.zeros(d)}
    t = {"embed": rng.normal(size=(1024, d)), "position": rng.normal(size=(256, d)), "layers": [layer], "norm": np.ones(d), "shift": np.zeros(d), "head": rng.normal(size=(100, d)), "bias": np.zeros(100), "cls": rng.normal(size=d)}
    for pool in ("mean", "cls"):
        assert models.transformer_network(t, 2, pool)(rng.integers(0, 1024, (4, 256))).shape == (4, 100)


def test_first_fit_decreasing_matches_the_plain_loop():
    for seed in range(30):
        rng = random.Random(seed)
        sizes = [rng.randint(0, 60) for _ in range(rng.randint(1, 80))]
        bins, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            at = next((b for b, room in enumerate(bins) if room >= sizes[i]), None)
            if at is None:
                bins.append(60)
                at = len(bins) - 1
            bins[at] -= sizes[i]
            want[i] = at
        assert compaction.first_fit_decreasing(np.array(sizes), 60).tolist() == [want[i] for i in range(len(sizes))]


FILES = "file_id long, file_path string, payload binary, modified_at timestamp_ntz, glyph_id string"
CHECKS = "check_id long, glyph_id long, raster_ok boolean, grid_ok boolean, raster_path string, grid_path string, raster_bytes long, grid_bytes long, checked_at timestamp_ntz"


def test_paths(spark):
    df = spark.createDataFrame([("dataset\\grids\\0a\\12.u16",), ("./dataset/./grids//0a/12.u16",), ("/mnt/store/dataset/grids/0a/12.u16",), (None,)], "p string")
    got = [tuple(r) for r in df.select(compaction.clean_path(F.col("p")), compaction.path_id(F.col("p"))).collect()]
    assert got == [("dataset/grids/0a/12.u16", 12)] * 3 + [(None, None)]


def test_consolidation_holds_every_record_once(spark, tmp_path):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    files = [(1, "dataset/grids/1.u16", b"a" * 512, t, "x"), (2, "dataset//grids/1.u16", b"a" * 512, t, "x"), (3, "dataset/grids/1.npy", b"h" * 128 + b"a" * 512, t, "x"), (4, "dataset/grids/2.npy", b"h" * 128 + b"b" * 512, t, "x")]
    files += [(5, "dataset/grids/3.u16", b"", t, "x"), (6, "dataset/grids/4.u16", None, None, None), (7, None, b"z" * 512, t, "x"), (8, "dataset/grids/5.u16", b"c" * 640, t, "x")]
    checks = [(1, 1, False, True, "r/a_1.png", "g", 5, 5, t), (2, None, True, True, "r\\a_1.png ", "g", 5, 5, datetime(2024, 2, 1)), (3, 2, True, True, "r/b_2.png", "g", 0, 5, t), (4, 3, None, True, "r/b_3.png", "g", 5, 5, t), (5, 4, True, True, None, None, 5, 5, t)]
    out = str(tmp_path / "out")
    grids, rasters = spark.createDataFrame(files, FILES), spark.createDataFrame(checks, CHECKS)
    done = compaction.consolidate(spark, compaction.stored_manifest(grids, rasters), compaction.stored_contents(grids), out, target=1024)
    got = {(r.glyph_id, r.content_kind): (bytes(r.payload) if r.payload else None) for r in done.collect()}
    want = {(1, "grid"): b"a" * 512, (2, "grid"): b"b" * 512, (1, "raster"): None}
    assert got == want
    summary = compaction.file_summary(done)
    assert summary.agg(F.sum("n_records"), F.sum("bytes"), F.count("*")).first()[:] == (3, 1024 + len("r/a_1.png"), 2)
    assert compaction.file_checks(summary, 1024).first()[4:] == (0, False)
    first = compaction.current_version(spark, out)
    # a second run: readers see each record once, and the first version can go
    compaction.consolidate(spark, compaction.stored_manifest(grids, rasters), compaction.stored_contents(grids), out, target=1024)
    assert compaction.current_version(spark, out) != first and compaction.current(spark, out).count() == 3
    assert compaction.remove_old(spark, out) == 1 and compaction.current(spark, out).count() == 3
    # a file that arrives after the listing waits; one that was listed and has gone stops the commit
    later = spark.createDataFrame([*files, (9, "dataset/grids/9.u16", b"n" * 512, t, "x"), (10, "dataset/grids/1.u16", b"N" * 512, datetime(2025, 1, 1), "x")], FILES)
    again = compaction.consolidate(spark, compaction.stored_manifest(grids, rasters), compaction.stored_contents(later), out)
    assert {(r.glyph_id, r.content_kind): (bytes(r.payload) if r.payload else None) for r in again.collect()} == want
    version = compaction.current_version(spark, out)
    with pytest.raises(RuntimeError):
        compaction.consolidate(spark, compaction.stored_manifest(later, rasters), compaction.stored_contents(grids), out)
    assert compaction.current_version(spark, out) == version
    none = compaction.consolidate(spark, compaction.stored_manifest(grids.limit(0), rasters.limit(0)), compaction.stored_contents(grids), str(tmp_path / "none"))
    assert none.count() == 0 == compaction.current(spark, str(tmp_path / "none")).count()


def test_consolidation_refuses_doubled_records(spark, tmp_path):
    two = spark.createDataFrame([(1, "raster", "p", None, 1, 1), (1, "raster", "q", None, 1, 1)], compaction.MANIFEST)
    with pytest.raises(ValueError):
        compaction.consolidate(spark, two, compaction.stored_contents(spark.createDataFrame([], FILES)), str(tmp_path / "out"))


def test_running_totals_and_medians(spark):
    rng = np.random.default_rng(3)
    values = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 40, 301 if g == "a" else 40)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r.g: r.median for r in counts.medians(df, "g", "v").collect()}
    assert got == {g: float(np.median([v for h, v in values if h == g])) for g in ("a", "b", None)}
    assert counts.medians(df.limit(0), "g", "v").count() == 0


def test_centroids_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 7)
    monkeypatch.setattr(nearest, "POINTS", 11)
    rng = np.random.default_rng(4)
    c, x = rng.integers(0, 3, (40, 5)).astype(float), rng.integers(0, 3, (60, 5)).astype(float)
    cents = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "centroid_id long, v array<double>")
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d2 = ((x[:, None] - c[None]) ** 2).sum(2)
    assert {(r.id, r.centroid_id, r.d2) for r in nearest.nearest_centroid(points, "id", "v", cents).collect()} == {(i, int(d.argmin()), d.min()) for i, d in enumerate(d2)}
    assert {r.id: list(r.d2) for r in nearest.centroid_distances(points, "id", "v", cents).collect()} == {i: d.tolist() for i, d in enumerate(d2)}
    own = ((c[:, None] - c[None]) ** 2).sum(2)
    np.fill_diagonal(own, np.inf)
    got = {(r.centroid_id, r.nearest_id, r.d2, r.close) for r in nearest.neighbours(cents, 2.0).collect()}
    assert got == {(i, int(d.argmin()), d.min(), int((d <= 2).sum())) for i, d in enumerate(own)}


def test_cell_and_picture_scoring(spark):
    rng = np.random.default_rng(5)
    centroids = np.vstack([np.zeros(64), rng.random((9, 64))])
    masks = [0, -1, 1, 5, *[int(x) for x in rng.integers(-(2**62), 2**62, 20)]]
    df = spark.createDataFrame([(i, m, [None, 3, 99, -1][i % 4]) for i, m in enumerate(masks)] + [(99, None, 1)], "cell_id long, mask long, p int")
    bits_of = lambda m: np.unpackbits(np.array([m], np.int64).view(np.uint8), bitorder="little").astype(float)
    for r in models.cell_scores(df, "cell_id", "mask", models.centroid_network(centroids), centroids, "p").collect():
        d = np.sqrt(((bits_of(masks[r.cell_id]) - centroids) ** 2).sum(1))
        assert r.pred == d.argmin() and abs(r.d_pred - d.min()) < 1e-9 and 0 < r.conf <= 1
        assert (r.d_assigned is None) == (r.cell_id % 4 != 1) and (r.d_assigned is None or abs(r.d_assigned - d[3]) < 1e-9)
    px = np.zeros((128, 128), np.uint8)
    px[8:16, 16:24] = np.round(centroids[4].reshape(8, 8) * 255)
    px[127, 127] = 3
    always = lambda x: np.eye(10)[np.full(len(x), 7)]
    pictures = spark.createDataFrame([(1, bytearray(px.tobytes())), (2, None)], "id long, px binary")
    grid = models.picture_grids(pictures, "id", models.centroid_network(centroids)).first().grid
    assert grid[16 + 2] == 4 and sum(x != 0 for x in grid) == 1
    assert [i for i, x in enumerate(models.picture_grids(pictures, "id", always).first().grid) if x] == [18, 255]
    assert [i for i, x in enumerate(models.picture_grids(pictures, "id", always, least_ink=0.5).first().grid) if x] == [18]
    with pytest.raises(Exception, match="pixels"):
        models.picture_grids(spark.createDataFrame([(1, bytearray(9))], "id long, px binary"), "id", always).collect()


def test_binarise_rules():
    cells = np.array([[0, 1, 127, 128, 255, 200], [0, 0, 0, 0, 0, 90]], np.uint8)
    on = {rule: outlines.set_pixels(cells, rule).astype(int).tolist() for rule in outlines.BINARISE}
    assert on["at_128"] == [[0, 0, 0, 1, 1, 1], [0] * 6] == on["half"] and on["above_0"] == [[0, 1, 1, 1, 1, 1], [0, 0, 0, 0, 0, 1]]
    assert on["unless_binary"] == [[0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 1]]


def test_schedules(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([5.0, 4.0, 4.0, 4.5, 4.0, 3.0])], "run string, epoch int, loss double")
    assert series.early_stop(df, "run", "epoch", "loss", 0.1, 2, mode="min").first()[:] == ("r", 4.0, 3)
    assert series.plateau_rates(df, "run", "epoch", "loss", 1.0, 0.5, 1).first().rates == [1.0, 1.0, 1.0, 0.5, 0.5, 0.5]


def test_grid_network_equals_plain_loops():
    import math

    rng = np.random.default_rng(6)
    layer = lambda o, c, k, stride=1: {"kernel": rng.normal(size=(o, c, k, k)), "scale": rng.random(o), "shift": rng.normal(size=o), "stride": stride}
    x = rng.normal(size=(2, 3, 6, 6))
    one = layer(4, 3, 3, 2)
    got = models.convolved(x, one)
    assert got.shape == (2, 4, 3, 3)
    for o in range(4):
        for r in range(3):
            for c in range(3):
                total = sum(
                    one["kernel"][o, k, i, j] * x[1, k, 2 * r + i - 1, 2 * c + j - 1] for k in range(3) for i in range(3) for j in range(3) if 0 <= 2 * r + i - 1 < 6 and 0 <= 2 * c + j - 1 < 6
                )
                assert abs(got[1, o, r, c] - (total * one["scale"][o] + one["shift"][o])) < 1e-9
    assert all(abs(models._gelu(np.array([v]))[0] - v * (1 + math.erf(v / math.sqrt(2))) / 2) < 1e-6 for v in (-3.0, -0.5, 0.0, 0.7, 4.0))
    weights = {"embed": rng.normal(size=(50, 3)), "stem": layer(4, 3, 3), "stages": [[layer(4, 4, 3), layer(4, 4, 3)], layer(6, 4, 3, 2)], "norm": np.ones(6), "shift": np.zeros(6), "head": rng.normal(size=(5, 6)), "bias": np.zeros(5)}
    out = models.grid_network(weights, "relu", unit=True)(rng.integers(0, 50, (7, 256)))
    assert out.shape == (7, 5) and np.isfinite(out).all()
    same = {**weights, "stages": [[{**weights["stages"][0][0]}, {**weights["stages"][0][1], "scale": np.zeros(4), "shift": np.zeros(4)}]] + weights["stages"][1:]}
    plain = {**weights, "stages": weights["stages"][1:]}
    tokens = rng.integers(0, 50, (3, 256))
    assert np.allclose(models.grid_network(same)(tokens), models.grid_network(plain)(tokens))  # a residual block that adds nothing


def test_coverage_and_lookups(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "k long")
    labels, grids_ = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, label string"), spark.createDataFrame([(2,), (2,), (3,)], "k long")
    assert rows(quality.covered(ids, "k", labels, grids_)) == [(2,), (3,)]
    assert rows(quality.uncovered(ids, "k", label=labels, grid=grids_)) == [(1, "grid"), (4, "label")]
    with pytest.raises(ValueError):
        quality.covered(ids, "k", labels.limit(0))
    assert rows(quality.looked_up(ids.filter("k < 3"), "k", labels, "label")) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="no label for k 3"):
        quality.looked_up(ids, "k", labels, "label").collect()
